"""Exact ranks within groups, from histograms of the digits of an id.

A row's rank is the number of rows of its group with smaller digits, summed digit by digit, and its place among the rows that share
all counted digits. A digit has ``BITS`` bits, so what is ordered at once are 4096 counts at most, whatever the size of a group, and
rows meet only with those of their last digit. Where ids repeat, such a place may be crowded: it is counted further by the id itself,
by the tie-break's first characters, by the whole tie-break and by parts of what is equal in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 12
#: Rows that share all counted digits and are still ordered together.
CROWD = 1 << 16
#: Parts of rows that are equal in id and tie-break.
PARTS = 256


def starts(counts: DataFrame, keys: list[str], digits: list[str]) -> DataFrame:
    """counts(keys, digits, _n), one row of each, with _start, the rows of the same keys with smaller digits (the first digit counts
    most), and _size, all rows of these keys. Nothing may be null. counts is read once for each digit."""
    *above, last = digits
    w = Window.partitionBy(*keys, *above).orderBy(last)
    told = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not above:
        return told.withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys)))
    upper = starts(counts.groupBy(*keys, *above).agg(F.sum("_n").alias("_n")), keys, above)
    met = told.join(upper.select(*keys, *above, F.col("_start").alias("_before"), "_size"), [*keys, *above])
    return met.withColumn("_start", F.col("_start") + F.col("_before")).drop("_before")


def ranked(rows: DataFrame, keys: list[str], by: str, tie: str, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """rows with _rank (from 0, among the rows of the same keys, by the long ``by``, nulls first, then by the string ``tie``) and _size
    (the rows of these keys), and the largest _size. rows is a written table with a _key that differs from row to row and decides
    between rows that are equal; keys and tie are never null."""
    rows = rows.withColumn("_p0", F.coalesce(F.shiftright(by, BITS), F.lit(-(1 << (64 - BITS)))))
    counts, _ = common.save(rows.groupBy(*keys, "_p0").agg(F.count("*").alias("_n")))
    span = counts.agg(F.min("_p0").alias("low"), F.max("_p0").alias("high"), F.max("_n").alias("most")).first()
    if span.most is None:
        return rows.select(*rows.columns[:-1], F.lit(0).cast("long").alias("_rank"), F.lit(0).cast("long").alias("_size")), 0
    digits, k = ["_p0"], 0
    while (span.high >> k) - (span.low >> k) >> BITS:
        k += BITS
        digits.insert(0, f"_p{len(digits)}")
        counts = counts.withColumn(digits[0], F.shiftright("_p0", k))
    known, _ = common.save(starts(counts, keys, digits).select(*keys, "_p0", "_start", "_size", F.col("_n").alias("_near")))
    told, fine = rows.join(known, [*keys, "_p0"]), []
    if span.most > crowd:
        crowded = F.col("_near") > crowd
        cuts = {
            "_f0": F.when(crowded, F.coalesce(F.col(by).bitwiseAND((1 << BITS) - 1), F.lit(0))).otherwise(F.lit(0)),
            "_f1": F.when(crowded, F.substring(tie, 1, 3)).otherwise(""),
            "_f2": F.when(crowded, F.col(tie)).otherwise(""),
            "_f3": F.when(crowded, F.pmod(F.xxhash64("_key"), F.lit(PARTS))).otherwise(F.lit(0)),
        }
        told, fine = told.withColumns(cuts), list(cuts)
        inner, _ = common.save(told.where(crowded).groupBy(*keys, "_p0", *fine).agg(F.count("*").alias("_n")))
        more = starts(inner, [*keys, "_p0"], fine).select(*keys, "_p0", *fine, F.col("_start").alias("_more"))
        told = told.join(more, [*keys, "_p0", *fine], "left").withColumn("_start", F.col("_start") + F.coalesce("_more", F.lit(0)))
    w = Window.partitionBy(*keys, "_p0", *fine).orderBy(F.col(by).asc_nulls_first(), tie, "_key")
    told = told.select(*rows.columns[:-1], (F.row_number().over(w) - 1 + F.col("_start")).alias("_rank"), "_size")
    return told, known.agg(F.max("_size")).first()[0]
