"""Work along an order that no single task sees: as-of joins and neighbours, by buckets of equal depth and a carry for each.

A row's bucket is told by quantiles of the order over all rows that take part, so buckets hold about as many rows each, bursts and pauses or not. Rows
that share the place at a bucket's border are in one bucket. What a bucket needs of the ones before it, the carry, comes from an aggregate of one row a
bucket, and enters the bucket as a row of its own, so no row is joined for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average, and the most buckets there are.
CROWD, MOST = 1 << 14, 1 << 12


def cuts(rows: DataFrame, at: str, crowd: int = CROWD) -> list[float]:
    """Where to cut rows by a number so that each part has about crowd of them: MOST numbers at the driver at most. Rows are counted first; few
    aren't cut."""
    parts = min(MOST, -(-rows.count() // crowd))
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx(F.col(at).cast("double"), shares, 20 * parts).alias("at")).first().at))


def placed(rows: DataFrame, at: str, cut: list[float]) -> DataFrame:
    """rows with _b, the number of cuts at or before their place."""
    if not cut:
        return rows.withColumn("_b", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    bucketizer = Bucketizer(splits=[float("-inf"), *cut, float("inf")], inputCol="_at", outputCol="_b")
    return bucketizer.transform(rows.withColumn("_at", F.col(at).cast("double"))).withColumn("_b", F.col("_b").cast("int")).drop("_at")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, before: bool = False, crowd: int = CROWD) -> DataFrame:
    """points with ``value``, the largest value of the marks(keys, at, value) at or before their place (before: only before it), null where there is
    none. A mark's value grows with its place. Points of one place may be many: they are dealt out over parts of their bucket, each with all its marks."""
    few = marks.select(*keys, at, value)
    cut = cuts(points.select(at).unionByName(few.select(at)), at, crowd)
    ours, theirs = (placed(x, at, cut) for x in (points, few))
    pairs = ours.select(*keys, "_b").withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).unionByName(theirs.select(*keys, "_b", value))
    per = pairs.groupBy(*keys, "_b").agg(F.max(value).alias(value), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # a bucket that ties made too deep: its points in parts
    heads = per.select(*keys, "_b", F.max(value).over(earlier).alias(value), F.ceil(F.col("_n") / F.lit(4 * crowd)).cast("int").alias("_parts"))
    deep = {r._b: r.n for r in heads.where("_parts > 1").groupBy("_b").agg(F.max("_parts").alias("n")).collect()} if cut else {}  # MOST rows at most
    salts = F.coalesce(F.create_map(*(F.lit(x) for pair in deep.items() for x in pair))[F.col("_b")], F.lit(1)) if deep else F.lit(1)
    ours = ours.withColumn("_p", F.floor(F.rand(7) * salts).cast("int") if deep else F.lit(0))
    known = theirs.withColumn("_kind", F.lit(1)).unionByName(heads.select(*keys, "_b", value).where(F.col(value).isNotNull()).withColumns({at: F.lit(None).cast(marks.schema[at].dataType), "_kind": F.lit(0)}))
    known = known.withColumn("_p", F.explode(F.sequence(F.lit(0), salts - 1)) if deep else F.lit(0))
    both = ours.withColumn("_kind", F.lit(2)).unionByName(known.select(*keys, "_b", "_p", at, "_kind", value), allowMissingColumns=True)
    tie = F.when(F.col("_kind") == 2, 0).otherwise(1) if before else F.col("_kind")
    w = Window.partitionBy(*keys, "_b", "_p").orderBy(F.col(at).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.max(value).over(w)).where("_kind = 2").select(*points.columns, value)


def beside(rows: DataFrame, keys: list[str], order: list[str], values: list[str], after: bool = False, crowd: int = 1 << 20) -> DataFrame:
    """rows with a struct _beside of the values in the row before (after: behind) it, by keys in this order, null where there is none. The order's first
    column is a number. Groups of more than crowd rows are cut into buckets of it; the others stay whole."""
    near = (lambda c: F.col(c).desc()) if after else F.col
    told = F.struct(*values)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*keys)
    if sizes.isEmpty():
        return rows.withColumn("_beside", F.lag(told).over(Window.partitionBy(*keys).orderBy(*map(near, order))))
    large = rows.join(sizes.withColumn("_large", F.lit(True)), keys, "left")
    cut = cuts(large.where("_large").select(order[0]), order[0], crowd)
    every = placed(large, order[0], cut).withColumn("_b", F.when(F.col("_large"), F.col("_b")).otherwise(0)).drop("_large")
    last = F.min_by if after else F.max_by
    ends = every.where("_b is not null").groupBy(*keys, "_b").agg(last(told, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy(near("_b"))).alias("_carried")).where("_carried is not null")
    inside = every.withColumn("_beside", F.lag(told).over(Window.partitionBy(*keys, "_b").orderBy(*map(near, order))))
    return inside.join(carried, [*keys, "_b"], "left").withColumn("_beside", F.coalesce("_beside", "_carried")).select(*rows.columns, "_beside")


def numbered(rows: DataFrame, keys: list[str], order: list[str], holds: Column, values: list[str], name: str, crowd: int = CROWD) -> DataFrame:
    """The rows where ``holds``, which may ask the struct _beside of the values in the row before, with their numbers from 0 by keys in this order."""
    cut = cuts(rows.select(order[0]), order[0], crowd)
    every = placed(rows, order[0], cut)
    told = F.struct(*values)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    flagged = every.withColumn("_beside", F.lag(told).over(w))
    inner = F.when(F.col("_beside").isNotNull() & holds, 1).otherwise(0)
    flagged = flagged.withColumns({"_n": F.sum(inner).over(w), "_first": F.col("_beside").isNull()})
    # of each bucket: what it ends with, its first row, and how many hold behind that
    per = flagged.groupBy(*keys, "_b").agg(F.max("_n").alias("_held"), F.max_by(told, F.struct(*order)).alias("_end"), F.min_by(told, F.struct(*order)).alias("_start"))
    by = Window.partitionBy(*keys).orderBy("_b")
    per = per.withColumn("_beside", F.lag("_end").over(by))
    opens = per.select(*keys, "_b", "_held", "_beside", *(F.col(f"_start.{v}").alias(v) for v in values)).withColumn("_opens", F.when(holds, 1).otherwise(0))
    known = opens.select(*keys, "_b", "_opens", F.col("_beside").alias("_carried"), (F.sum(F.col("_held") + F.col("_opens")).over(by) - F.col("_held") - F.col("_opens")).alias("_known"))
    kept = flagged.where(F.col("_first") | holds).join(known, [*keys, "_b"]).where(~F.col("_first") | (F.col("_opens") == 1))
    return kept.select(*rows.columns, (F.col("_n") + F.col("_opens") + F.col("_known") - 1).cast("bigint").alias(name))
