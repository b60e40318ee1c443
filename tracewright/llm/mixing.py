"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target in words. A document's expected copies are target / source size, the
same for all documents of a source, so their prefix sum at the k-th document is k times that.
One offset per source is added, and a document is taken once for each integer boundary that
its own step crosses. Ranks come in two levels: a row number inside a chunk (source, size
class, one of ``SALTS`` hash parts) plus the number of rows in the source's earlier chunks. A source that holds a
third of all rows is thus many window partitions, and only one row per chunk meets
in the second level. Size classes come in order, so each stretch of sizes is sampled at the
same rate and the words taken stay near the target.

Defined results: null text has size 0, null is a source of its own (last in order), a source
without words has target 0 and nothing of it is taken. Repeated rows count as rows. Offsets and
hash parts depend on nothing but ids and sources, so reruns agree. An empty table gives an empty result. Other columns
stay, whatever their names; those called like a column that is added give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hash parts of a size class of a source, at every size of input.
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words."""
    return docs.withColumn("size", size_of(F.col("text")))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target for (source, source_size): one row per source, written once.

    ``weights`` repeat over the sources by code point, null last. A source stops at cap times
    its size and the excess goes to the others by weight: each gets min(cap * size, level * weight), and the
    common level rises round by round until no more sources are full. An empty table gives an empty result; a source of null is
    a source; sources are taken to be distinct. The driver holds three numbers a round.
    """
    spark = sizes.sparkSession
    cut, path = common.save(sizes.repartitionByRange(common.parallel(spark), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    # places by code point in two levels: inside a range of names, and over the ranges, as many as there are partitions
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    known, _ = common.save(cut.join(F.broadcast(before), "_part").select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(cap))).alias("_most")))
    common.discard(spark, path)
    total = known.agg(F.sum("source_size").alias("n"), F.sum("_weight").alias("w")).first()
    level, full = (share * (total.n or 0) / total.w if total.w else 0.0), -1
    while True:
        above = F.col("_most") <= F.lit(level) * F.col("_weight")
        now = known.agg(F.count(F.when(above, 1)).alias("full"), F.sum(F.when(above, F.col("_most"))).alias("held"), F.sum(F.when(~above, F.col("_weight"))).alias("free")).first()
        if now.full == full or not now.free:
            break
        full, level = now.full, (share * total.n - (now.held or 0.0)) / now.free
    return known.select("source", "source_size", F.least("_most", F.lit(level) * F.col("_weight")).alias("target"))


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    size: Column | None = None,
) -> DataFrame:
    """docs(source, doc_id, size, ...) with size, source_size, target and copies. size: an expression over docs where it has no such column."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    size = F.col("size") if size is None else size
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), size.cast("long").alias("_size"), F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), F.col("doc_id").alias("_id"))
    keyed = keyed.withColumn("_class", F.floor(F.log2(F.col("_size") + 1) * 4).cast("int")).withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed), "_id", "_size"), F.lit(SALTS)))
    parts = ["_null", "_source", "_class", "_salt"]
    chunks, _ = common.save(keyed.groupBy(*parts).agg(F.count("*").alias("_rows"), F.sum("_size").alias("_words")))
    sizes = chunks.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size")).select(F.when(~F.col("_null"), F.col("_source")).alias("source"), "source_size")
    told = targets(sizes, weights, share, cap)
    told = told.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    told = told.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    told = told.withColumn("_offset", F.pmod(F.xxhash64(F.lit(seed), "_null", "_source"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    earlier = Window.partitionBy("_null", "_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).join(told, ["_null", "_source"]).drop("_rows", "_words")
    chunks, _ = common.save(chunks)
    inside = Window.partitionBy(*parts).orderBy("_size", "_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside)).join(chunks, parts)
    last, first = ((F.col("_before") + F.col("_rank") - k) * F.col("_rate") + F.col("_offset") for k in (0, 1))
    taken = (F.floor(last) - F.floor(first)).cast("long")
    return ranked.select(*(F.col(f"_row.`{c}`") for c in own), F.col("_size").alias("size"), "source_size", "target", taken.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs in their mixed proportions: each row as often as it is taken. All columns stay as they are."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"), "source", "doc_id", size_of(F.col("text")).alias("size"))
    taken = copies(whole, **options).where("copies > 0")
    return taken.select("_whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col(f"_whole.`{c}`") for c in docs.columns))
