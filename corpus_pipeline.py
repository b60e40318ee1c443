"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. No SQL can express the classifier, so ORACLE_SQL is None;
tests hold the whole pipeline against a plain version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import tables
from tracewright.llm import common, mixing, neardup, packing, pii, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier accepts. A null text is an empty one; of a table without usable labels everything stays."""
    common.small_batches(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return quality.score(told, model).where("score >= 0.5").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash fingerprints of five-word shingles that differ in 4 of 64 bits or fewer, or sets of
    these shingles of similarity 0.8 or more, which fingerprints at 4 bits miss half of. Of a group the least doc_id stays, null ids last; texts without
    words are alike; repeated rows are a group."""
    common.small_batches(spark)
    return neardup.keep_one(docs, shingle=5, least=0.8, radius=4)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; a null text stays null, and all rows stay."""
    common.small_batches(spark)
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them. Null is a source; a document without words counts as one
    of size 0, and a source without words is not taken."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: each piece's tokens and its place. A document without text is its end token alone."""
    common.small_batches(spark)
    return packing.pack(docs, with_ids=True, keep=30_000)  # workers of earlier stages hold memory, too


STAGES = [
    ("quality classifier", good_documents),
    ("near-dedup by SimHash and similarity", without_near_duplicates),
    ("PII", without_personal_data),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each one's result is a table before the next reads it; what a stage wrote besides goes with it."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with tables.passing(spark) as made:
            docs, path = common.save(stage(spark, docs, sf_dir))
            made.remove(path)
        if last:
            common.discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
