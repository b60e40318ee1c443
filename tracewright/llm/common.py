"""Small helpers that the operators of this package share.

A word is a maximal run of bytes other than space and \\x09-\\x0D. On UTF-8 bytes that is
exactly what ``bytes.split()`` yields, so texts travel to Python as binary, undecoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, save  # noqa: F401  (for the operators)

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_bytes(col: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"")).alias("text")


def with_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, told): docs as a table in the shared folder, _row and a _key that tells rows apart and is written once; and of each row
    _key, doc_id and text."""
    rows = save(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_key")))[0]
    return rows, rows.select("_key", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))


def least_rows(rows: DataFrame, told: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each component of grouped(_key, component) the row of with_keys() with the
    least doc_id, nulls last; then by content, so that the layout decides only between equal texts."""
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), "_key")
    chosen = told.select("_key", order.alias("row")).join(grouped, "_key").groupBy("component").agg(F.min("row").alias("row")).select("row._key")
    return rows.join(chosen, "_key", "left_semi").select("_row.*")


def rows_of(batch: pa.RecordBatch, *names: str, at_once: int = 512) -> Iterator[tuple]:
    """The rows as tuples; few texts are Python objects at a time."""
    for at in range(0, len(batch), at_once):
        part = batch.slice(at, at_once)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def small_batches(spark: SparkSession) -> None:
    """Where the session leaves it open, rows with whole texts go to Python a thousand at a time: executors and workers keep what the
    largest batch took."""
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, "1000")


def tidy() -> None:
    """Give a Python worker's free memory back: workers stay for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def parallel(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of addends(): a piece of an array and its weight.
ADDENDS = "part int, n double, values binary"
PIECE = 4096


def addends(values: np.ndarray, weight: float) -> pa.RecordBatch:
    """What a task adds to a sum of arrays over all tasks."""
    pieces = [values[i : i + PIECE].astype(np.float64).tobytes() for i in range(0, len(values), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([float(weight)] * len(pieces)), pa.array(pieces, pa.binary())], ["part", "n", "values"])


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, values in rows_of(batch, "part", "n", "values"):
                x = np.frombuffer(values, np.float64)
                if part in sums:
                    sums[part][0] += n
                    sums[part][1] += x
                else:
                    sums[part] = [n, x.copy()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.float64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], ["part", "n", "values"])

    return rows.repartition(parallel(rows.sparkSession), *keys).select("part", "n", "values").mapInArrow(run, ADDENDS)


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' addends() over the sum of their weights; empty if there are none. Groups of 256 tasks are added first; a task
    holds one array for each of its pieces, the driver the whole."""
    near = _added(rows.withColumn("group", F.floor(F.spark_partition_id() / 256)), "part", "group")
    found = _added(near, "part").orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["values"], np.float64) / r.n for r in found]) if found else np.zeros(0)
