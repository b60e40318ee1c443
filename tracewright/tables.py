"""Intermediate tables: written to the folder that driver and executors share, so that no lineage grows and a lost
executor costs nothing that was written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What the session names; a temporary folder only where none is set and one machine runs everything."""
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{FOLDER} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(FOLDER, folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """Where to write something that goes with the tables of save()."""
    path = f"{shared_folder(spark).rstrip('/')}/tracewright/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """df as written, and where."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of save() that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that save() writes inside go at the end, but for those that are taken out of the list."""
    _open.append(made := [])
    try:
        yield made
    finally:
        _open.pop()  # contexts end in the reverse order; lists may be equal
        for path in made:
            discard(spark, path)
