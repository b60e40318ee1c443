"""Connected components of an edge table, and spanning forests inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def roots_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node reachable by the links a-b."""
    label = np.arange(size)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component: for each end of edges(a, b), the smallest id reachable. Edges with a null end, and without another end, count for
    nothing; repeated ones once. No edges, no rows.

    Alternating large-star and small-star steps. Both take one minimum per node, combined
    before the shuffle, and one equi-join, whose crowded keys adaptive execution can split; each round's
    edges are written to the shared folder, so no lineage grows and none is collected.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now, path = common.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that a crowded key's rows can be split in the join, or not moved at all where the table is small
        least, least_path = common.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        large, large_path = common.save(large)
        own, own_path = common.save(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(own, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new_path = common.save(small.union(own.select("a", F.col("m").alias("b"))).distinct())
        n = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (path, least_path, large_path, own_path):
            common.discard(spark, old)
        now, path = after, new_path
        if tuple(n) == told:
            break
        told = tuple(n)
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
