"""Exact top-k inner-product search by columnar branch and bound.

Vectors are packed into tiles; queries into tiles of their own. Each pair of tiles meets once,
in a join on (query part, group), so neither side is ever held whole. Inside a pair the candidates lie
column by column (one row of the array per dimension). Scores are summed one block of
dimensions at a time; before each next block, a candidate whose partial score plus the
largest possible rest (product of the remaining norms, by Cauchy and Schwarz) is below the
k-th best score known is dropped and the survivors are compacted. Each pair of tiles gives
k rows per query; a last ranking merges those.

Components are whole numbers, held as doubles. Scores are summed in double precision while every partial sum is below
2^53, which is exact, else in 64-bit integers while those hold them, else in Python's integers. A score among a query's best that
doesn't fit a long stops the job with an OverflowError.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do vectors of another length than the query's meet it. Ties go to the smaller id. Repeated ids
are different rows: a query never meets rows of its own id, and each query row is a query of its own, so an id that
two query rows share has two lists. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TILE = "dim int, tile long, ids binary, matrix binary"
TILE_SCHEMA = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())])


def valid(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)


def whole(x):
    """The greatest whole number not above x, as a double: floor() gives longs, which end at 2^63."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # larger doubles are whole


def tiles(df: DataFrame, rows: int) -> DataFrame:
    """(id, values array<double>) packed into tiles of at most ``rows`` vectors of one length; a
    tile's number, shifted by 33 bits, is its partition's."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        base = TaskContext.get().partitionId() << 33
        made = 0

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = zip(*waiting.pop(dim), strict=True)
            made += 1
            columns = [[dim], [base + made], [np.array(ids, "<i8").tobytes()], [np.concatenate(vectors).astype("<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TILE_SCHEMA, strict=True)], schema=TILE_SCHEMA)

        for batch in batches:
            values = batch.column("values")
            flat = values.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            for key, vector in zip(batch.column("id").to_pylist(), np.split(flat, ends[:-1]), strict=True) if len(ends) else ():
                held = waiting.setdefault(len(vector), [])
                held.append((key, vector))
                if len(held) >= rows:
                    yield flush(len(vector))
        for dim in list(waiting):
            yield flush(dim)

    return df.mapInArrow(pack, TILE)


def search_tile(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores) of the k best candidates of each query; rows are vectors."""
    dims = queries.shape[1]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * dims
    if largest >= 2.0**62:
        yield from search_large(queries, query_ids, candidates, ids, k)
        return
    kind = np.float64 if largest < 2.0**53 else np.int64
    # dimensions with the most mass first: bounds tighten soonest
    order = np.argsort(-(candidates.astype(np.float64) ** 2).sum(0), kind="stable")
    columns = np.ascontiguousarray(candidates[:, order].T).astype(kind)
    asked = np.ascontiguousarray(queries[:, order]).astype(kind)
    edges = [*range(0, dims, block), dims]

    def rest(vertical: np.ndarray) -> np.ndarray:
        """Norms of what is left from each edge on; a little above the true ones."""
        squares = vertical.astype(np.float64) ** 2
        tails = np.zeros((len(edges), vertical.shape[1]))
        for i in range(len(edges) - 2, -1, -1):
            tails[i] = tails[i + 1] + squares[edges[i] : edges[i + 1]].sum(0)
        return np.sqrt(tails) * (1 + 1e-9) + 1e-9

    left, own_left = rest(columns), rest(asked.T)
    first = asked[:, : edges[1]] @ columns[: edges[1]]
    for q in range(len(asked)):
        alive = np.flatnonzero(ids != query_ids[q])
        if not len(alive):
            continue
        partial, query = first[q, alive], asked[q]
        floor = -np.inf
        for i in range(1, len(edges)):
            if i == 1 and len(alive) > k:  # the k most promising, scored in full, give a first floor
                head = alive[np.argpartition(-partial, k - 1)[:k]]
                floor = float((query @ columns[:, head]).min())
            bound = own_left[i, q] * left[i, alive]
            if len(alive) > k:
                floor = max(floor, float(np.partition(partial - bound, len(alive) - k)[len(alive) - k]))
                # sums are exact below 2^53; above, the slack covers the rounding of the comparison
                keep = partial + bound >= floor - abs(floor) * 1e-12 - 1e-6
                alive, partial = alive[keep], partial[keep]
            if i < len(edges) - 1:
                partial = partial + query[edges[i] : edges[i + 1]] @ columns[edges[i] : edges[i + 1], alive]
        best = np.lexsort((ids[alive], -partial))[:k]
        yield q, ids[alive[best]], partial[best].astype(np.int64)


def search_large(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same by all sums in Python's integers."""
    import heapq

    whole_ = [list(map(int, c)) for c in candidates.tolist()]
    for q, vector in enumerate(queries.tolist()):
        asked = list(map(int, vector))
        scores = ((-sum(a * b for a, b in zip(asked, c, strict=True)), i) for c, i in zip(whole_, ids.tolist(), strict=True) if i != query_ids[q])
        best = heapq.nsmallest(k, scores)
        if any(not -(1 << 63) < s < 1 << 63 for s, _ in best):
            raise OverflowError(f"a score of query {query_ids[q]} doesn't fit a long")
        if best:
            yield q, np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = 8, query_rows: int = 2048, rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Both sides are (id long, values array<double>), of whole numbers.
    """
    spark = queries.sparkSession
    asked = max(1, -(-queries.count() // query_rows))
    packed = tiles(queries.repartition(asked, F.xxhash64("id")), query_rows)
    groups = common.parallel(spark)
    left = packed.select("dim", F.shiftright("tile", 33).cast("int").alias("part"), F.col("tile").alias("query_tile"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = tiles(candidates, rows).withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    # sorted, never broadcast: Spark takes the queries for what they were before each group got them all
    pairs = right.join(left.hint("merge"), ["dim", "part", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, query_tile, query_ids, query_matrix, ids, matrix in common.rows_of(batch, "dim", "query_tile", "query_ids", "query_matrix", "ids", "matrix", at_once=1):
                own = np.frombuffer(query_ids, "<i8")
                found = list(search_tile(np.frombuffer(query_matrix, "<f8").reshape(-1, dim), own, np.frombuffer(matrix, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), k, block))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(len(x) for _, x, _ in found), query_tile)), pa.array(np.concatenate([np.full(len(x), q) for q, x, _ in found])), pa.array(np.concatenate([np.full(len(x), own[q]) for q, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["tile", "place", "query_id", "vec_id", "score"])

    near = pairs.mapInArrow(run, "tile long, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("tile", "place").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
