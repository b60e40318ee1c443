"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class with a multiplicity. The distinct ones are dealt to the nearest of a
bounded number of pivots (a sample of the vectors); each lives in its pivot's tile and visits the
tiles that two angle bounds cannot rule out: the tile's radius, and the gap between own and other
pivot. Crowded tiles are split into blocks which visitors all see, so a task holds one
block and streams what visits it.

In a block each vector u of length 1 is s * q + e with q in int8. The products q.q' are exact
integers (float32 BLAS holds them below 2^24, else float64 is used), and
|u.v - s s' q.q'| <= (1 + |e|)|e'| + |e|. Only pairs whose bound reaches the threshold are
computed again in double precision from the original components.

Links are counted where they are found and reduced to a spanning forest, so a group of n
near copies emits n edges.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths are not compared. Rows that share an id are separate vectors
for counting. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .topk import valid


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Quantised:
    """Rows as int8 with scale and the norm of what quantising lost."""

    def __init__(self, vectors: np.ndarray):
        self.exact = unit(vectors)
        self.scale = np.abs(self.exact).max(1) / 127
        codes = np.rint(self.exact / self.scale[:, None]).astype(np.int8)
        lost = self.exact - codes * self.scale[:, None]
        self.error = np.sqrt((lost * lost).sum(1)) + 1e-12
        # integers in floating point: BLAS sums them exactly while sums stay below 2^24
        self.codes = codes.astype(np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def links(a: Quantised, b: Quantised, least: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all pairs with cosine >= least in double precision."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    widest = float(b.error.max(initial=0))
    for at in range(0, len(a.exact), step):
        part = slice(at, min(at + step, len(a.exact)))
        error = a.error[part]
        slack = (1 + error) * widest + error
        products = a.codes[part] @ b.codes.T
        # codes product needed: (least - slack) / scale of a, over the scale of b
        need = ((least - slack) / a.scale[part])[:, None].astype(products.dtype)
        products *= b.scale.astype(products.dtype)[None, :]
        i, j = np.nonzero(products >= need - np.abs(need) * 1e-5)
        for s in range(0, len(i), 1 << 16):  # again, in full precision
            x, y = i[s : s + (1 << 16)] + at, j[s : s + (1 << 16)]
            yes = np.einsum("ij,ij->i", a.exact[x], b.exact[y]) >= least
            found_a.append(x[yes])
            found_b.append(y[yes])
    return np.concatenate(found_a), np.concatenate(found_b)


class Pivots:
    def __init__(self, vectors: np.ndarray, least: float):
        self.units = unit(vectors)
        self.angle = float(np.arccos(min(1.0, least))) + 1e-6
        self.radius = np.zeros(len(vectors))

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.units.T, -1, 1))

    def visits(self, angles: np.ndarray, home: np.ndarray) -> np.ndarray:
        own = angles[np.arange(len(home)), home]
        return (angles <= self.radius[None, :] + self.angle) & (angles <= own[:, None] + 2 * self.angle)


ROW = "cell long, visitor boolean, id long, copies long, vector binary"
FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def matrix(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<f8").reshape(len(column), -1)


def tile_links(rows: DataFrame, least: float) -> DataFrame:
    """(id, other, n): counts of links for id, and where other is set an edge of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None

        def made(ids, others, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())], schema=FOUND)

        def settle():
            ids, copies = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            block = Quantised(np.concatenate([p[2] for p in parts]))
            v, r = links(block, block, least)
            counts = np.bincount(v[v != r], weights=copies[r[v != r]], minlength=len(ids)).astype(np.int64)
            return [ids, copies, block, counts, graph.roots_of(len(ids), v, r)]

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and parts:
                held = settle()
            if held is not None:
                ids, _, _, counts, label = held
                yield made(ids, [int(ids[x]) if x != i else None for i, x in enumerate(label)], counts)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *edges], [*edges, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    if cell is not None:
                        yield from finish()
                    cell, parts, held = cells[a], [], None
                here = a + int(np.searchsorted(visitor[a:b], True))
                ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
                if here > a:
                    parts.append((ids[a:here], copies[a:here], matrix(batch.column("vector").slice(a, here - a))))
                if here == b or not parts:
                    continue
                if held is None:
                    held = settle()
                guests = Quantised(matrix(batch.column("vector").slice(here, b - here)))
                own, weight, block, counts, label = held
                v, r = links(guests, block, least)
                if len(v):
                    held[3] = counts + np.bincount(r, weights=copies[here:b][v], minlength=len(own)).astype(np.int64)
                    n = len(own)
                    label = graph.roots_of(n + b - here, np.concatenate([np.arange(n), v + n]), np.concatenate([label, r]))
                    linked = np.unique(v)
                    met = np.bincount(v, weights=weight[r], minlength=b - here).astype(np.int64)
                    yield made(ids[here:b][linked], own[label[n + linked]], met[linked])
                    held[4] = label[:n]
        if cell is not None:
            yield from finish()

    return rows.mapInArrow(run, "id long, other long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, block: int = 4096, most_pivots: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    told = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    able = valid(told, "embedding").where(F.exists("embedding", lambda x: x != 0))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = (lists.flatten().to_numpy(zero_copy_only=False) + 0.0).astype("<f8").tobytes()  # -0 counts as 0
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 8
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], ["vec_id", "vector"])

    rows, _ = common.save(able.mapInArrow(as_bytes, "vec_id long, vector binary"))
    # a class's id is its own number, so that null or repeated vec_ids do no harm
    classes, _ = common.save(rows.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n")).collect()  # one row for each length of vector
    found = None
    for size in sizes:
        part = classes.where(F.length("vector") == size.bytes)
        k = min(most_pivots, max(1, -(-size.n // block)))
        # a bounded sample gives the pivots; every vector is dealt to one
        sample = part.select("vector").orderBy(F.xxhash64(F.lit(3), "vector"), "vector").limit(k).collect()
        pivots = Pivots(np.frombuffer(b"".join(r.vector for r in sample), "<f8").reshape(len(sample), -1), least)
        edges = _cells(part, pivots, block, common.parallel(spark))
        one = tile_links(edges, least)
        found = one if found is None else found.union(one)
    if found is None:
        return told.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found, _ = common.save(found)
    joined = graph.components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "id", "left").join(joined, "id", "left").select("id", "vector", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    least_id = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least_id, "component").select("vector", "n_links", "component_id")
    linked = rows.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = told.where(F.col("embedding").isNull() | (F.size("embedding") <= 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: F.coalesce(x, F.lit(0.0)) != 0))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _cells(classes: DataFrame, pivots: Pivots, block: int, parallel: int) -> DataFrame:
    """Rows of ROW, dealt by cell, residents before visitors."""
    k = len(pivots.radius)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, radius = np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                angles = pivots.angles(unit(matrix(batch.column("vector"))))
                home = angles.argmin(1)
                counts += np.bincount(home, minlength=k)
                np.maximum.at(radius, home, angles[np.arange(len(home)), home])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), pa.array(radius)], ["tile", "n", "radius"])

    blocks = np.ones(k, np.int64)
    for row in classes.select("vector").mapInArrow(measure, "tile long, n long, radius double").groupBy("tile").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        blocks[row.tile] = max(1, -(-row.n // block))
        pivots.radius[row.tile] = row.radius
    first = np.cumsum(blocks) - blocks

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                angles = pivots.angles(unit(matrix(part.column("vector"))))
                home = angles.argmin(1)
                own = (part.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[home]
                who, tile = np.nonzero(pivots.visits(angles, home))
                later = tile >= home[who]
                who, tile = who[later], tile[later]
                begin = np.where(tile == home[who], own[who] + 1, 0)
                many = np.maximum(blocks[tile] - begin, 0)
                rows = np.repeat(np.arange(len(who)), many)
                step = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                cell = np.concatenate([first[home] + own, first[tile[rows]] + begin[rows] + step])
                take = pa.array(np.concatenate([np.arange(len(home)), who[rows]]))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arange(len(cell)) >= len(home)), *(part.column(c).take(take) for c in ("id", "copies", "vector"))], ["cell", "visitor", "id", "copies", "vector"])

    return classes.select("id", "copies", "vector").mapInArrow(spread, ROW).repartition(max(parallel, min(4096, int(blocks.sum()))), "cell").sortWithinPartitions("cell", "visitor")
