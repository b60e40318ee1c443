"""SimHash near-duplicates by vantage-point trees.

Documents with one fingerprint are one class, so copies never meet in pairs. The distinct
fingerprints are partitioned by a vantage-point tree that is fitted on a bounded sample: each
inner node holds a vantage point and a Hamming radius, points inside go left, others right. A
leaf is a shard. Each fingerprint lives in one shard and, as a query, visits each later shard
that the triangle inequality cannot rule out: left unless d - r > radius, right unless
d + r <= radius. Of two fingerprints within r bits, the one in the earlier shard thus visits the
other's. Crowded shards are split into blocks that its visitors all see, so no
task holds more than a block and streams the rest.

In a block, residents lie sorted by their distance to one more vantage point; a visitor at distance q
only meets the residents between q - r and q + r. Links found are reduced to a
spanning forest on the spot, so a group of n near copies emits n edges, not n^2.

Cost: vantage points in 64-bit Hamming space prune weakly at r = 4 (distances of unrelated
texts are 32 +- 4), so pairs tested grow nearly as the square of distinct fingerprints; each
level of the tree saves about a sixth.

Defined results: null text is an empty text; empty texts have fingerprint zero and link like others.
A text of fewer words than a shingle is one shingle. Rows that share an id keep their own
fingerprints; the component is the smallest id (nulls last) in the reachable classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, lower: bool = True) -> int:
    """The signed 64-bit fingerprint: a bit is set where over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = (text.lower() if lower else text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        a, b = starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # in slices: a very long text has millions
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id") -> DataFrame:
    """doc_id (or another key), fp (signed long) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for (t,) in common.rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int64())], [key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), common.text_bytes()).mapInArrow(run, f"{key} long, fp long")


class VantageTree:
    """A vantage-point tree over 64-bit values; leaves are numbered left to right."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 7):
        self.radius, self.leaves = radius, 0
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), leaves)
        del self.random

    def _grow(self, points: np.ndarray, leaves: int):
        if leaves > 1 and len(points) >= 8:
            best = None
            for vantage in self.random.choice(points, min(12, len(points)), replace=False):
                d = np.bitwise_count(points ^ vantage)
                cut = int(np.median(d))
                for at in (cut - 1, cut, cut + 1):
                    inside = int((d <= at).sum())
                    if min(inside, len(points) - inside) * 4 >= len(points):  # the fewest that visit both sides
                        both = int(((d > at - self.radius) & (d <= at + self.radius)).sum())
                        if best is None or both < best[0]:
                            best = both, vantage, at, d
            if best:
                _, vantage, at, d = best
                left = self._grow(points[d <= at], leaves // 2)
                return vantage, at, left, self._grow(points[d > at], leaves - leaves // 2)
        self.leaves += 1
        return self.leaves - 1

    def homes(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
                continue
            vantage, cut, left, right = node
            inside = np.bitwise_count(points[at] ^ vantage) <= cut
            stack += [(left, at[inside]), (right, at[~inside])]
        return out

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) of every leaf that may hold something within the radius."""
        positions, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                positions.append(at)
                found.append(np.full(len(at), node, np.int32))
                continue
            vantage, cut, left, right = node
            d = np.bitwise_count(points[at] ^ vantage).astype(np.int16)
            stack += [(left, at[d - self.radius <= cut]), (right, at[d + self.radius > cut])]
        return np.concatenate(positions), np.concatenate(found)


CELL = "cell long, visitor boolean, fp long"


def place(points: np.ndarray, tree: VantageTree, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, is a visitor, position) rows. blocks: the number of blocks of each leaf."""
    first = np.cumsum(blocks) - blocks
    home = tree.homes(points)
    mixed = points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    block = (mixed % blocks[home].astype(np.uint64)).astype(np.int64)
    at, leaf = tree.visits(points)
    later = leaf >= home[at]
    at, leaf = at[later], leaf[later]
    begin = np.where(leaf == home[at], block[at] + 1, 0)  # in its own leaf: the later blocks
    many = np.maximum(blocks[leaf] - begin, 0)
    rows = np.repeat(np.arange(len(at)), many)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    cells = np.concatenate([first[home] + block, first[leaf[rows]] + begin[rows] + step])
    visitor = np.concatenate([np.zeros(len(points), bool), np.ones(len(rows), bool)])
    return cells, visitor, np.concatenate([np.arange(len(points)), at[rows]])


def close_pairs(visitors: np.ndarray, residents: np.ndarray, away: np.ndarray, vantage: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the radius; residents are sorted by ``away``, their distance to the vantage point."""
    q = np.bitwise_count(visitors ^ vantage).astype(np.int16)
    order = np.argsort(q, kind="stable")
    found_v, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(order), 64):
        part = order[at : at + 64]
        low = np.searchsorted(away, q[part[0]] - radius, "left")
        high = np.searchsorted(away, q[part[-1]] + radius, "right")
        v, r = np.nonzero(np.bitwise_count(visitors[part, None] ^ residents[None, low:high]) <= radius)
        if len(v):
            found_v.append(part[v])
            found_r.append(r + low)
    return np.concatenate(found_v), np.concatenate(found_r)


def forest(rows: DataFrame, radius: int) -> DataFrame:
    """edges(a, b) that join what lies within the radius, from rows of CELL sorted by cell, residents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        residents = np.zeros(0, np.uint64)
        away = np.zeros(0, np.int16)
        label = np.zeros(0, np.int64)
        ready = False

        def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def settle() -> None:
            """All residents of the cell are here: sort them and link them among themselves."""
            nonlocal residents, away, label, ready
            residents = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            away = np.bitwise_count(residents ^ residents[:1]).astype(np.int16)
            order = np.argsort(away, kind="stable")
            residents, away = residents[order], away[order]
            v, r = close_pairs(residents, residents, away, residents[0], radius) if len(residents) else (np.zeros(0, np.int64),) * 2
            label = graph.roots_of(len(residents), v, r)
            ready = True

        def finish() -> Iterator[pa.RecordBatch]:
            if not ready:
                settle()
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield made(residents[moved], residents[label[moved]])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            points = batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *edges], [*edges, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    if cell is not None:
                        yield from finish()
                    cell, parts, ready = cells[a], [], False
                here = a + int(np.searchsorted(visitor[a:b], True))
                if here > a:
                    parts.append(points[a:here])
                guests = points[here:b]
                if not len(guests):
                    continue
                if not ready:
                    settle()
                if not len(residents):
                    continue
                v, r = close_pairs(guests, residents, away, residents[0], radius)
                if len(v):
                    n = len(residents)
                    label = graph.roots_of(n + len(guests), np.concatenate([np.arange(n), v + n]), np.concatenate([label, r]))
                    linked = np.unique(v)
                    yield made(guests[linked], residents[label[n + linked]])
                    label = label[:n]
        if cell is not None:
            yield from finish()

    return rows.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, radius: int = 4, shard: int = 32768, sample: int = 16384) -> DataFrame:
    """fp, component_id for each distinct fp of prints(doc_id, fp)."""
    spark = prints.sparkSession
    classes, _ = common.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = classes.count()
    # a bounded sample fits the tree; every fingerprint is placed in it
    fitted = np.array([r.fp for r in classes.select("fp").orderBy(F.xxhash64(F.lit(1), "fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    tree = VantageTree(fitted, min(1024, max(1, -(-n // shard))), radius)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(tree.leaves, np.int64)
        for batch in batches:
            counts += np.bincount(tree.homes(batch.column("fp").to_numpy().view(np.uint64)), minlength=tree.leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.leaves)), pa.array(counts)], ["leaf", "n"])

    blocks = np.ones(tree.leaves, np.int64)
    for row in classes.select("fp").mapInArrow(homes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # 1024 rows at most
        blocks[row.leaf] = max(1, -(-row.n // (2 * shard)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            cells, visitor, at = place(points, tree, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(visitor), pa.array(points[at].view(np.int64))], ["cell", "visitor", "fp"])

    # a cell is the work of one task; cells are many times a cluster's cores once the input is large
    dealt = classes.select("fp").mapInArrow(spread, CELL).repartition(max(common.parallel(spark), min(4096, int(blocks.sum()))), "cell")
    edges = forest(dealt.sortWithinPartitions("cell", "visitor"), radius)
    found = graph.components(edges)
    joined = classes.join(found, classes.fp == found.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs(doc_id, text)."""
    prints, _ = common.save(fingerprints(docs, shingle))
    return prints.join(components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs without near-duplicates: the least row of each component stays, whatever ids repeat or are null."""
    rows, told = common.with_keys(docs)
    prints, _ = common.save(fingerprints(told, shingle, "_key"))
    found = prints.join(components(prints.withColumnRenamed("_key", "doc_id"), radius), "fp")
    return common.least_rows(rows, told, found.select("_key", F.col("component_id").alias("component")))
