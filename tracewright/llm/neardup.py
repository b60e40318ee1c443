"""Near-duplicates by the Jaccard similarity of word shingles.

1. Each text becomes the set of its shingles' 64-bit hashes. Texts with one set are one class.
2. MinHash signatures of 32 bands of 5 values: classes that share a band are candidates. A pair at similarity s
   is missed with probability (1 - s^5)^32: 3e-6 at 0.8, less above, 0.008 at 0.67.
3. In each component of candidates every class is tested against one of them, the leader. A group of near copies, however
   large, is linked so in one pass.
4. Where classes are left that are not like the leader, they are tested against each other and against those that are: sets
   go to cells, once for each block of the component that holds others. Pairs that are linked already aren't tested. Only
   tested links count.

Defined results: null text is an empty text; empty texts are like each other and nothing else. A text of
fewer words than a shingle is one shingle. A class is known by 64 bits of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

BANDS, VALUES = 32, 5


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    a, b = starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_random = np.random.default_rng(11)
FLIP, TIMES = _random.integers(0, 1 << 63, (2, BANDS * VALUES), dtype=np.uint64)
TIMES = TIMES << np.uint64(1) | np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of a set's MinHash signature; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):  # in slices that fit a cache
        np.minimum(least, ((found[at : at + 512, None] ^ FLIP) * TIMES).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, VALUES).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return keys.view(np.int64)


def class_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 1)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, ascending and distinct, are as similar as that."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both >= least * whole - 1e-9 * whole


def links(sets: list[np.ndarray], least: float, linked: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest position reachable by pairs of at least this similarity. linked: which are linked to each other already."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    owner = np.repeat(np.arange(m), size)
    every = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    _, item = np.unique(every, return_inverse=True)
    owners = owner[np.argsort(item, kind="stable")]  # by item, then ascending
    ends = np.cumsum(np.bincount(item, minlength=0)) if len(item) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    label = np.arange(m)
    if linked is not None and linked.any():
        label[linked[order]] = np.flatnonzero(linked[order])[0]
    for i in range(m):
        to = int(np.searchsorted(size * least, size[i], "right"))  # no larger set can be similar
        if to <= i + 1 or (label[i + 1 : to] == label[i]).all():
            continue
        own = item[first[i] : first[i] + size[i]]
        high = ends[own]
        low = np.where(own > 0, ends[own - 1], 0)
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        common_ = np.bincount(owners[at], minlength=m)[i + 1 : to]
        whole = size[i] + size[i + 1 : to] - common_
        like = np.flatnonzero(common_ >= least * whole - 1e-9 * whole) + i + 1
        if len(like):
            merged = np.unique(label[np.append(like, i)])
            label[np.isin(label, merged)] = merged[0]
    out = np.empty(m, np.int64)
    out[order] = label
    _, back = np.unique(out, return_inverse=True)
    lowest = np.full(m, m)
    np.minimum.at(lowest, back, np.arange(m))
    return lowest[back]


def components(keyed: DataFrame, shingle: int = 5, least: float = 0.8, weight: int = 1 << 20) -> DataFrame:
    """_key, component for each row of keyed(_key, text); ``weight`` shingles or so make a block."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text"):  # one set at a time
                found = shingles(text.as_py(), shingle)
                for column, x in zip(columns, (class_id(found), len(found), bands(found)), strict=True):
                    column.append(x)
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *made], ["_key", "class", "n", "bands"])
        common.tidy()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), shingle).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(found, pa.list_(pa.int64()))], ["_key", "items"])
        common.tidy()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = batch.column("items"), batch.column("lead")
            like = [similar(*(x[i].values.to_numpy().view(np.uint64) for x in (own, first)), least) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("leader"), batch.column("component"), batch.column("n"), pa.array(like, pa.bool_())], ["class", "leader", "component", "n", "core"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held, flags = None, [], [], []

        def finish() -> pa.RecordBatch:
            root = links(held, least, np.array(flags, bool))
            known = np.array(ids, np.int64)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[root[moved]])], ["a", "b"])

        for batch in batches:
            items = batch.column("items")
            for at, (*here, one, core) in enumerate(common.rows_of(batch, "component", "i", "j", "class", "core")):
                if here != cell:
                    if len(ids) > 1:
                        yield finish()
                    cell, ids, held, flags = here, [], [], []
                ids.append(one)
                flags.append(core)
                held.append(items[at].values.to_numpy().view(np.uint64).copy())
        if len(ids) > 1:
            yield finish()
        held.clear()
        common.tidy()

    texts = keyed.select("_key", common.text_bytes())
    signed, _ = common.save(texts.mapInArrow(sign, "_key long, class long, n long, bands array<long>"))
    one = signed.groupBy("class").agg(F.min_by(F.struct("_key", "n", "bands"), "_key").alias("x"))
    classes, _ = common.save(one.select("class", "x._key", "x.n", "x.bands"))
    banded = classes.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    met = graph.components(banded.join(shared, "band").where("class > low").select(F.col("class").alias("a"), F.col("low").alias("b")))
    met = classes.select("class", "_key", "n").join(met.select(F.col("id").alias("class"), "component"), "class")
    met, _ = common.save(met)
    dealt = texts.join(met.select("_key"), "_key", "left_semi").mapInArrow(sets, "_key long, items array<long>")
    member_sets, _ = common.save(dealt.join(met, "_key").select("class", "component", "n", "items"))
    first = met.groupBy("component").agg(F.min("class").alias("leader"))
    leaders, _ = common.save(member_sets.join(first.select(F.col("leader").alias("class"), F.col("leader")), "class").select("component", "leader", F.col("items").alias("lead")))
    told, _ = common.save(member_sets.join(leaders, "component").mapInArrow(lead, "class long, leader long, component long, n long, core boolean"))
    star = told.where("core and class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b"))
    sums = told.groupBy("component").agg(*(F.ceil(F.sum(F.when(F.col("core") == core, F.col("n"))) / F.lit(weight)).cast("int").alias(name) for name, core in (("cores", True), ("rests", False))), F.sum("n").alias("all"))
    open_ = sums.where("rests > 0").withColumn("one", F.col("all") <= weight)
    members, _ = common.save(told.join(open_, "component").select("class", "core", "one", "cores", "rests"))
    # with several blocks each pair of them that isn't all linked is a cell, which also tests the pairs within both
    mixed_ = F.xxhash64("class")
    block = F.when(F.col("one"), F.lit(0)).when(F.col("core"), F.pmod(mixed_, F.col("cores"))).otherwise(F.col("cores") + F.pmod(mixed_, F.col("rests"))).cast("int")
    every = F.sequence(F.when(F.col("core"), F.col("cores")).otherwise(F.lit(0)), F.col("cores") + F.col("rests") - 1)
    others = F.when(F.col("one"), F.array(F.lit(0))).otherwise(F.filter(every, lambda x: x != F.col("block")))
    dealt = members.withColumn("block", block).withColumn("others", others).join(member_sets, "class")
    dealt = dealt.select("class", "core", "component", "block", "items", F.explode("others").alias("other"))
    dealt = dealt.select("class", "core", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "items")
    cells = dealt.repartition(common.parallel(keyed.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    edges = star.union(cells.mapInArrow(test, "a long, b long"))
    linked = graph.components(edges)
    return signed.select("_key", "class").join(linked, signed["class"] == linked.id, "left").select("_key", F.coalesce("component", "class").alias("component"))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int | None = None) -> DataFrame:
    """docs without near-duplicates: the least row of each component stays. radius: rows whose SimHash fingerprints differ in so many bits or
    fewer are linked, too, and components are those of both kinds of links."""
    rows, told = common.with_keys(docs)
    found = components(told, shingle, least)
    if radius is not None:
        prints, _ = common.save(simhash.fingerprints(told, shingle, "_key"))
        near = prints.join(simhash.components(prints.withColumnRenamed("_key", "doc_id"), radius), "fp").select("_key", F.col("component_id").alias("first"))
        alike = found.join(found.groupBy("component").agg(F.min("_key").alias("first")), "component").select("_key", "first")
        linked = graph.components(near.union(alike).select(F.col("_key").alias("a"), F.col("first").alias("b")))
        found = told.select("_key").join(linked.withColumnRenamed("id", "_key"), "_key", "left").select("_key", F.coalesce("component", "_key").alias("component"))
    return common.least_rows(rows, told, found)
