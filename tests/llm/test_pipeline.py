"""The pipeline as a whole against a plain version that works on lists.

Model fitting, the tokenizer and the random offsets of the mix are inputs of the plain version; what the
stages decide from them is computed apart: rows kept, groups, masks, copies and pieces.
"""

import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline
from tracewright.llm import packing, quality

SOURCES = ("books", "code", "web", None)


def fixture():
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(" ".join(r.choices(vocabulary, k=9)).capitalize() + "." for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        good = i % 4 != 3
        text = prose(r.randint(2, 14)) if good else " ".join(r.choices(["BUY", "$$$", "!!!", "||", "999", "CLICK"], k=r.randint(5, 80)))
        rows.append((i, text, "en", SOURCES[i * i % 4 if i % 5 else 2], len(text)))
        if i % 2 == 0 or not good:
            labels.append((i, int(good), 0))
    first = [t for _, t, *_ in rows]
    long = prose(900)
    rows += [(200, first[0], "en", "web", 1), (201, first[0], "en", "code", 1), (202, None, None, "web", 0), (203, "", "en", "web", 0), (204, long, "en", "books", 1), (205, long + " tail", "en", "web", 1)]
    rows += [(206, prose(6) + " mail a.b@example.org or +49 30 123-4567. " + prose(2), "en", "web", 1), (207, "Call " + prose(8) + " 192.168.0.1, 4111 1111 1111 1111. Émile.", "fr", None, 1)]
    return rows, labels


def offset_of(spark, source):
    row = spark.createDataFrame([(source,)], "s string").selectExpr("pmod(xxhash64(42, s is null, coalesce(s, '')), 1048576) / 1048576D as x").first()
    return row.x


def salts_of(spark, pairs):
    """(id, size) -> hash part."""
    told = spark.createDataFrame(sorted(pairs), "i long, n long").selectExpr("i", "n", "pmod(xxhash64(42, i, n), 64) as x")
    return {(r.i, r.n): r.x for r in told.collect()}


def shingles(text):
    words = [w.lower() for w in brute.words(text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain(spark, rows, labels, offset):
    crc = lambda d: zlib.crc32(str(d).encode()) % 3
    look = lambda t: quality.features((t or "").encode())
    trusted = {d for d, q, _ in labels if q == 1 and crc(d) != 1}
    model = quality.fit(np.array([look(t) for d, t, *_ in rows if d in trusted]), np.array([look(t) for d, t, *_ in rows if crc(d) != 1]))
    scores = model.score(np.array([look(t) for _, t, *_ in rows]))
    rows = [x for x, s in zip(rows, scores) if s >= 0.5]

    sets = [shingles(t) for _, t, *_ in rows]
    root = brute.roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    rows = [x for i, x in enumerate(rows) if x[0] == min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])]

    masked = []
    for d, t, lang, source, n in rows:
        out, at = "", 0
        for a, b, kind in sorted((a, b, k) for k, a, b in brute.base_spans(t)):
            if a >= at:
                out += t[at:a] + f"<{kind}>"
            at = max(at, b)
        masked.append((d, t if t is None else out + t[at:], source))

    sizes = Counter()
    for d, t, source in masked:
        sizes[source] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:  # what is above twice its size stops there, the rest is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    taken = Counter()
    salt = salts_of(spark, {(d, len(brute.words(t))) for d, t, _ in masked})
    for s in order:
        size = {d: len(brute.words(t)) for d, t, x in masked if x == s}
        line = sorted(size, key=lambda d: (math.floor(math.log2(size[d] + 1) * 4), salt[d, size[d]], size[d], d))
        rate = target[s] / sizes[s] if sizes[s] else 0
        for k, d in enumerate(line):
            taken[d] = math.floor((k + 1) * rate + offset[s]) - math.floor(k * rate + offset[s])

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    pieces = Counter()
    for d, t, _ in masked:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            if taken[d]:
                pieces[d, piece, at, len(part), zlib.crc32(part.tobytes())] += taken[d]
    return pieces


def test_pipeline(spark, tmp_path):
    rows, labels = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(spark, rows, labels, {s: offset_of(spark, s) for s in SOURCES})
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ids = {r.doc_id for r in got}
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert 206 in ids and not ids & {200, 201, 205} and len(ids) > 60 and any(r.piece > 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_stage_returns_the_columns_of_documents(spark, tmp_path):
    rows, labels = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows[:40] + rows[-8:], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_near_copies_at_a_similarity_of_eight_tenths_leave(spark):
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(5000)]

    def sets(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows, want = [], set()
    for i in range(120):
        words = r.choices(vocabulary, k=(100, 100, 400)[i % 3])
        changed = list(words)
        for at in r.sample(range(5, len(words) - 5), (1, 2, 8)[i % 3] + (i % 4 == 3) * len(words) // 30):
            changed[at] = "new%d" % r.randint(0, 999)
        a, b = " ".join(words), " ".join(changed)
        rows += [(2 * i, a), (2 * i + 1, b)]
        x, y = sets(a), sets(b)
        want |= {2 * i} | ({2 * i + 1} if len(x & y) < 0.8 * len(x | y) else set())
    assert 130 < len(want) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(d.doc_id for d in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_near_copies_in_several_blocks(spark):
    from tracewright.llm import common, neardup

    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 200, 5)] + [" ".join(["x%d" % i] + words[:40]) for i in range(30)]
    sets = [neardup.shingles(t.encode(), 5).tolist() for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
    want = brute.roots(len(texts), pairs)
    assert neardup.links([np.array(s, np.uint64) for s in sets], 0.8).tolist() == list(want.values() if isinstance(want, dict) else want)
    keyed = common.save(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_key long, doc_id long, text string"))[0]
    for weight in (1 << 20, 700):
        groups = {}
        for x in neardup.components(keyed, 5, 0.8, weight).collect():
            groups.setdefault(x.component, []).append(x._key)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in range(len(texts)) if want[i] == root) for root in {want[i] for i in range(len(texts))})
