"""The Merkle manifest against a plain one, with trees of several rounds, crowded ids and awkward rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tracewright.llm import common, manifest, ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(digests):
    """(root, the siblings of each leaf level by level as (run, place))."""
    paths, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 16):
            run = level[at : at + 16]
            for place, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(([d for d, _ in run], place))
            above.append((h(*(d for d, _ in run)), [i for _, below in run for i in below]))
        level = above
    return level[0][0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([d for _, _, d in sorted((r[0] is not None, r[0] or 0, leaf(r, r[1])) for r in by[s])]) for s in names}
    root, above = tree([subs[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        told = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r) for r in by[s]) if all(None not in r for r in by[s]) else sorted((((r[0] is not None, r[0] or 0, leaf(r, r[1])), r) for r in by[s]), key=lambda x: x[0])
        for ((_, _, d), r), path in zip(told, subs[s][1], strict=True):
            path = path + above[k]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low = None if r[1] is None else r[1].translate({c: c + 32 for c in range(65, 91)})
            own = leaf(r, low) if cut else d
            for run, place in path:
                own = h(*run[:place], own, *run[place + 1 :])
            out.append((r[0], d, subs[s][0], root, h(*(x for run, place in path for i, x in enumerate(run) if i != place)), own, own == root))
    return sorted(out, key=str)


def audited(df):
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted((tuple(r) for r in manifest.audit(df, cut).collect()), key=str)


def table(seed, n, sources, ids):
    r = random.Random(seed)
    return [(ids(r), r.choice([None, "", "plain", "Has Upper É", "x" * r.randint(1, 60)]), r.choice(["en", None]), r.choice(sources), r.choice([None, r.randint(0, 99)])) for _ in range(n)]


@pytest.mark.parametrize("sources", [["a"], [None, "", "-", ":", "é", "zz", "a", "A"], ["s%d" % i for i in range(40)]])
def test_manifest(spark, sources):
    rows = table(1, 700, sources, lambda r: r.choice([None, r.randint(-50, 50), r.randint(-(1 << 63), (1 << 63) - 1), r.randint(0, 9000)]))
    rows += rows[:9]
    assert audited(spark.createDataFrame(rows, DOCS).repartition(5)) == plain(rows)


def test_trees_of_several_rounds(spark, monkeypatch):
    """One digit a round, as if trees were 4096 times as large; places of ids by many digits."""
    monkeypatch.setattr(manifest, "DEEP", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = table(2, 900, ["a", "a", "a", "b", None] + ["c%d" % i for i in range(20)], lambda r: r.randint(-(1 << 40), 1 << 40))
    got = audited(spark.createDataFrame(rows, DOCS))
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}


def test_awkward_manifests(spark):
    one = [(7, "Only One", None, None, None)]
    found = audited(spark.createDataFrame(one, DOCS))
    assert found == plain(one) and found[0][1] == found[0][2] == found[0][3] and found[0][4] == h()
    named = spark.createDataFrame(one * 40 + [(i, "T" * 200000, "x", "s", 1) for i in range(3)], DOCS)
    clash = named.withColumns({c: F.lit("own") for c in ("leaf", "root", "path", "_tree", "_key", "kids", "digest", "_at", "after", "verified")})
    assert audited(clash) == audited(named) == plain([tuple(r) for r in named.collect()])
    assert audited(named.limit(0)) == []


def test_ranks_of_crowded_ids(spark):
    """One id holds most rows, most of them equal."""
    r = random.Random(4)
    rows = [(k, r.choice([None, 5, 5, 5, 5, 6, r.randint(-(1 << 60), 1 << 60)]), "%03x" % r.choice([1, 1, 1, r.randint(0, 4095)])) for k in ("p", "q") for _ in range(1500)]
    df, _ = common.save(spark.createDataFrame(rows, "k string, i long, tie string").repartition(4).withColumn("_key", F.monotonically_increasing_id()))
    for crowd in (20, 1 << 16):
        found, most = ranks.ranked(df, ["k"], "i", "tie", crowd=crowd)
        got = found.collect()
        assert most == 1500 and {x._size for x in got} == {1500}
        for k in ("p", "q"):
            told = [(x.i is not None, x.i or 0, x.tie) for x in sorted((x for x in got if x.k == k), key=lambda x: x._rank)]
            assert told == sorted((i is not None, i or 0, t) for n, i, t in rows if n == k)
            assert [x._rank for x in sorted((x for x in got if x.k == k), key=lambda x: x._rank)] == list(range(1500))
