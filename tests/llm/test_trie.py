"""The prefix trie against a plain one: random forests, growing logs, long and turnless conversations, awkward rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tracewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def token(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest(), role, text


def built(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, *token(role, text)))
    own = {c: [x[3:] for x in sorted(told)] for c, told in by.items()}
    out = {}
    for c, told in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        start = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(start, [])[:h] + told[h:]
    return out


def plain(rows):
    convs = built(rows)
    members = {}
    for c, told in convs.items():
        for d in range(len(told) + 1):
            members.setdefault(tuple(told[:d]), []).append(c)
    kids = {k: 0 for k in members}
    saved, leaves = dict(kids), dict(kids)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def found(df):
    return sorted(tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.turns_of(df))).collect())


def test_random_conversations(spark, monkeypatch):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "a", "é💡", "b " * 9])) for c in [*range(-3, 60), *range(97, 130), 205, 30000] for t in r.sample(range(50), r.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (7, None, "user", "n"), (7, None, "user", "n"), (8, 3, None, "\x00odd"), (100, None, "user", None)] + rows[:20]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df) == plain(rows)
    monkeypatch.setattr(trie, "NEAR", 1)  # stretches of two places and of two ids
    assert found(df) == plain(rows)


def test_logs_that_grow_and_copies(spark):
    """Each conversation is the one before and a turn more; many copies of one; a long one."""
    ids = iter([c for c in range(1, 4000) if zlib.crc32(str(c).encode()) % 6 == 0])
    rows = [(c, t, "user", f"t{t}") for n in range(1, 25) for c in [next(ids)] for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in (next(ids) for _ in range(300)) for t in range(3)]
    rows += [(c, t, "user", f"long {t}") for c in [next(ids)] for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(rows)
    nodes = trie.nodes_of(*trie.rebuilt(trie.turns_of(df)))
    assert nodes.select("owner").distinct().count() <= 4  # peeled in a round or two


def test_rounds_of_peeling(spark):
    """A chain of stretches and a star."""
    rows = [(i, i - 1 if i else None, 0, 1, 1) for i in range(6)] + [(10 + i, 3, 2, 5, 1) for i in range(4)]
    got = {r.unit: (r.saved, r.leaves) for r in trie.peeled(spark.createDataFrame(rows, "unit long, parent long, at long, saved long, leaves long")).collect()}
    assert got == {0: (26, 10), 1: (25, 9), 2: (24, 8), 3: (23, 7), 4: (2, 2), 5: (1, 1)} | {10 + i: (5, 1) for i in range(4)}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(6, 0, "user", "alone")], [(c, None, None, None) for c in (0, 0, 1, 101, 250, 250)]])
def test_awkward_conversations(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("own") for c in ("token", "_key", "place", "length", "owner", "key", "depth", "saved", "weight", "turns")})
    assert found(clash) == found(df) == plain(rows)


def test_long_texts(spark):
    rows = [(c, t, "user" * 50000, "x" * 300000) for c in (0, 200) for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
