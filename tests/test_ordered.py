"""As-of joins, neighbours and numbering by buckets: the same rows as whole windows give, in even tasks, with bursts."""

import random

from pyspark.sql import functions as F
from tracewright.functions import bits, expr
from tracewright.operators import ordered, trace


def burst(n, seed=3):
    """Times with pauses and with one place that a third of all rows share."""
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += 0 if n // 3 < i < 2 * n // 3 else r.choice([0, 1, 3, 5000 if i % 97 == 0 else 1])
        out.append(t)
    return out


def test_as_of_with_bursts(spark):
    times = burst(900)
    points = spark.createDataFrame([(k, t, i) for k in "ab" for i, t in enumerate(times)] + [("none", 5, 0)], "k string, t long, i long")
    marks = [(k, t, n) for k in "ab" for n, t in enumerate(sorted(set(times[:: 7 if k == "a" else 40])))]
    df = spark.createDataFrame(marks, "k string, t long, v long")
    for before in (False, True):
        want = {(k, i): max((v for q, m, v in marks if q == k and (m < t if before else m <= t)), default=None) for k in "ab" for i, t in enumerate(times)} | {("none", 0): None}
        for crowd in (5, 60, 1 << 20):
            got = ordered.as_of(points, df, ["k"], "t", "v", before=before, crowd=crowd).collect()
            assert len(got) == len(want) and {(r.k, r.i): r.v for r in got} == want
    assert ordered.as_of(points, df.limit(0), ["k"], "t", "v").where("v is not null").count() == 0 and ordered.as_of(points.limit(0), df, ["k"], "t", "v").count() == 0


def test_neighbours_of_busy_groups(spark):
    r = random.Random(1)
    rows = [("busy", t, i, r.choice(["0", "1", None])) for i, t in enumerate(burst(600))] + [(f"s{i % 9}", i, i, str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string")
    for after in (False, True):
        whole, parts = ({(x.k, x.i): x._beside and x._beside.v for x in ordered.beside(df, ["k"], ["t", "i"], ["v"], after=after, crowd=c).collect()} for c in (1 << 20, 50))
        want = {}
        for k in {x[0] for x in rows}:
            mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]), reverse=after)
            want |= {(k, x[2]): before and before[3] for before, x in zip([None, *mine], mine, strict=False)}
        assert whole == parts == want


def test_buckets_are_even(spark):
    """One trace, edges in one short stretch of its time: rows of the buckets still are about as many."""
    clock = spark.range(40000).select(F.lit("t").alias("trace_id"), F.when(F.col("id") < 39000, F.col("id")).otherwise(F.col("id") * 10000).alias("t"))
    cut = ordered.cuts(clock, "t", 4000)
    sizes = sorted(r["count"] for r in ordered.placed(clock, "t", cut).groupBy("_b").count().collect())
    assert len(sizes) == 10 and sizes[-1] < 1.5 * sizes[0]


def test_trace_operators_in_small_buckets(spark, monkeypatch):
    r = random.Random(5)
    rows = [("t", f"s{r.randint(0, 2)}", t, i, r.choice(["0", "1", "x"])) for i, t in enumerate(burst(500))]
    changes = spark.createDataFrame(rows, "trace_id string, signal string, t long, seq long, value string")
    edges = trace.clock_edges(changes.where("signal = 's0'").select("trace_id", "t", "seq", "value"))

    def every():
        runs = trace.cycle_runs(changes, edges)
        found = [runs, trace.start_runs(changes, edges), trace.transitions(changes, edges), trace.run_changes(runs), trace.value_changes(trace.cycle_values(changes, edges)), trace.fail_cycle(changes, edges)]
        return [sorted(map(str, df.collect())) for df in found]

    whole = every()
    near = ordered.beside
    monkeypatch.setattr(ordered, "beside", lambda *a, **k: near(*a, **{**k, "crowd": 20}))
    assert every() == whole and all(whole)


def test_wide_vectors(spark):
    r = random.Random(1)
    rows = []
    for n in (1, 4, 24, 25, 31, 32, 60, 64, 65, 130, 200):
        for m in (n, max(1, n // 2), n + 3):
            rows.append(tuple("".join(r.choice("01") for _ in range(k)) for k in (n, m)))
        rows += [("1" * n, "1" * n), ("1" * n, "0" * n), ("0" * n, "1"), ("1" * n, "11"), ("x" + "1" * n, "1"), ("1" * n, f"{n - 1:b}")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    told = {op: bits.arithmetic(a, op, b) for op in ("+", "-", "*", "/", "%", "<<", ">>", "<<<", ">>>")} | {op: bits.compare(a, op, b) for op in ("<", ">", "<=", ">=")}
    for x in df.select("a", "b", bits.negate(a).alias("neg"), *(c.alias(op) for op, c in told.items())).collect():
        assert {op: x[op] for op in told} == {op: expr.run((op, ("literal", x.a), ("literal", x.b)), {}) for op in told}
        assert x.neg == expr.run(("u-", ("literal", x.a)), {})


def test_operators_on_whole_columns(spark):
    """Wide operators go by whole columns and agree with the Columns; unknown bits and zero divisors give null."""
    r = random.Random(2)
    pairs = [tuple("".join(r.choice("01") for _ in range(n)) for n in (k, max(1, k - 3))) for k in (4, 60, 64, 200)] + [("1" * 200, "0"), ("x1", "11"), (None, "1"), ("1" * 200, "1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for op in ("+", "-", "*", "/", "%"):
        told = df.select(expr.operator_udf(op)("a", "b").alias("x"), bits.arithmetic(F.col("a"), op, F.col("b")).alias("y")).collect()
        assert [x.x for x in told] == [x.y for x in told]
    assert all(x.x == x.y for x in df.select(expr.operator_udf("u-")("a").alias("x"), bits.negate(F.col("a")).alias("y")).collect())


def test_division_of_long_runs(spark):
    """Divisors whose first limbs mislead a quotient's guess, and a division of 4000 bits, which bit by bit takes minutes."""
    ones, high = "1" * 24, "1" + "0" * 23
    rows = [(high + "0" * 47 + "1", high + "0" * 23 + "1"), (ones * 3, ones * 2), (ones + "0" * 48, ones + ones), ("0" + ones * 3, high + ones), ("10" * 2000, "1101" * 500), ("1" * 4000, "11")]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.select("a", "b", *(bits.arithmetic(F.col("a"), op, F.col("b")).alias(op) for op in "/%")).collect():
        n = max(len(x.a), len(x.b))
        told = divmod(int(x.a, 2), int(x.b, 2))
        assert (x["/"], x["%"]) == tuple(f"{v:b}".zfill(n) for v in told)


def test_find_signal_by_its_index(spark):
    names = ["top.View", "top.u.preview_x", "VIE", "vi", "top.viewview", "ew.vie", "", "tÖp.öx"]
    df = spark.createDataFrame([("t", n) for n in names], "trace_id string, signal string")
    index = trace.name_index(df)
    for pattern in ("VIEW", "vi", "view", "viewview", "öx", "TÖP", "nothing", "", ".v"):
        plain, told = ([r.signal for r in trace.find_signal(df, pattern, 5, i).collect()] for i in (None, index))
        assert plain == told
    assert [r.signal for r in trace.find_signal(df, "view", 2, index).collect()] == ["top.View", "top.u.preview_x"]
