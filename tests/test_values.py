"""Values at asked cycles, from runs, against all samples written out."""

import random

from pyspark.sql import functions as F
from tracewright.operators import trace
from tracewright.plans import build


def test_values_at_points(spark):
    r = random.Random(3)
    rows = [(k, f"s{r.randint(0, 4)}", r.randint(40 if k == "q" else 0, 400), i, r.choice(["00", "01", "1x"])) for k in ("p", "q") for i in range(120)]
    changes = spark.createDataFrame(rows, "trace_id string, signal string, t long, seq long, value string")
    edges = spark.createDataFrame([(k, c, c * 10) for k in ("p", "q") for c in range(40)], "trace_id string, cycle long, t_start long")
    every = {(x.trace_id, x.signal, x.cycle): (x.value, x.before) for x in build.with_before(trace.cycle_values(changes, edges)).collect()}
    asked = [(k, f"s{n}", c) for k in ("p", "q", "none") for n in range(6) for c in (-1, 0, 1, 2, 3, 7, 20, 38, 39, 40, 99)]
    points = spark.createDataFrame(asked + asked[:9], "trace_id string, signal string, cycle int")
    got = build.values_at(points, trace.cycle_runs(changes, edges)).collect()
    assert {(x.trace_id, x.signal, x.cycle): (x.value, x.before) for x in got} == {k: v for k, v in every.items() if k in set(asked)}
    assert len(got) == len({(x.trace_id, x.signal, x.cycle) for x in got}) > 60


def test_graph_of_runs_is_that_of_samples(spark):
    """A window property, its trigger and its slice, judged from runs and from samples."""
    said = "a |-> ##[1:2] ack"
    deps = spark.createDataFrame([(1, "T.prop", "T.a", "assertion", said, "@(posedge clock)"), (2, "T.prop", "T.ack", "assertion", said, "@(posedge clock)"), (3, "T.ack", "T.gate", "sequential", "T.gate & 1'b1", ""), (4, "T.gate", "T.in", "combinational", "", "")], "dep_id long, target string, source string, dep_type string, expression string, condition string")
    moves = [("T.a", 2, "1"), ("T.a", 3, "0"), ("T.ack", 0, "0"), ("T.gate", 1, "0"), ("T.gate", 3, "1"), ("T.in", 3, "1"), ("T.prop", 0, "1"), ("T.prop", 5, "0")]
    changes = spark.createDataFrame([("t", s, c * 10 + 1, i, v) for i, (s, c, v) in enumerate(moves)], "trace_id string, signal string, t long, seq long, value string")
    edges = spark.createDataFrame([("t", c, c * 10) for c in range(7)], "trace_id string, cycle long, t_start long")
    ends = spark.createDataFrame([("t", "T.prop", 5)], "trace_id string, signal string, cycle long")
    found = []
    for samples, runs in ((trace.cycle_values(changes, edges), None), (None, trace.cycle_runs(changes, edges))):
        graph, windows, _ = build.assertion_graph(deps, samples, ends, runs=runs)
        found.append([sorted(map(str, df.collect())) for df in (graph.nodes, graph.edges, windows)])
    assert found[0] == found[1] and len(found[0][0]) > 3 and len(found[0][1]) > 2
