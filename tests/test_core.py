"""Facts about the trace, expression and design operators."""

from pyspark.sql import functions as F
from tracewright.functions import bits
from tracewright.functions.expr import compared_literal, evaluate
from tracewright.operators import names, slicer, sva, trace
from tracewright.plans import analyse, build, report
from tracewright.sources import rtl, vcd

ENV = {"a": "1010", "b": "0011", "sel": "1", "u": "1x0z"}


def test_expressions():
    facts = {"a & b": "0010", "a | b": "1011", "sel ? a : b": "1010", "{a, b}": "10100011", "a + b": "1101", "b - a": "1001", "a / (b - b)": None,
             "!u": "1", "~u": "0x1z", "-b": "1101", "&a": "0", "|a": "1", "^b": "0", "4'hf": "1111", "a == 4'b1010": "1", "u == u": "1", "a < u": None,
             "a << 1": "0100", "a >>> 1": "0101", "missing": None, "a &": None, "": None, "sel |-> ##[1:20] b == 4'd3": "1", "!sel |-> missing": "1", "sel |-> missing": "0"}
    assert {k: evaluate(k, ENV) for k in facts} == facts


def test_selects():
    assert evaluate("a[3] & a[1:0]", ENV) is None  # a name of its own by default
    facts = {"a[3]": "1", "a[1:0]": "10", "a[9]": None, "a[0] |-> missing": "1", "{b[1], sel} == 2'b11": "1"}
    assert {k: evaluate(k, ENV, selects=True) for k in facts} == facts
    assert compared_literal("x && s == 4'd5", "s") == "0101" and compared_literal("3 == s", "s") == "11" and compared_literal("s == t", "s") is None


def test_causal_graph(spark):
    deps = spark.createDataFrame([(1, "fail", "state", "assertion", "state == 4'd5", "@(posedge clock)"), (2, "fail", "quiet", "combinational", "", ""), (3, "state", "next", "sequential", "next & 4'b0011", ""), (4, "next", "deep", "combinational", "deep ? 4'b1 : 4'b1", ""), (5, "fail", "gone", "combinational", "gone", "")],
                                 "dep_id long, target string, source string, dep_type string, expression string, condition string")
    values = {"fail": "01", "state": ("0101", "0111"), "quiet": "01", "next": ("0001", "0001"), "deep": "11"}
    samples = spark.createDataFrame([("t", s, c, v) for s, many in values.items() for c, v in enumerate(many)], "trace_id string, signal string, cycle int, value string")
    seeds = spark.createDataFrame([("t", "fail", 1)], "trace_id string, signal string, cycle int")
    nodes, edges, _ = build.causal_graph(deps, samples, seeds, max_depth=4)
    got = {r.source: (r.source_cycle, r.type, r.score) for r in edges.collect()}
    # the literal is tried for state; quiet toggles with fail; gone has no value; deep changes nothing and is too deep for structure alone
    assert got == {"state": (1, "conditional", 1.0), "quiet": (1, "toggle", 0.7), "gone": (1, "expr_eval", 0.3), "next": (0, "state", 1.0)}
    told = {r.signal: r for r in nodes.collect()}
    # deep is what only a rejected edge leads from
    assert {s for s, r in told.items() if r.is_root} == {"quiet", "gone", "next", "deep"} and [s for s, r in told.items() if r.is_orphan] == ["deep"] and told["fail"].is_endpoint
    shown = {r.source: r.example for r in edges.collect()}
    assert shown["state"].type == "counterfactual" and shown["state"].target_original != shown["state"].target_perturbed and shown["quiet"].type == "toggle_correlation" and shown["gone"].type == "structural"
    assert (shown["quiet"].source_before, shown["quiet"].target_after) == ("0", "1") and next(r.evidence.expression for r in edges.collect() if r.source == "state") == "state == 4'd5"
    assert told["fail"].is_endpoint and told["gone"].value == "x"
    assert told["quiet"].suspect_score == 0.7 * 0.9 and told["fail"].suspect_score == 1.0 and told["gone"].rtl_missing
    import json

    document = json.loads(report.json_documents(nodes, edges).first().document)
    assert document["meta"] == {"total_nodes": 6, "total_edges": 4, "root_nodes": 4} and document["edges"][0]["change_examples"] and document["nodes"][0]["signal"] == "fail"
    lines = [r.line for r in report.graph_lines(nodes, edges).orderBy("part", "line").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and any(r"toggle\n0.70" in x and "color=green, penwidth=2.40" in x for x in lines)
    wanted = spark.createDataFrame([("t", told["state"].id), ("t", "nothing")], "trace_id string, id string")
    found = {r.id: r for r in report.evidence(nodes, edges, wanted).collect()}
    assert len(found[told["state"].id].incoming) == 1 and len(found[told["state"].id].outgoing) == 1 and not found["nothing"].found
    said = [r.line for r in report.summary_lines(nodes, edges, build.statistics(nodes, edges)).orderBy("part", "place").collect()]
    assert said[0] == "- Total nodes: 6" and said[5].startswith("1. `next` @ cycle 0 = 0001 (score: 0.90)")
    none_n, none_e, _ = build.causal_graph(deps.limit(0), samples, seeds)
    assert none_n.count() == 1 and none_e.count() == 0


def test_antecedent_and_windows(spark):
    deps = spark.createDataFrame([(1, "prop", "a", "assertion", "a |-> ##[1:9] b", "")], "dep_id long, target string, source string, dep_type string, expression string, condition string")
    samples = spark.createDataFrame([("t", "prop", 3, "0"), ("t", "a", 3, "x"), ("t", "b", 3, "0")], "trace_id string, signal string, cycle int, value string")
    seeds = spark.createDataFrame([("t", "prop", 3)], "trace_id string, signal string, cycle int")
    triggers = spark.createDataFrame([("t", 3)], "trace_id string, trigger_cycle int")
    assert build.causal_graph(deps, samples, seeds, triggers=triggers).edges.first().score == 0.85
    windows = spark.createDataFrame([("t", "prop", 2, 1, 4, 9)], "trace_id string, endpoint string, trigger int, least int, most int, fail int")
    consequents = spark.createDataFrame([("t", "still")], "trace_id string, signal string")
    moved = spark.createDataFrame([("t", "other", 4)], "trace_id string, signal string, cycle int")
    starts, edges = sva.window_graph(windows, consequents, moved)
    assert {(r.source, r.source_cycle, r.target_cycle, r.score) for r in edges.collect()} == {("still", 3, 9, 0.8), ("still", 6, 9, 0.8), ("prop", 2, 9, 1.0)} and starts.count() == 3
    names_ = spark.createDataFrame([("t", "top.fail_b"), ("t", "top.my_assert"), ("u", "top.error"), ("v", "top.q")], "trace_id string, signal string")
    assert {tuple(r) for r in build.endpoint_by_keyword(names_).collect()} == {("t", "top.my_assert"), ("u", "top.error")}


def test_bits(spark):
    df = spark.createDataFrame([("1010", "1011"), ("1010", "1010"), ("x1", "0"), ("", "1"), (None, "1"), ("11", "0011")], "a string, b string")
    got = df.select(bits.values_differ(F.col("a"), F.col("b")), bits.parse_binary(F.col("a")), bits.invert(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(True, 10, "0101"), (False, 10, "0101"), (True, None, "x0"), (False, None, ""), (False, None, None), (False, 3, "00")]
    both = df.where("a <> ''").select(bits.bit_and(F.col("a"), F.col("b")), bits.bit_or(F.col("a"), F.col("b")), bits.bit_xor(F.col("a"), F.col("b"))).first()
    assert tuple(both) == ("1010", "1011", "0001")


def _changes(spark, rows):
    return spark.createDataFrame([("t", s, t, i, v) for i, (s, t, v) in enumerate(rows)], "trace_id string, signal string, t long, seq long, value string")


def test_cycles(spark):
    clock = _changes(spark, [("c", 0, "1"), ("c", 5, "0"), ("c", 10, "1"), ("c", 15, "z"), ("c", 20, "1"), ("c", 25, "x"), ("c", 30, "1")])
    edges = trace.clock_edges(clock)
    assert [(r.cycle, r.t_start) for r in edges.orderBy("cycle").collect()] == [(0, 0), (1, 10), (2, 30)]  # z to 1 is no edge
    changes = _changes(spark, [("s", 0, "0"), ("s", 9, "1"), ("s", 10, "0"), ("late", 31, "1")])
    got = {(r.signal, r.cycle): r.value for r in trace.cycle_values(changes, edges).collect()}
    assert got == {("s", 0): "1", ("s", 1): "0", ("s", 2): "0", ("late", 0): "x", ("late", 1): "x", ("late", 2): "1"}
    moved = trace.transitions(changes, edges).collect()
    assert sorted((r.t, r.cycle, r.old_value, r.new_value) for r in moved) == [(9, 0, "0", "1"), (10, 1, "1", "0")]
    assert trace.fail_cycle(changes.where("signal = 's'"), edges).first().cycle == 1
    signals = spark.createDataFrame([("t", "top.a.clk"), ("t", "top.clock"), ("t", "clk")], "trace_id string, signal string")
    assert trace.detect_clock(signals).first().signal == "top.clock"


def test_slice(spark):
    deps = spark.createDataFrame([(1, "fail", "req", "assertion"), (2, "fail", "ack", "assertion"), (3, "req", "deep", "sequential"), (4, "req", "req", "sequential"), (5, "req", "reset", "combinational")], "dep_id long, target string, source string, dep_type string")
    seeds = spark.createDataFrame([("t", "fail", 1)], "trace_id string, signal string, cycle int")
    nodes, edges, _ = slicer.backward_slice(deps, seeds)
    assert sorted((r.signal, r.cycle, r.depth) for r in nodes.collect()) == [("ack", 1, 1), ("deep", 0, 2), ("fail", 1, 0), ("req", 1, 1)]
    assert {(r.source, r.target) for r in edges.collect()} == {("req", "fail"), ("ack", "fail"), ("deep", "req")}
    assert {r.signal for r in slicer.roots(nodes, edges).collect()} == {"ack", "deep"}
    few, kept, cut = slicer.backward_slice(deps, seeds, max_nodes=3)
    assert {(r.source, r.target) for r in kept.collect()} == {("req", "fail"), ("ack", "fail")} and few.count() == 3 and [r.trace_id for r in cut.collect()] == ["t"]
    assert slicer.backward_slice(deps, seeds, max_nodes=4).cut.count() == 0
    stats = build.statistics(nodes.withColumns({"is_root": F.lit(False), "rtl_missing": F.lit(False)}), edges, cut, 1).first()
    assert stats.max_nodes_reached and stats.max_depth_reached


def test_windows(spark):
    df = spark.createDataFrame([("a |-> ##[1:20] (y && q == 3'h1)",), ("a |-> ##4 b",), ("a",)], "s string")
    least, most = sva.time_window(F.col("s"))
    assert [tuple(r) for r in df.select(least, most).collect()] == [(1, 20), (4, 4), (None, None)]
    assert df.select(sva.consequent_signals(F.col("s")).alias("c")).first().c == ["y", "q"]
    truth = spark.createDataFrame([("t", c, h) for c, h in enumerate([True, False, True, True, None, False])], "trace_id string, cycle int, holds boolean")
    assert sva.trigger_cycle(truth).first().trigger_cycle == 2


DESIGN = """
module Child(input clk, input [3:0] in, output [3:0] out);
  assign out = ~in; // comment
endmodule
module Parent(input clock, input en, input [3:0] a, output reg [3:0] y);
  reg [3:0] q;
  wire [3:0] w = a & q;
  Child u (.clk(clock), .in(a), .out(y));
  always @(posedge clock) begin
    if (en) q <= w; else q <= 4'h0;
  end
  my_assert:
    assert property (@(posedge clock) disable iff (~hasBeenReset) a |-> ##[1:20] (y && q));
endmodule
"""


def test_design():
    rows = {(r["source"], r["target"], r["dep_type"]) for r in rtl.parse_design(DESIGN)}
    assert {("a", "u.in", "port_input"), ("u.out", "y", "port_output"), ("w", "q", "sequential"), ("en", "q", "sequential"), ("a", "w", "combinational"), ("q", "w", "combinational"), ("y", "my_assert", "assertion"), ("q", "my_assert", "assertion")} <= rows
    said = next(r for r in rtl.parse_design(DESIGN) if r["target"] == "my_assert")
    assert "##[1:20]" in said["expression"] and "y && q" in said["expression"] and said["condition"] == "@(posedge clock)"
    assert rtl.signals_of("~_controllerA_io_ack | _clientA_io_req") == ["_controllerA_io_ack", "_clientA_io_req"]


ARMS = """module m(input clock, input [7:0] a, b, input en, output reg [3:0] y);
  reg [7:0] q, r;

  wire w = a
    & b;
  always @(posedge clock)
    if (en) q <= a;
    else if (w) q <= b;
    else q <= 8'h0;
  p1:
    assert property (@(posedge clock) disable iff (~hasBeenReset) a |-> y);
  assert property (en);
endmodule
"""


def test_design_details(spark):
    said = {(r["source"], r["target"], r["condition"], r["line"], r["line_end"]) for r in rtl.parse_design(ARMS)}
    # a further arm doesn't carry the negation of the first; the last one negates the first
    assert {("a", "q", "en", 7, 7), ("b", "q", "w", 8, 8), ("en", "q", "!(en)", 9, 9), ("a", "w", "", 4, 5)} <= said
    assert next(r["snippet"] for r in rtl.parse_design(ARMS) if r["target"] == "w") == "  wire w = a\n    & b;"
    assert {(r["name"], r["signal_type"], r["width"]) for r in rtl.signals_in(ARMS)} == {("clock", "in", 1), ("a", "in", 8), ("b", "in", 8), ("en", "in", 1), ("y", "out", 4), ("q", "reg", 8), ("r", "reg", 8), ("w", "reg", 1)}
    assert [(r["label"], r["disable"], r["line"]) for r in rtl.assertions_in(ARMS)] == [("p1", "~hasBeenReset", 10), ("assert_1", "", 12)] and rtl.labels_of(ARMS) == ["p1"]
    texts = spark.createDataFrame([("good.sv", ARMS), ("bad.sv", "module m(input a); p: assert property ((a; endmodule"), ("empty.sv", ""), ("none.sv", None)], "path string, value string")
    assert {r.file for r in rtl.parse_dependencies(texts).select("file").distinct().collect()} == {"good.sv"}
    wanted = spark.createDataFrame([("m", "q"), ("m", "gone")], "module string, signal string")
    told = {r.signal: r for r in names.rtl_context(wanted, rtl.parse_signals(texts), rtl.parse_dependencies(texts)).collect()}
    assert told["q"].found and told["q"].definition.width == 8 and [r.type for r in told["q"].rtl_refs][:2] == ["definition", "sequential"] and not told["gone"].found and told["gone"].rtl_refs == []


def test_precedence():
    env = {"a": "01", "b": "10", "z": "00"}
    # the default table binds | looser than &&, the language standard the other way round
    assert evaluate("a | a && z", env) == "01" and evaluate("a | a && z", env, precedence="ieee") == "0"
    assert evaluate("a & b ^ b", env) == "00" and evaluate("a & b ^ b", env, precedence="ieee") == "10"


def test_vcd(spark, tmp_path):
    path = tmp_path / "one.vcd"
    path.write_text("$scope module top $end\n$var wire 1 ! clk $end\n$var wire 4 # d [3:0] $end\n$upscope $end\n$enddefinitions $end\n#0\n0!\nb1010 #\n#5\n1!\n")
    wide = tmp_path / "wide.vcd"
    wide.write_text("$timescale 1 ns $end\n$scope module top $end\n$var wire 8 ! d $end\n$var real 64 r x $end\n$upscope $end\n$enddefinitions $end\n$comment b1 ! #77 $end\n#3\n$dumpvars\nb1 !\nbx !\nbz01 !\nr1.5 r\n$end\n")
    assert [(r.t, r.value) for r in vcd.read_vcd(spark, str(wide)).orderBy("seq").collect()] == [(3, "00000001"), (3, "xxxxxxxx"), (3, "zzzzzz01"), (3, "1.5")]
    assert [(r.timescale, r.ordinal, r.signal, r.width) for r in vcd.read_headers(spark, str(wide)).orderBy("ordinal").collect()] == [("1ns", 0, "top.d", 8), ("1ns", 1, "top.x", 64)]
    assert {r.signal for r in vcd.read_vcd(spark, str(wide), signals=["top.x"]).collect()} == {"top.x"}
    got = vcd.read_vcd(spark, str(path)).orderBy("seq").collect()
    assert [(r.trace_id, r.signal, r.t, r.value) for r in got] == [("one", "top.clk", 0, "0"), ("one", "top.d [3:0]", 0, "1010"), ("one", "top.clk", 5, "1")]
    assert spark.createDataFrame([("top.d [3:0]",)], "s string").select(names.base(F.col("s"))).first()[0] == "d"


CHECKED = """
module Top(input clock, input req);
  reg busy;
  Unit unit (.clk(clock), .go(req), .done(busy));
  my_assert: assert property (@(posedge clock) req |-> busy);
endmodule
module Unit(input clk, input go, output done);
  assign done = go & ~go;
endmodule
"""
TRACE = """$scope module Top $end
$var wire 1 ! clock $end
$var wire 1 a req $end
$var wire 1 b busy $end
$var wire 1 m my_assert $end
$scope module unit $end
$var wire 1 c clk $end
$var wire 1 g go $end
$var wire 1 d done $end
$upscope $end
$upscope $end
$enddefinitions $end
#0
1!
1c
0a
0g
0b
0d
1m
#5
0!
0c
#10
1!
1c
1a
1g
0m
#15
0!
0c
"""


def test_whole_analysis(spark, tmp_path):
    (tmp_path / "design.sv").write_text(CHECKED)
    for name in ("one", "two"):
        (tmp_path / f"{name}.vcd").write_text(TRACE)
    graph = analyse.analyse(spark, [str(tmp_path / "*.vcd")], [str(tmp_path / "design.sv")])
    assert {tuple(r) for r in graph.endpoints.collect()} == {("one", "Top.my_assert", 1), ("two", "Top.my_assert", 1)}
    got = {(r.source, r.target) for r in graph.edges.where("trace_id = 'one'").collect()}
    assert {("Top.req", "Top.my_assert"), ("Top.busy", "Top.my_assert"), ("Top.unit.done", "Top.busy"), ("Top.unit.go", "Top.unit.done"), ("Top.req", "Top.unit.go")} == got
    analyse.write(graph, str(tmp_path / "out"))
    import glob
    import json

    text = lambda part: "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "out" / part / "trace_id=one" / "*.txt"))))
    assert len(json.loads(text("causal_graph_json"))["edges"]) == 5 and text("causal_graph_dot").startswith("digraph")
    assert text("causal_nodes").split("\n")[0] == report.NODE_HEADER and text("causal_edges").startswith(report.EDGE_HEADER) and "my_assert" in text("summary")
    meta = graph.meta.where("trace_id = 'one'").first()
    assert (meta.endpoint_signal, meta.clock_signal, meta.cycle_count, meta.max_nodes_reached, meta.sva_trigger_cycle) == ("Top.my_assert", "Top.clock", 2, False, 1) and list(meta.asDict())[1:] == list(report.META)
    document = json.loads(text("causal_graph_json"))
    assert document["meta"]["total_edges"] == 5 and document["edges"][0]["evidence"]["file"].endswith("design.sv") and any(n["rtl_refs"] for n in document["nodes"]) and "Tool version" in text("summary")
    (tmp_path / "Top.busy.vcd").write_text(TRACE.replace("1m\n", "1m\n1b\n", 1).replace("#10\n", "#10\n0b\n"))
    (tmp_path / "lost.vcd").write_text(TRACE.replace("clock", "cl0ck").replace("clk", "c1k"))
    more = analyse.analyse(spark, [str(tmp_path / "Top.busy.vcd"), str(tmp_path / "lost.vcd")], [str(tmp_path / "design.sv")])
    assert {tuple(r) for r in more.endpoints.collect()} == {("Top.busy", "Top.busy", 1)} and [r.trace_id for r in more.problems.collect()] == ["lost"]
    import pytest

    with pytest.raises(ValueError, match="lost"):
        analyse.analyse(spark, [str(tmp_path / "lost.vcd")], [str(tmp_path / "design.sv")])
    asked = analyse.analyse(spark, [str(tmp_path / "one.vcd")], [str(tmp_path / "design.sv")], endpoint="Top.busy", cycle=0, clock="Top.clock", max_depth=0)
    assert {(r.source, r.target) for r in asked.edges.collect()} <= {("Top.unit.done", "Top.busy")} and asked.endpoints.first().cycle == 0


def test_depths_are_least_distances(spark):
    import random

    r = random.Random(7)
    rows = [(i, f"s{r.randint(0, 40)}", f"s{r.randint(0, 40)}", r.choice(["sequential", "combinational"])) for i in range(90)]
    deps = spark.createDataFrame(rows, "dep_id long, target string, source string, dep_type string")
    # an endpoint that two traces share at different cycles, and a trace with several
    asked = [("t", "s1", 4), ("u", "s2", 2), ("v", "s1", 1), ("v", "s1", 0), ("u", "s1", 7)]
    seeds = spark.createDataFrame(asked, "trace_id string, signal string, cycle int")
    for most in (0, 1, 4, 20):
        want, links = dict.fromkeys(asked, 0), {}
        front = list(want)
        for depth in range(most + 1):
            fresh = []
            for t, s, c in front:
                for _, target, source, kind in rows:
                    if target == s and source != s:
                        node = (t, source, max(0, c - 1) if kind == "sequential" else c)
                        links.setdefault((node, (t, s, c)), kind)
                        if node not in want:
                            want[node] = depth + 1
                            fresh.append(node)
            front = fresh
        got = slicer.backward_slice(deps, seeds, max_depth=most)
        assert {(x.trace_id, x.signal, x.cycle): x.depth for x in got.nodes.collect()} == want
        found = [((x.trace_id, x.source, x.source_cycle), (x.trace_id, x.target, x.target_cycle)) for x in got.edges.collect()]
        assert len(found) == len(set(found)) and set(found) == set(links)


def test_slice_rules(spark):
    rows = [(1, "T.u.go", "T.go", "port_input"), (2, "T.u.go", "T.hasBeenReset", "combinational"), (3, "T.u.go", "T.x", "combinational"), (4, "T.x", "T.y", "combinational"), (5, "T.y", "T.z", "combinational")]
    deps = spark.createDataFrame(rows, "dep_id long, target string, source string, dep_type string")
    seeds = spark.createDataFrame([("t", "T.u.go", 3)], "trace_id string, signal string, cycle int")
    # equal base names and resets are skipped in any scope; a node at the greatest depth is still expanded
    nodes, edges, _ = slicer.backward_slice(deps, seeds, max_depth=1)
    assert {(r.signal, r.depth) for r in nodes.collect()} == {("T.u.go", 0), ("T.x", 1), ("T.y", 2)} and edges.count() == 2
    later = spark.createDataFrame([("t", "T.y", 2)], "trace_id string, signal string, cycle int")
    nodes, edges, _ = slicer.backward_slice(deps, seeds, later=later, closed=later)
    assert {(r.signal, r.cycle, r.depth) for r in nodes.collect()} == {("T.u.go", 3, 0), ("T.y", 2, 1), ("T.z", 2, 2)} and edges.count() == 1


def test_window_branch(spark):
    said = "a |-> ##[1:2] ack"
    deps = spark.createDataFrame([(1, "T.prop", "T.a", "assertion", said, "@(posedge clock)"), (2, "T.prop", "T.ack", "assertion", said, "@(posedge clock)"), (3, "T.ack", "T.gate", "sequential", "gate & 1'b1", "")],
                                 "dep_id long, target string, source string, dep_type string, expression string, condition string")
    values = {"T.a": "101100", "T.ack": "000000", "T.gate": "000000", "T.prop": "111110"}
    samples = spark.createDataFrame([(t, s, c, v) for t in "tu" for s, many in values.items() for c, v in enumerate(many if t == "t" or s != "T.a" else "000000")], "trace_id string, signal string, cycle int, value string")
    ends = spark.createDataFrame([("t", "T.prop", 5), ("u", "T.prop", 5)], "trace_id string, signal string, cycle int")
    (nodes, edges, _), windows, late_signals = build.assertion_graph(deps, samples, ends)
    assert {tuple(r) for r in late_signals.collect()} == {("t", "T.ack"), ("u", "T.ack")}
    got = {(r.source, r.source_cycle, r.target, r.target_cycle): (r.type, r.score) for r in edges.where("trace_id = 't'").collect()}
    # window [3, 4] and the trigger at 2 lead to the failure; the trigger's causes have their own edges, the failing cycle itself isn't sliced
    late = {("T.ack", 3, "T.prop", 5): ("state", 0.8), ("T.ack", 4, "T.prop", 5): ("state", 0.8), ("T.prop", 2, "T.prop", 5): ("conditional", 1.0)}
    assert late.items() <= got.items() and not [k for k in got if k[2:] == ("T.prop", 5) and k not in late]
    assert {("T.gate", 2, "T.ack", 3), ("T.gate", 3, "T.ack", 4), ("T.a", 2, "T.prop", 2)} <= got.keys()
    told = {(r.signal, r.cycle): r for r in nodes.where("trace_id = 't'").collect()}
    assert told["T.prop", 5].is_endpoint and told["T.ack", 3].suspect_score == 0.0 and told["T.ack", 3].depth == 1 and told["T.gate", 2].is_root and not told["T.prop", 2].is_root
    # no trigger: from the endpoint as ever
    assert {(r.source, r.source_cycle) for r in edges.where("trace_id = 'u' and target = 'T.prop'").collect()} == {("T.a", 5), ("T.ack", 5)}
    assert {(r.trace_id, r.trigger) for r in windows.collect()} == {("t", 2), ("u", None)}
    guess = spark.createDataFrame([("...", ["u_done", "clk"]), ("a |-> ##3 ...", ["STATE", "b"]), ("a |-> ack", ["done"])], "s string, n array<string>")
    assert [r.c for r in guess.select(sva.consequent_signals(F.col("s"), F.col("n")).alias("c")).collect()] == [["u_done"], ["STATE"], ["ack"]]


def test_failed_windows(spark):
    deps = spark.createDataFrame([(1, "T.prop", "T.a", "assertion", "a |-> ##[1:2] ack", ""), (2, "T.prop", "T.ack", "assertion", "a |-> ##[1:2] ack", "")], "dep_id long, target string, source string, dep_type string, expression string, condition string")
    values = {"T.a": "101100", "T.ack": "000000"}
    samples = spark.createDataFrame([("t", s, c, v) for s, many in values.items() for c, v in enumerate(many)], "trace_id string, signal string, cycle int, value string")
    ends = spark.createDataFrame([("t", "T.prop", 5), ("u", "T.prop", 1)], "trace_id string, signal string, cycle int")
    windows, late = build.failed_windows(deps, samples, ends)
    assert {tuple(r) for r in windows.collect()} == {("t", "T.prop", 2, 1, 2, 5), ("u", "T.prop", None, 1, 2, 1)}
    assert {tuple(r) for r in late.collect()} == {("t", "T.ack"), ("u", "T.ack")}
    edges = sva.window_graph(windows, late, samples.limit(0))[1]
    assert {(r.source, r.source_cycle, r.score) for r in edges.collect()} == {("T.ack", 3, 0.8), ("T.ack", 4, 0.8), ("T.prop", 2, 1.0)}


def test_buckets_of_time_change_nothing(spark):
    import random

    r = random.Random(2)
    rows = []
    for trace_id in ("a", "b"):
        t = 0
        for seq in range(300):
            t += r.choice([0, 1, 1, 7, 400 if seq % 50 == 0 else 2])
            rows.append((trace_id, "c", t, seq, r.choice("01xz")))
    clock = spark.createDataFrame(rows, "trace_id string, signal string, t long, seq long, value string")
    whole, cut = (sorted(map(tuple, trace.clock_edges(clock, crowd).collect())) for crowd in (1 << 16, 7))
    assert whole == cut and len(whole) > 50
    edges = trace.clock_edges(clock)
    points = spark.createDataFrame([(x, t) for x in ("a", "b", "none") for t in range(-5, 2000, 3)], "trace_id string, t long")
    want = {(x, t): max(0, sum(e[0] == x and e[2] <= t for e in whole) - 1) for x in ("a", "b", "none") for t in range(-5, 2000, 3)}
    for crowd in (1 << 16, 7):
        assert {(p.trace_id, p.t): p.cycle for p in trace.time_to_cycle(points, edges, crowd).collect()} == want
    starts = {(x.cycle_from, x.cycle_to, x.value) for x in trace.start_runs(clock.where("trace_id = 'a'"), edges, 7).collect()}
    assert starts == {(x.cycle_from, x.cycle_to, x.value) for x in trace.start_runs(clock.where("trace_id = 'a'"), edges).collect()}


def test_design_forms():
    text = """module M #(parameter WIDTH = 8, DEPTH = 2*WIDTH)(input clk, input [WIDTH-1:0] a, output [DEPTH-1:0] y);
  localparam HALF = (WIDTH + 8'h4) / 3;
  reg [HALF-1:0] q, r; reg c;
  assign {c, y} = a + b;
  always @(posedge clk) begin
    for (int i = 0; i < WIDTH; i = i + 1) begin
      if (en[i]) q[i] <= a[i] ^ q[i-1];
    end
    unique case (s)
      2'd0: {q, r} <= {a, b};
      default: r <= 1;
    endcase
  end
endmodule
"""
    rows = {(x["source"], x["target"], x["line"]) for x in rtl.parse_design(text)}
    assert rows == {("a", "c", 4), ("b", "c", 4), ("a", "y", 4), ("b", "y", 4), ("a", "q", 7), ("en", "q", 7), ("a", "q", 10), ("b", "q", 10), ("s", "q", 10), ("a", "r", 10), ("b", "r", 10), ("s", "r", 10), ("s", "r", 11)}
    assert next(x["condition"] for x in rtl.parse_design(text) if x["line"] == 11) == "default"
    assert {x["name"]: x["width"] for x in rtl.signals_in(text)} == {"clk": 1, "a": 8, "y": 16, "q": 4, "r": 4, "c": 1}
    long = "module m;\n" + "".join(f"assign a{i} = b{i};\n" for i in range(20000)) + "endmodule\n"
    import time

    began = time.time()
    found = rtl.parse_design(long)
    assert found[-1]["line"] == 20001 and time.time() - began < 5


def test_names_of_two_traces(spark):
    rows = [("one", "T.m.q", 0, "0"), ("one", "T.m.my_q", 0, "1"), ("two", "T.m.q [1:0]", 0, "11"), ("two", "A.q", 0, "00")]
    samples = spark.createDataFrame(rows, "trace_id string, signal string, cycle int, value string")
    wanted = spark.createDataFrame([(t, "q", 0, s) for t in ("one", "two") for s in ("T.m", "T.x")] + [("one", "my", 0, "T.m"), ("one", None, 0, "T")], "trace_id string, signal string, cycle int, scope string")
    got = {(r.trace_id, r.signal, r.scope): (r.resolved, r.value) for r in names.resolve(samples, wanted).collect()}
    assert got == {("one", "q", "T.m"): ("T.m.q", "0"), ("one", "q", "T.x"): ("T.m.q", "0"), ("two", "q", "T.m"): ("T.m.q [1:0]", "11"), ("two", "q", "T.x"): ("A.q", "00"), ("one", "my", "T.m"): (None, "x"), ("one", None, "T"): (None, "x")}


def test_expression_text_and_cycles(spark):
    from tracewright.functions.expr import parse, to_text

    assert to_text(parse("a + b * ~c ? {x, 4'd3} : !q")) == "((a + (b * ~c)) ? {x, 0011} : !q)" and "..." in to_text(parse("(" * 12 + "a" + " + a)" * 12))
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("u", "a", "b"), ("u", "b", "a"), ("u", "b", "z")], "trace_id string, source_id string, target_id string")
    assert [r.trace_id for r in build.has_cycle(edges).collect()] == ["u"]
    signals = spark.createDataFrame([("t", "top.myclk_in"), ("t", "top.a"), ("u", "clock"), ("u", "top.x.clk"), ("v", "top.b")], "trace_id string, signal string")
    assert {tuple(r) for r in trace.clock_signal(signals).collect()} == {("t", "top.myclk_in"), ("u", "top.x.clk")}
    assert {tuple(r) for r in trace.clock_signal(signals, "clock").collect()} == {("t", "top.myclk_in"), ("u", "clock")}


def test_every_cycle_has_its_time(spark):
    import duckdb
    from tracewright.plans import catalog

    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        got = sorted(tuple(r) for r in catalog.QUERIES["w05_cycle_to_time"](spark, folder).collect())
        base = duckdb.connect()
        base.execute("SET TimeZone = 'UTC'")
        base.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        assert got == sorted(base.execute(catalog.ORACLES["w05_cycle_to_time"]).fetchall())
        n = catalog.QUERIES["w03_cycle_count"](spark, folder).first().cycles
        assert [c for c, _ in got] == list(range(-1, n + 1))
        print(sf, len(got))
