"""What must not hang on the size of one task or of the driver."""

from pyspark.sql import functions as F

from tracewright.llm import topk
from tracewright.operators import names, slicer
from tracewright.plans import build, designs, report
from tracewright.sources import adapters, rtl


def parts(spark, folder, many=300):
    spark.range(many).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_small_table_are_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "TEXTS", 20, raising=False)
    folder = parts(spark, tmp_path)
    for texts in (adapters.design_texts, adapters.case_texts):
        made = texts(spark, folder)
        assert made.rdd.getNumPartitions() == 15 and made.select("path").distinct().count() == 300
    used = rtl.parse_dependencies(adapters.design_texts(spark, folder)).select(F.spark_partition_id()).distinct().count()
    assert used > 10
    assert designs.p01(spark, folder).count() == 300 * 11 and designs.s08(spark, folder).count() == 300


def test_parsed_rows_come_in_batches(spark, monkeypatch):
    """A text that can't be parsed costs its own rows alone; more rows than a batch are all there."""
    good = "module m(input a, output b);\n  assign b = a;\nendmodule"
    texts = [(f"{i}.sv", "module m(); assert property (a endmodule" if i % 7 == 3 else good) for i in range(6000)]
    found = rtl.parse_dependencies(spark.createDataFrame(texts, "path string, value string").coalesce(1))
    assert {r.file for r in found.select("file").collect()} == {p for i, (p, _) in enumerate(texts) if i % 7 != 3}
    assert found.count() == sum(i % 7 != 3 for i in range(6000))


def test_a_text_is_cleaned_once_and_its_patterns_kept(monkeypatch):
    """Parsing costs no second pass over the text, and no pattern is looked up again for each word."""
    texts, clean = [], rtl.sanitize
    monkeypatch.setattr(rtl, "sanitize", lambda text: texts.append(text) or clean(text))
    looked, found = [], rtl.re.compile
    monkeypatch.setattr(rtl.re, "compile", lambda *a: looked.append(a[0]) or found(*a))
    body = "\n".join(f"    if (e{i}) y <= (a{i} + (b & {{c, d}}));" for i in range(50))
    rows = rtl.parse_design(f"module m(input c, output reg y);\n  always @(posedge c) begin\n{body}\n  end\nendmodule")
    assert len(texts) == 1 and len(looked) < 50
    assert [r["source"] for r in rows[:5]] == ["a0", "b", "c", "d", "e0"] and len(rows) == 250


def test_names_are_resolved_in_one_exchange(spark, monkeypatch):
    """However many signals end alike, a sample and a name are dealt once; where a name's own signal has no sample at a cycle, the next one counts."""
    held = [("t", f"T.u{i}.q", c, f"{i}{c}") for i in range(6) for c in range(4) if (i, c) != (3, 2)] + [("t", "q", 1, "own"), ("t", "T.v.q [1:0]", 0, None), (None, "T.u0.q", 0, "no"), ("s", "T.u0.q", 0, "11")]
    samples = spark.createDataFrame(held, "trace_id string, signal string, cycle int, value string")
    asked = [("t", "q", c, f"T.u{i}") for i in range(7) for c in range(5)] + [("t", "u4.q", 0, "T"), ("t", "u4.q", 0, "x"), ("t", "q", 0, "T.v"), ("t", None, 1, "q"), ("t", "q", 1, None), (None, "q", 0, "T.u0"), ("s", "q", 0, "T.u5")]
    wanted = spark.createDataFrame(asked + asked[:3], "trace_id string, signal string, cycle long, scope string")
    monkeypatch.setattr(names, "MET", 10, raising=False)
    found = names.resolve(samples, wanted)
    assert joins(found).count("Exchange") == 1
    rows = found.collect()
    got = {(r.trace_id, r.signal, r.cycle, r.scope): (r.resolved, r.value) for r in rows}
    there = {(s, c): v for t, s, c, v in held if t == "t"}
    want = {}
    for i in range(7):
        for c in range(5):
            full = next((f for f in (f"T.u{i}.q", "q", *(f"T.u{j}.q" for j in range(6))) if (f, c) in there), None)
            want["t", "q", c, f"T.u{i}"] = (full, there.get((full, c), "x"))
    want |= {("t", "u4.q", 0, "T"): ("T.u4.q", "40"), ("t", "u4.q", 0, "x"): ("T.u4.q", "40"), ("t", "q", 0, "T.v"): ("T.v.q [1:0]", "x"), ("t", None, 1, "q"): ("q", "own"), ("t", "q", 1, None): ("q", "own"), (None, "q", 0, "T.u0"): (None, "x"), ("s", "q", 0, "T.u5"): ("T.u0.q", "11")}
    assert len(rows) == len(want) and got == want
    alone = names.resolve(samples.where("trace_id = 's'").drop("trace_id"), wanted.where("scope = 'T.u5'").drop("trace_id"))
    assert alone.columns == ["signal", "cycle", "scope", "resolved", "value"] and {(r.cycle, r.resolved, r.value) for r in alone.collect()} == {(0, "T.u0.q", "11"), *((c, None, "x") for c in range(1, 5))}


def test_owners_and_contexts_send_nothing_to_the_driver(spark, tmp_path):
    folder = parts(spark, tmp_path)
    assert "Broadcast" not in joins(designs.p15(spark, folder))
    assert "Broadcast" not in joins(designs.p19(spark, folder))
    assert designs.p15(spark, folder).count() == 900


def test_slices_send_no_table_to_the_driver(spark):
    deps = spark.range(40).select(F.col("id").alias("dep_id"), F.floor(F.col("id") / 3).cast("int").alias("target"), (F.floor(F.col("id") / 3) * 3 + 1 + F.col("id") % 3).cast("int").alias("source"), F.lit("combinational").alias("dep_type"))
    seeds = spark.range(1).select(F.lit("t").alias("trace_id"), F.lit(0).alias("signal"), F.lit(5).alias("cycle"))
    listed = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = listed().size()
    nodes, edges, _ = slicer.backward_slice(deps, seeds, max_depth=20)
    assert slicer.roots(nodes, edges).count() and "Broadcast" not in joins(slicer.roots(nodes, edges))
    ran = listed()
    assert not any("BroadcastHashJoin" in ran.apply(i).physicalPlanDescription() for i in range(before, ran.size()))
    one = nodes.select("trace_id", F.col("signal").cast("string").alias("id"), "signal", "cycle", F.lit(True).alias("is_root"), F.lit(False).alias("is_endpoint"), F.lit(None).cast("string").alias("rtl_refs"))
    led = edges.select("trace_id", F.col("source").cast("string").alias("source_id"), F.col("target").cast("string").alias("target_id"), F.lit(1).alias("dep_id"), *(F.lit("").alias(c) for c in ("type", "score", "reason", "evidence", "example")))
    assert "Broadcast" not in joins(report.evidence(one, led, one))


def test_edges_are_judged_by_the_values_they_ask_for(spark):
    """A step's joins read a table of the points it asks for, not all samples each; points that nothing asks for change no verdict."""
    deps = spark.createDataFrame([(1, "a", "b", "combinational", "b == 4'd5", ""), (2, "a", "c", "sequential", "", "")], "dep_id long, target string, source string, dep_type string, expression string, condition string").withColumn("source_name", F.col("source"))
    held = spark.range(400).select(F.lit("t").alias("trace_id"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("signal"), F.floor(F.col("id") / 4).cast("int").alias("cycle"), F.when(F.col("id") > -987654321, F.lpad(F.bin(F.col("id") % 16), 4, "0")).alias("value"))
    step = deps.select(F.lit("t").alias("trace_id"), "source", F.when(F.col("dep_id") == 1, 7).otherwise(6).alias("source_cycle"), F.lit(7).alias("target_cycle"), *[c for c in deps.columns if c != "source"])
    told = build.judge(deps, build.with_before(held), 20)(step, 15)
    assert "987654321" not in joins(told)
    got = {r.dep_id: (r.score, r.example and (r.example.type, r.example.source_original, r.example.source_before, r.example.source_after)) for r in told.collect()}
    assert got == {1: (1.0, ("counterfactual", "1101", None, None)), 2: (0.7, ("toggle_correlation", None, "0110", "1010"))}


def test_search_sends_no_queries_to_the_driver(spark):
    """Few queries, which each group of candidates gets a copy of, aren't broadcast once Spark knows their number."""
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: ((F.col("id") * i * 7919) % 257 - 128).cast("double")).alias("values"))
    found = topk.top_k(rows.where("id % 50 = 0"), rows, k=5)
    got = found.collect()
    assert len(got) == 8 * 5 and "Broadcast" not in joins(found)
    vectors = {r.id: [int(x) for x in r["values"]] for r in rows.collect()}
    for q in range(0, 400, 50):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]


def test_pipeline_links_fingerprints_and_similar_sets(spark, monkeypatch):
    """A group may hang together by fingerprints at one link and by shingle similarity at the next."""
    import corpus_pipeline
    from tracewright.llm import neardup

    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five")], "doc_id long, text string").coalesce(1)
    key = {r.doc_id: r._key for r in docs.select("doc_id", F.monotonically_increasing_id().alias("_key")).collect()}
    alike = [(key[d], c) for d, c in ((1, 70), (2, 70), (3, 60), (4, 50), (5, 40))]
    near = [(10, 1), (20, 2), (21, 2), (30, 4), (40, 5)]  # 2 and 3 are near by fingerprint
    fp = {1: 10, 2: 20, 3: 21, 4: 30, 5: 40}
    monkeypatch.setattr(neardup, "components", lambda *a: spark.createDataFrame(alike, "_key long, component long"))
    monkeypatch.setattr(neardup.simhash, "fingerprints", lambda *a: spark.createDataFrame([(key[d], f) for d, f in fp.items()], "_key long, fp long"))
    monkeypatch.setattr(neardup.simhash, "components", lambda prints, radius: spark.createDataFrame([(f, key[d]) for f, d in near], "fp long, component_id long"))
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == [1, 4, 5]


def test_what_is_not_asked_of_a_text_is_not_made(spark, tmp_path):
    """p04 makes no snippets; a text is walked in place, not copied for each of its blocks; labels, instances and words that only look like such are as before."""
    plan = joins(designs.p04(spark, parts(spark, tmp_path)))
    assert "MapInArrow" in plan and "snippet" not in plan

    class Text(str):
        copied = 0

        def __getitem__(self, at):
            Text.copied += len(got := str.__getitem__(self, at))
            return got

    body = Text("".join(f"  always @(posedge c) if (e{i}) y{i} <= a{i};\n" for i in range(200)))
    made = []
    for a in rtl.ALWAYS.finditer(body):
        rtl.Statements(body, a.end(), lambda target, *said, **more: made.append((target, said[2], str(body)[said[3] : said[4]])), "sequential").one("")
    assert made == [(f"y{i}", f"e{i}", f"y{i} <= a{i}") for i in range(200)] and Text.copied < 2 * len(body)
    text = "module m(input a, output b);\n  one : \n assert property (a);\n  xassert property (b); q: myassert property(a);\n  reassign b = a; assign b = a;\n  n u ( .i(a)); u ( .i(b)); n\n  v(.i(b));\nendmodule\nmodule n(input i); endmodule"
    got = [(r["source"], r["target"], r["dep_type"], r["line"], r["line_end"]) for r in rtl.parse_design(text)]
    assert got == [("a", "one", "assertion", 2, 3), ("b", "assert_1", "assertion", 4, 4), ("a", "assert_2", "assertion", 4, 4), ("a", "b", "combinational", 5, 5), ("a", "u.i", "port_input", 6, 6), ("b", "v.i", "port_input", 6, 6)]


def test_rows_that_a_query_leaves_out_are_not_made(spark, tmp_path):
    """p09's tasks give the rows of ports alone; a text that can't be parsed elsewhere still gives none."""
    assert "StartsWith" not in joins(designs.p09(spark, parts(spark, tmp_path)))
    good = "module c(input i, output o);\nendmodule\nmodule m(input a, output b);\n  assign b = a;\n  c u (.i(a), .o(b));\n  always @(*) if (a) b = a;\nendmodule"
    texts = [("good", good), ("if", good.replace("if (a)", "if (a")), ("assert", good.replace("assign", "assert property (x; assign"))]
    ports = lambda kind, _: kind.startswith("port")
    found = rtl.parse_dependencies(spark.createDataFrame(texts, "path string, value string"), ports, snippets=False)
    assert sorted((r.file, r.source, r.target, r.dep_type) for r in found.collect()) == [("good", "a", "u.i", "port_input"), ("good", "u.o", "b", "port_output")]
    assert rtl.parse_design(good, ports) == [r for r in rtl.parse_design(good) if r["dep_type"].startswith("port")]


def test_a_signal_looks_up_no_pattern(monkeypatch):
    """Patterns of the signals' parser are made once, not looked up for each port; widths and lines are those of plain text."""
    looked = []
    for name in ("search", "match", "fullmatch", "sub", "finditer", "findall"):
        monkeypatch.setattr(rtl.re, name, lambda *a, _f=getattr(rtl.re, name), **k: looked.append(a[0]) or _f(*a, **k))
    ports = ",\n".join(f"  input [{i}:0] a{i}, b{i}" for i in range(60))
    text = f"module m(\n{ports}, output reg y);\n  xwire [3:0] n;\n  logic signed [ 7 :0] p, q; reg r = a1;\n  wire [1:4] w;\nendmodule"
    rows = [(r["name"], r["signal_type"], r["width"], r["line"]) for r in rtl.signals_in(text)]
    assert rows[:120] == [(f"{x}{i}", "in", i + 1, i + 2) for i in range(60) for x in "ab"]
    assert rows[120:] == [("y", "out", 1, 61), ("p", "reg", 8, 63), ("q", "reg", 8, 63), ("r", "reg", 1, 63), ("w", "reg", 4, 64)]
    assert len(looked) < 20


def test_snippets_are_made_for_the_rows_that_are_asked(spark, tmp_path):
    """p20's tasks leave out the rest before they make snippets; a snippet is made once for the sources of a statement."""
    folder = parts(spark, tmp_path, 7)
    found = designs.p20(spark, folder)
    plan = joins(found)
    assert plan.count("snippet") and "assertion" not in plan.split("MapInArrow")[0]
    assert sorted((r.module, r.source, r.target, r.snippet) for r in found.where("module = 'm3'").collect()) == [("m3", "a", "p3", TOLD), ("m3", "q", "w", "  assign w = q ^ v;"), ("m3", "v", "w", "  assign w = q ^ v;"), ("m3", "y", "p3", TOLD)]
    wide = "module m(input a, output b);\n  assign b = a\n" + "\n".join(f"    & c{i}" for i in range(50)) + ";\nendmodule"
    rows = rtl.parse_design(wide)
    assert len(rows) == 51 and {r["snippet"] for r in rows} == {"  assign b = a\n    & c0\n    & c1\n    & c2\n    & c3"} and len({id(r["snippet"]) for r in rows}) == 1


TOLD = "  p3:\n    assert property (@(posedge clock) disable iff (~hasBeenReset) a |-> ##[1:4] y);"
