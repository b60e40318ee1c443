"""Registered queries over design sources, names, expressions and clocks, beside those of ``catalog``.

The sources are the texts of ``adapters.design_texts()``: one for each part, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, compiled
from ..operators import names, slicer, sva, trace
from ..sources import adapters, rtl
from . import build, catalog

query = catalog.query

#: What the oracles share: the rows that each text must give, in DuckDB's SQL.
RTL = """
k AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS n, p_size FROM part),
dep AS (SELECT k.k, k.n, t.* FROM k, (VALUES
  ('c', 'i', 'o', 'combinational', '~i', '', 2, 2), ('m', 'a', 'v', 'combinational', 'a + <n>''h1', '', 7, 7), ('m', 'q', 'w', 'combinational', 'q ^ v', '', 8, 8), ('m', 'v', 'w', 'combinational', 'q ^ v', '', 8, 8),
  ('m', 'a', 'q', 'sequential', 'a', 'en', 10, 10), ('m', 'en', 'q', 'sequential', 'en', 'en', 10, 10), ('m', 'y', 'q', 'sequential', 'y', 'w', 11, 11), ('m', 'w', 'q', 'sequential', 'w', 'w', 11, 11), ('m', 'en', 'q', 'sequential', '!(en)', '!(en)', 12, 12),
  ('m', 'b', 'u.i', 'port_input', 'b', '', 14, 14), ('m', 'u.o', 'z', 'port_output', 'z', '', 14, 14),
  ('m', 'a', 'p<k>', 'assertion', 'a |-> ##[1:<n>] y', '@(posedge clock)', 15, 16), ('m', 'y', 'p<k>', 'assertion', 'a |-> ##[1:<n>] y', '@(posedge clock)', 15, 16))
  t(module, source, target, dep_type, expression, condition, line, line_end)),
d AS (SELECT concat(module, k) AS module, source, replace(target, '<k>', k) AS target, dep_type, replace(expression, '<n>', n) AS expression, condition, CAST(line AS INTEGER) AS line, CAST(line_end AS INTEGER) AS line_end, concat('m', k, '.sv') AS file, k, n FROM dep),
sig AS (SELECT concat(t.m, k.k) AS module, t.name, t.kind AS signal_type, CAST(CASE WHEN t.bits < 0 THEN k.p_size + 1 ELSE t.bits END AS INTEGER) AS width, CAST(t.line AS INTEGER) AS line, concat('m', k.k, '.sv') AS file FROM k, (VALUES
  ('c', 'i', 'in', 1, 1), ('c', 'o', 'out', 1, 1), ('m', 'clock', 'in', 1, 4), ('m', 'a', 'in', -1, 4), ('m', 'b', 'in', -1, 4), ('m', 'en', 'in', 1, 4), ('m', 'y', 'out', 4, 4),
  ('m', 'q', 'reg', 8, 5), ('m', 'z', 'reg', 1, 6), ('m', 'w', 'reg', 1, 6), ('m', 'v', 'reg', 1, 7)) t(m, name, kind, bits, line))
"""


@query("p01_signals", f"WITH {RTL} SELECT module, name, signal_type, width, line, file FROM sig")
def p01(spark, sf_dir):
    return rtl.parse_signals(adapters.design_texts(spark, sf_dir))


@query("p04_dependencies", f"WITH {RTL} SELECT module, source, target, dep_type, expression, condition, line, line_end, file FROM d")
def p04(spark, sf_dir):
    return rtl.parse_dependencies(adapters.design_texts(spark, sf_dir), snippets=False)


@query("p07_case", """WITH k AS (SELECT concat('q', p_partkey) AS module, CAST(p_size AS VARCHAR) AS n, p_size % 3 + 1 AS m FROM part),
arm AS (SELECT module, n, m, unnest(range(m)) AS i FROM k),
r AS (SELECT module, 'a' AS source, 'y' AS target, 'sequential' AS dep_type, concat('a + ', n, '''h', i) AS expression, concat('s==2''d', i) AS condition, 4 + i AS line FROM arm
UNION ALL SELECT module, 's', 'y', 'sequential', concat('s==2''d', i), concat('s==2''d', i), 4 + i FROM arm
UNION ALL SELECT module, t.* EXCLUDE (ahead), m + ahead FROM k, (VALUES ('b', 'y', 'sequential', 'b', 'default', 4), ('s', 'y', 'sequential', 'default', 'default', 4),
  ('s', 'z', 'combinational', 's', 'b', 7), ('b', 'z', 'combinational', 'b', 'b', 7), ('a', 'z', 'combinational', 'a', '!(b)', 7), ('b', 'z', 'combinational', '!(b)', '!(b)', 7)) t(source, target, dep_type, expression, condition, ahead))
SELECT module, source, target, dep_type, expression, condition, CAST(line AS INTEGER) AS line FROM r""")
def p07(spark, sf_dir):
    """Arms of a case, its default arm and an else."""
    found = rtl.parse_dependencies(adapters.case_texts(spark, sf_dir), snippets=False)
    return found.select("module", "source", "target", "dep_type", "expression", "condition", "line")


@query("p09_instance_ports", f"WITH {RTL} SELECT module, source, target, dep_type FROM d WHERE dep_type LIKE 'port%'")
def p09(spark, sf_dir):
    return rtl.parse_dependencies(adapters.design_texts(spark, sf_dir), lambda kind, _: kind.startswith("port"), snippets=False).select("module", "source", "target", "dep_type")


@query("p10_assertion_dependencies", f"WITH {RTL} SELECT module, target AS label, source, condition FROM d WHERE dep_type = 'assertion'")
def p10(spark, sf_dir):
    d = rtl.parse_dependencies(adapters.design_texts(spark, sf_dir), lambda kind, _: kind == "assertion", snippets=False)
    return d.select("module", F.col("target").alias("label"), "source", "condition")


@query("p20_snippets", f"""WITH {RTL} SELECT module, source, target, CASE dep_type WHEN 'assertion' THEN concat('  p', k, ':', chr(10), '    assert property (@(posedge clock) disable iff (~hasBeenReset) a |-> ##[1:', n, '] y);') ELSE '  assign w = q ^ v;' END AS snippet
FROM d WHERE dep_type = 'assertion' OR target = 'w'""")
def p20(spark, sf_dir):
    d = rtl.parse_dependencies(adapters.design_texts(spark, sf_dir), lambda kind, target: kind == "assertion" or target == "w")
    return d.select("module", "source", "target", "snippet")


@query("s08_assertions", f"WITH {RTL} SELECT concat('p', k) AS label, '@(posedge clock)' AS clock, '~hasBeenReset' AS disable, concat('a |-> ##[1:', n, '] y') AS body, CAST(15 AS INTEGER) AS line, concat('m', k, '.sv') AS file FROM k")
def s08(spark, sf_dir):
    return rtl.parse_assertions(adapters.design_texts(spark, sf_dir))


@query("s09_labels", f"WITH {RTL} SELECT concat('p', k) AS label, concat('m', k, '.sv') AS file FROM k")
def s09(spark, sf_dir):
    return rtl.parse_labels(adapters.design_texts(spark, sf_dir))


@query("s05_instances", f"WITH {RTL} SELECT 'u' AS instance, concat('c', k) AS module, concat('m', k, '.sv') AS file FROM k")
def s05(spark, sf_dir):
    return rtl.parse_instances(adapters.design_texts(spark, sf_dir))


@query("p19_context", f"""WITH {RTL}, asked AS (SELECT DISTINCT module, target AS signal FROM d),
n AS (SELECT module, target AS signal, count(*) AS n, min(line) AS least FROM d GROUP BY ALL)
SELECT asked.module, asked.signal, sig.name IS NOT NULL AS found, sig.signal_type AS type, sig.width, n.n AS dependencies, n.n + CASE WHEN sig.name IS NULL THEN 0 ELSE 1 END AS refs, coalesce(sig.line, n.least) AS first_line
FROM asked LEFT JOIN sig ON sig.module = asked.module AND sig.name = asked.signal JOIN n ON n.module = asked.module AND n.signal = asked.signal""")
def p19(spark, sf_dir):
    texts = adapters.design_texts(spark, sf_dir)
    d = slicer.table(rtl.parse_dependencies(texts, snippets=False).select("module", "target", "source", "dep_type", "file", "line"))  # read twice, parsed once
    told = names.rtl_context(d.select("module", F.col("target").alias("signal")), rtl.parse_signals(texts), d)
    return told.select("module", "signal", "found", F.col("definition.signal_type").alias("type"), F.col("definition.width").alias("width"), F.size("dependencies").cast("bigint").alias("dependencies"), F.size("rtl_refs").cast("bigint").alias("refs"), F.col("rtl_refs")[0]["line"].alias("first_line"))


@query("p15_owning_module", f"""WITH {RTL} SELECT concat('top.m', k, '.x') AS scope, concat('m', k) AS owner FROM k UNION ALL SELECT concat('top.m', k, '.i', k), concat('c', k) FROM k UNION ALL SELECT concat('top', k, '.none'), concat('top', k) FROM k""")
def p15(spark, sf_dir):
    k = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"))
    cat = lambda *x: F.concat(*(F.col("k") if p == "k" else F.lit(p) for p in x))
    scopes = k.select(F.explode(F.array(cat("top.m", "k", ".x"), cat("top.m", "k", ".i", "k"), cat("top", "k", ".none"))).alias("scope"))
    return names.owning_module(scopes, k.select(cat("m", "k").alias("module")), k.select(cat("i", "k").alias("instance"), cat("c", "k").alias("module")))


@query("r04_sources", f"WITH {RTL} SELECT module, target AS signal, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM d GROUP BY module, target")
def r04(spark, sf_dir):
    d = rtl.parse_dependencies(adapters.design_texts(spark, sf_dir), snippets=False)
    return names.sources_of(d).select("module", "signal", F.array_join("sources", ",").alias("sources"))


WAVE, VALUES, NUMBERS = catalog.WAVE, catalog.VALUES, catalog.NUMBERS


@query("r03_resolve", f"""WITH {WAVE}, two AS (SELECT 'one' AS trace_id, signal, cycle, value FROM cv UNION ALL SELECT 'two', signal, cycle, translate(value, '01', '10') FROM cv WHERE signal LIKE 'top.u0.%'),
n AS (SELECT trace_id, signal AS whole, cycle, value, split_part(signal, '.', 3) AS name, split_part(signal, '.', 2) AS unit FROM two)
SELECT trace_id, name AS signal, cycle, concat('top.', unit) AS scope, whole AS resolved, value FROM n
UNION ALL SELECT trace_id, name, cycle, 'elsewhere', min(whole), arg_min(value, whole) FROM n WHERE name IN ('view', 'click') GROUP BY trace_id, name, cycle
UNION ALL SELECT trace_id, whole, cycle, 'top', whole, value FROM n WHERE name = 'cart'
UNION ALL SELECT trace_id, concat('no_', name), cycle, concat('top.', unit), NULL, 'x' FROM n WHERE unit = 'u0'""")
def r03(spark, sf_dir):
    """Names of two traces in their scopes, as full names, in a scope that has none (the first signal that ends so) and unknown ones."""
    one = slicer.table(trace.cycle_values(*catalog._trace(spark, sf_dir)).select("signal", "cycle", "value"))
    two = one.where("signal like 'top.u0.%'").withColumn("value", F.translate("value", "01", "10"))
    samples = slicer.table(one.withColumn("trace_id", F.lit("one")).unionByName(two.withColumn("trace_id", F.lit("two"))))
    s = F.col("signal")
    own = samples.select("trace_id", names.base(s).alias("signal"), "cycle", names.hierarchy(s).alias("scope"))
    away = own.where("signal in ('view', 'click')").withColumn("scope", F.lit("elsewhere"))
    full = samples.where("signal like '%.cart'").select("trace_id", "signal", "cycle", F.lit("top").alias("scope"))
    lost = own.where("scope = 'top.u0'").withColumn("signal", F.concat(F.lit("no_"), "signal"))
    return names.resolve(samples, own.union(away).union(full).union(lost))


@query("a04_clock", f"""WITH {WAVE}, s AS (SELECT split_part(signal, '.', 2) AS trace_id, signal FROM signals UNION ALL SELECT DISTINCT split_part(signal, '.', 2), unnest(['top.a.b.clk', 'top.z.CLOCK [0:0]', 'clock', 'top.clocks']) FROM signals)
SELECT trace_id, 'top.z.CLOCK [0:0]' AS signal FROM s GROUP BY trace_id""")
def a04(spark, sf_dir):
    named = adapters.wave(spark, sf_dir).select(F.split("signal", r"\.")[1].alias("trace_id"), "signal").distinct()
    extra = F.explode(F.array(*(F.lit(x) for x in ("top.a.b.clk", "top.z.CLOCK [0:0]", "clock", "top.clocks")))).alias("signal")
    return trace.detect_clock(named.union(named.select("trace_id").distinct().select("trace_id", extra)))


@query("v02_consequents", f"""WITH {RTL} SELECT k, CASE WHEN p_size % 2 = 0 THEN 'q,done' ELSE 'x_done,my_state' END AS names FROM k""")
def v02(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_size")
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a |-> ##[1:"), n, F.lit("] (q == 3'h1 and done)"))).otherwise(F.concat(F.lit("a |-> ##"), n, F.lit(" ...")))
    sources = F.array(*(F.lit(x) for x in ("a", "x_done", "my_state")))
    return p.select("k", F.array_join(sva.consequent_signals(text, sources), ",").alias("names"))


@query("c02_counterfactual", f"""WITH {WAVE}, {VALUES}, {NUMBERS}, o AS (SELECT seq, x & y AS original, (15 - x) & y AS perturbed FROM n)
SELECT seq, lpad(bin(original), 4, '0') AS original, lpad(bin(perturbed), 4, '0') AS perturbed, original <> perturbed AS causal,
CASE WHEN original <> perturbed THEN least(1.0, bit_count(xor(original, perturbed)) / 4.0 + 0.5) ELSE 0.0 END::DOUBLE AS score FROM o""")
def c02(spark, sf_dir):
    p = catalog._pairs(spark, sf_dir)
    cases = p.select("seq", F.lit("a & b").alias("expression"), F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")).alias("env"), F.lit("a").alias("source"))
    return slicer.counterfactuals(cases).select("seq", "original", "perturbed", "causal", "score")


@query("c03_literal", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, CASE WHEN x = 5 THEN '1' ELSE '0' END AS original, CASE WHEN x = 5 THEN '0' ELSE '1' END AS perturbed, true AS causal, 1.0::DOUBLE AS score FROM n""")
def c03(spark, sf_dir):
    p = catalog._pairs(spark, sf_dir)
    cases = p.select("seq", F.lit("a == 4'd5").alias("expression"), F.create_map(F.lit("a"), F.col("a")).alias("env"), F.lit("a").alias("source"))
    return slicer.counterfactuals(cases).select("seq", "original", "perturbed", "causal", "score")


@query("g09_window_branch", f"""WITH {WAVE}, h AS (SELECT split_part(signal, '.', 2) AS trace_id, cycle, contains(value, '1') AND NOT contains(value, 'x') AS holds FROM cv WHERE signal LIKE '%.view' AND cycle <= 55),
g AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY cycle) AS run FROM h),
b AS (SELECT trace_id, max(cycle) AS trig FROM (SELECT trace_id, run, min(cycle) AS cycle FROM g WHERE holds GROUP BY trace_id, run) GROUP BY trace_id),
m AS (SELECT split_part(signal, '.', 2) AS trace_id, cycle FROM moved WHERE signal LIKE '%.click'),
f AS (SELECT trace_id, m.cycle, row_number() OVER (PARTITION BY trace_id ORDER BY m.cycle) AS n FROM m JOIN b USING (trace_id) WHERE m.cycle BETWEEN trig + 1 AND least(trig + 5, 60)),
u AS (SELECT trace_id, cycle FROM f WHERE n <= 5 UNION SELECT trace_id, unnest([trig + 1, least(trig + 5, 60)]) FROM b)
SELECT trace_id, concat('top.', trace_id, '.click') AS source, cycle AS source_cycle, 'state' AS type, 0.8::DOUBLE AS score, concat('top.', trace_id, '.click@', cycle, ' stayed false in window [1:5]') AS reason FROM u
UNION ALL SELECT trace_id, concat('top.', trace_id, '.fail'), trig, 'conditional', 1.0::DOUBLE, concat('triggered at cycle ', trig, ', failed at cycle 60') FROM b WHERE trig < 60""")
def g09(spark, sf_dir):
    """What leads to the failure, at cycle 60 of each of eight traces, of a property with a window."""
    samples = trace.cycle_values(*catalog._trace(spark, sf_dir)).withColumn("trace_id", F.split("signal", r"\.")[1])
    ends = samples.select("trace_id").distinct().select("trace_id", F.concat(F.lit("top."), "trace_id", F.lit(".fail")).alias("signal"), F.lit(60).cast("bigint").alias("cycle"))
    scope = F.concat(F.lit("top."), F.col("trace_id"), F.lit("."))
    sides = ends.select(scope.alias("scope"), F.col("signal").alias("target"), F.explode(F.array(F.lit("view"), F.lit("click"))).alias("name"))
    deps = sides.select(F.concat("target", F.lit("<"), "name").alias("dep_id"), "target", F.concat("scope", "name").alias("source"), F.lit("assertion").alias("dep_type"), F.lit("view |-> ##[1:5] click").alias("expression"), F.lit("@(posedge clock)").alias("condition"))
    edges = build.assertion_graph(deps, samples, ends)[0].edges
    return edges.where("target_cycle = 60").select("trace_id", "source", "source_cycle", "type", "score", "reason")


@query("c07_suspect_scores", """WITH e AS (SELECT concat('p', l_partkey % 50) AS source, CAST(l_linenumber AS DOUBLE) / 10 AS score FROM lineitem) SELECT 'lines' AS trace_id, source, max(score) * 0.9::DOUBLE AS suspect_score FROM e GROUP BY source""")
def c07(spark, sf_dir):
    lines = adapters.table(spark, sf_dir, "lineitem")
    edges = lines.select(F.lit("lines").alias("trace_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("source"), (F.col("l_linenumber").cast("double") / 10).alias("score"))
    return slicer.suspect_scores(edges)


@query("e04_precedence", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, lpad(bin((x | y) & xor(x, 3)), 4, '0') AS grouped, lpad(bin(x | (y & xor(x, 3))), 4, '0') AS tight,
CASE WHEN (x | y) <> 0 AND y <> 0 THEN '1' ELSE '0' END AS loose, lpad(bin(CASE WHEN x <> 0 AND y <> 0 THEN x | 1 ELSE x END), 4, '0') AS parity FROM n""")
def e04(spark, sf_dir):
    rows = catalog._pairs(spark, sf_dir).withColumn("env", F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")))
    for name, text, order in (("grouped", "(a | b) & a ^ 4'd3", "table"), ("tight", "a | b & a ^ 4'd3", "table"), ("loose", "a | b && b", "ieee"), ("parity", "a | a && b", "table")):
        rows = compiled.evaluated_text(rows, name, text, precedence=order)
    return rows.select("seq", "grouped", "tight", "loose", "parity")


@query("e17_literals", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, lpad(bin(x), 6, '0') AS hexadecimal, lpad(bin(x % 8), 3, '0') AS cut, bin(x) AS plain, lpad(bin((16 - x) % 16), 4, '0') AS negative, CASE WHEN x = 0 THEN '1' ELSE '0' END AS nothing FROM n""")
def e17(spark, sf_dir):
    x = bits.parse_binary(F.col("a"))
    text = lambda head: F.concat(F.lit(head), x.cast("string"))
    said = {"hexadecimal": F.concat(F.lit("6'h"), F.lower(F.hex(x))), "cut": text("3'd"), "plain": text(""), "negative": F.lit("-a"), "nothing": F.lit("!a")}
    rows = catalog._pairs(spark, sf_dir).withColumn("env", F.create_map(F.lit("a"), F.col("a")))
    for name, e in said.items():
        rows = compiled.evaluated(rows.withColumn("expression", e), name)
    return rows.select("seq", *said)


#: Bits that may be unknown, of two widths: the last bit of every third value is x, the first of every fifth z.
MIXED = """m AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN a[1:3] || 'x' WHEN seq % 5 = 0 THEN 'z' || a[2:4] ELSE a END AS a, CASE WHEN seq % 2 = 0 THEN b[2:4] ELSE b END AS b FROM p),
w AS (SELECT seq, a, b, lpad(b, 4, '0') AS c FROM m)"""


def _mixed(spark, sf_dir):
    p, i = catalog._pairs(spark, sf_dir), F.col("seq")
    a = F.when(i % 3 == 0, F.concat(F.substring("a", 1, 3), F.lit("x"))).when(i % 5 == 0, F.concat(F.lit("z"), F.substring("a", 2, 3))).otherwise(F.col("a"))
    return p.select("seq", a.alias("a"), F.when(i % 2 == 0, F.substring("b", 2, 3)).otherwise(F.col("b")).alias("b"))


@query("b03_unknown_bits", f"""WITH {WAVE}, {VALUES}, {MIXED}, d AS (SELECT *, len([i FOR i IN [1, 2, 3, 4] IF a[i] IN ('0', '1') AND a[i] <> c[i]]) AS n FROM w)
SELECT seq, n > 0 AS differ, CAST(n AS INTEGER) AS bits, least(1.0, n / 4.0 + 0.5)::DOUBLE AS score, CASE WHEN contains(a, 'x') OR contains(a, 'z') THEN NULL ELSE list_sum([CAST(a[i] AS BIGINT) * CAST(pow(2, 4 - i) AS BIGINT) FOR i IN [1, 2, 3, 4]])::BIGINT END AS number,
translate(a, '01', '10') AS inverse, NOT (contains(a, 'x') OR contains(a, 'z')) AND contains(a, '1') AS truth FROM d""")
def b03u(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _mixed(spark, sf_dir).select("seq", bits.values_differ(a, b).alias("differ"), bits.differing_bits(a, b).alias("bits"), bits.contribution(a, b).alias("score"), bits.parse_binary(a).alias("number"), bits.invert(a).alias("inverse"), bits.truthy(a).alias("truth"))


@query("e06_unknown_bits", f"""WITH {WAVE}, {VALUES}, {MIXED}
SELECT seq, array_to_string([CASE WHEN a[i] = '0' OR c[i] = '0' THEN '0' WHEN a[i] = '1' AND c[i] = '1' THEN '1' ELSE 'x' END FOR i IN [1, 2, 3, 4]], '') AS "and",
array_to_string([CASE WHEN a[i] = '1' OR c[i] = '1' THEN '1' WHEN a[i] = '0' AND c[i] = '0' THEN '0' ELSE 'x' END FOR i IN [1, 2, 3, 4]], '') AS "or",
array_to_string([CASE WHEN a[i] IN ('x', 'z') THEN 'x' WHEN a[i] = c[i] THEN '0' ELSE '1' END FOR i IN [1, 2, 3, 4]], '') AS "xor",
CASE WHEN a = c THEN '1' ELSE '0' END AS same, CASE WHEN a <> c THEN '1' ELSE '0' END AS other, CASE WHEN contains(a, 'x') OR contains(a, 'z') THEN NULL WHEN a >= c THEN '1' ELSE '0' END AS atleast,
CASE WHEN contains(a, 'x') OR contains(a, 'z') THEN NULL ELSE concat('0', a[1:3]) END AS halved, CASE WHEN contains(a, 'x') OR contains(a, 'z') OR NOT contains(a, '1') THEN '1' ELSE '0' END AS nothing FROM w""")
def e06u(spark, sf_dir):
    rows = _mixed(spark, sf_dir).withColumn("env", F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")))
    a, b = F.col("a"), F.col("b")
    said = {"or": "a | b", "same": "a === b", "other": "a != b", "atleast": "a >= b", "halved": "a >> 1'b1", "nothing": "!a"}
    for name, text in said.items():
        rows = compiled.evaluated_text(rows, name, text)
    return rows.select("seq", bits.bit_and(a, b).alias("and"), bits.bit_xor(a, b).alias("xor"), *said)


@query("e19_names", f"""WITH {WAVE}, {VALUES} SELECT seq, a AS exact, b AS dotted, a AS scored FROM p""")
def e19(spark, sf_dir):
    """q is itself where there is one, else what ends with .q, else what ends with _q; my_q comes before q by name."""
    env = lambda *pairs: F.create_map(*(x for name, c in pairs for x in (F.lit(name), F.col(c))))
    said = {"exact": env(("my_q", "b"), ("q", "a"), ("z.q", "b")), "dotted": env(("a_q", "a"), ("top.q", "b")), "scored": env(("top.m.my_q", "a"))}
    rows = catalog._pairs(spark, sf_dir)
    for name, e in said.items():
        rows = compiled.evaluated_text(rows.withColumn("env", e), name, "q")
    return rows.select("seq", *said)


@query("c02_names", f"""WITH {WAVE}, {VALUES} SELECT seq, a AS original, translate(a, '01', '10') AS perturbed, true AS causal, 1.0::DOUBLE AS score FROM p""")
def c02n(spark, sf_dir):
    """The source q is flipped, not my_q that ends alike."""
    p = catalog._pairs(spark, sf_dir)
    cases = p.select("seq", F.lit("q").alias("expression"), F.create_map(F.lit("my_q"), F.col("b"), F.lit("q"), F.col("a")).alias("env"), F.lit("q").alias("source"))
    return slicer.counterfactuals(cases).select("seq", "original", "perturbed", "causal", "score")
