"""Registered queries, named by operator, and the SQL that must give the same rows.

All run over the whole tables through the adapters in ``tracewright.sources.adapters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, compiled, expr
from ..operators import names, slicer, sva, trace
from ..sources import adapters, dump
from . import build, report

QUERIES: dict = {}
ORACLES: dict = {}

#: What the oracles share, in DuckDB's SQL.
WAVE = """
ev AS (SELECT 'events' AS trace_id, epoch_us(ts) AS t, event_id AS seq, user_id, event_type, value FROM events),
wave AS (SELECT trace_id, concat('top.u', CAST(user_id % 8 AS VARCHAR), '.', event_type) AS signal, t, seq,
  lpad(bin(CAST(floor(value) AS BIGINT) % 16), 4, '0') AS value FROM ev),
clk AS (SELECT trace_id, t, seq, CASE WHEN event_type = 'view' THEN '1' ELSE '0' END AS value FROM ev),
edges AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY t, seq) - 1 AS cycle, t AS t_start FROM
  (SELECT *, lag(value) OVER (PARTITION BY trace_id ORDER BY t, seq) AS prev FROM clk)
  WHERE value = '1' AND (prev IS NULL OR prev IN ('0', 'x', 'X'))),
placed AS (SELECT w.trace_id, w.signal, w.t, w.seq, w.value, coalesce(e.cycle, 0) AS cycle FROM wave w ASOF LEFT JOIN edges e ON w.trace_id = e.trace_id AND w.t >= e.t_start),
sampled AS (SELECT trace_id, signal, cycle, last(value ORDER BY t, seq) AS value FROM placed GROUP BY ALL),
signals AS (SELECT DISTINCT trace_id, signal FROM wave),
cv AS (SELECT g.trace_id, g.signal, g.cycle, coalesce(s.value, 'x') AS value FROM
  (SELECT s.trace_id, s.signal, e.cycle FROM signals s JOIN edges e USING (trace_id)) g
  ASOF LEFT JOIN sampled s ON g.trace_id = s.trace_id AND g.signal = s.signal AND g.cycle >= s.cycle),
moved AS (SELECT * FROM (SELECT *, lag(value) OVER w AS old_value, row_number() OVER w AS n FROM cv WINDOW w AS (PARTITION BY trace_id, signal ORDER BY cycle))
  WHERE n > 1 AND value IS DISTINCT FROM old_value)
"""
DEPS = """
deps AS (SELECT p_partkey AS dep_id, CAST(p_partkey // 3 AS INTEGER) AS target,
  CAST(CASE WHEN p_size % 11 = 0 THEN p_partkey // 6 WHEN p_size % 13 = 0 THEN p_partkey // 3 ELSE p_partkey // 3 * 3 + 1 + p_size % 7 END AS INTEGER) AS source,
  (['combinational', 'sequential', 'assertion'])[p_size % 3 + 1] AS dep_type FROM part)
"""
SLICE = """
steps AS (SELECT DISTINCT target, source, dep_type FROM (SELECT *, row_number() OVER (PARTITION BY target, source, dep_type ORDER BY dep_id) AS n FROM deps WHERE source <> target)),
r AS (SELECT 0 AS signal, 5 AS cycle UNION
  SELECT s.source, CASE WHEN s.dep_type = 'sequential' THEN greatest(r.cycle - 1, 0) ELSE r.cycle END FROM r JOIN steps s ON s.target = r.signal)
"""


GRAPH = """
smp AS (SELECT l_partkey AS signal, l_linenumber - 1 AS cycle, max(CAST(floor(l_quantity) AS BIGINT)) % 16 AS v FROM lineitem GROUP BY ALL),
cand AS (SELECT s.dep_id, s.dep_type, s.source, CASE WHEN s.dep_type = 'sequential' THEN greatest(r.cycle - 1, 0) ELSE r.cycle END AS source_cycle, s.target, r.cycle AS target_cycle
  FROM r JOIN deps s ON s.target = r.signal WHERE s.source <> s.target),
told AS (SELECT c.*, s1.v AS v, s1.v IS NOT NULL AND t1.v IS NOT NULL AS known, coalesce(s0.v <> s1.v AND t0.v <> t1.v, false) AND c.dep_id % 4 = 2 AS toggled FROM cand c
  LEFT JOIN smp s1 ON s1.signal = c.source AND s1.cycle = c.source_cycle LEFT JOIN smp s0 ON s0.signal = c.source AND s0.cycle = c.source_cycle - 1
  LEFT JOIN smp t1 ON t1.signal = c.target AND t1.cycle = c.target_cycle LEFT JOIN smp t0 ON t0.signal = c.target AND t0.cycle = c.target_cycle - 1),
judged AS (SELECT *, CAST(CASE WHEN NOT known THEN 0.3 WHEN dep_id % 4 = 0 THEN 0.75 WHEN dep_id % 4 = 3 OR dep_id % 4 = 1 AND v IN (0, 15) THEN 1.0 WHEN toggled THEN 0.7 ELSE 0.3 END AS DOUBLE) AS score,
  CASE dep_type WHEN 'sequential' THEN 'state' WHEN 'assertion' THEN 'conditional' ELSE CASE WHEN toggled THEN 'toggle' ELSE 'expr_eval' END END AS type FROM told),
ge AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY source, source_cycle, target, target_cycle ORDER BY dep_id) = 1),
gv AS (SELECT r.signal, r.cycle, coalesce(lpad(bin(m.v), 4, '0'), 'x') AS value FROM r LEFT JOIN smp m ON m.signal = r.signal AND m.cycle = r.cycle),
gn AS (SELECT substring(md5(concat('s', gv.signal, '@', gv.cycle, '=', value)), 1, 12) AS id, signal, cycle, value, signal = 0 AND cycle = 5 AS is_endpoint,
  CASE WHEN signal = 0 AND cycle = 5 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(score) FROM ge WHERE source = gv.signal AND source_cycle = gv.cycle) * 0.9::DOUBLE, 0.0::DOUBLE) END AS suspect_score,
  NOT (signal = 0 AND cycle = 5) AND NOT EXISTS (SELECT 1 FROM ge WHERE target = gv.signal AND target_cycle = gv.cycle) AS is_root,
  signal NOT IN (SELECT target FROM deps) AS rtl_missing FROM gv)
"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trace and its clock edges; those as a table, for operators read them several times."""
    return adapters.wave(spark, sf_dir), slicer.table(trace.clock_edges(adapters.clock(spark, sf_dir)))


@query("w01_clock_edges", f"WITH {WAVE} SELECT trace_id, cycle, t_start FROM edges")
def w01(spark, sf_dir):
    return trace.clock_edges(adapters.clock(spark, sf_dir))


@query("w03_cycle_count", f"WITH {WAVE} SELECT trace_id, count(*) AS cycles FROM edges GROUP BY trace_id")
def w03(spark, sf_dir):
    return trace.cycle_count(_trace(spark, sf_dir)[1])


@query("w04_time_to_cycle", f"WITH {WAVE} SELECT signal, t, seq, cycle FROM placed")
def w04(spark, sf_dir):
    return trace.time_to_cycle(*_trace(spark, sf_dir)).select("signal", "t", "seq", "cycle")


EVERY_CYCLE = f"""WITH {WAVE}, c AS (SELECT unnest(range(-1, n + 1)) AS cycle FROM (SELECT count(*) AS n FROM edges))
SELECT c.cycle, CASE WHEN c.cycle < 0 THEN (SELECT min(t) FROM wave) ELSE coalesce(e.t_start, (SELECT max(t) FROM wave)) END AS t FROM c LEFT JOIN edges e ON e.cycle = c.cycle"""


# every cycle of the trace, one before and one after
@query("w05_cycle_to_time", EVERY_CYCLE)
def w05(spark, sf_dir):
    changes, edges = _trace(spark, sf_dir)
    asked = trace.cycle_count(edges).select("trace_id", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("cycles"))).alias("cycle"))
    return trace.cycle_to_time(asked, edges, changes).select("cycle", "t")


@query("w06_cycle_range", f"""WITH {WAVE} SELECT trace_id, cycle, t_start, coalesce(lead(t_start) OVER (ORDER BY cycle) - 1, (SELECT max(t) FROM wave)) AS t_end FROM edges""")
def w06(spark, sf_dir):
    changes, edges = _trace(spark, sf_dir)
    return trace.cycle_ranges(edges, changes)


@query("w07_cycle_sample", f"WITH {WAVE} SELECT trace_id, signal, cycle, value FROM cv")
def w07(spark, sf_dir):
    return trace.cycle_values(*_trace(spark, sf_dir))


@query("w07_cycle_runs", f"""WITH {WAVE} SELECT trace_id, signal, cycle AS cycle_from,
coalesce(lead(cycle) OVER (PARTITION BY trace_id, signal ORDER BY cycle), (SELECT count(*) FROM edges)) - 1 AS cycle_to, value FROM sampled""")
def w07r(spark, sf_dir):
    return trace.cycle_runs(*_trace(spark, sf_dir))


def _dumped(spark: SparkSession, sf_dir: str) -> str:
    """The trace as dumps, one for each scope."""
    wave = adapters.wave(spark, sf_dir)
    return dump.saved_dumps(wave.withColumn("trace_id", names.hierarchy(F.col("signal"))))


@query("s01_dump_scan", f"WITH {WAVE} SELECT trace_id, signal, cycle, value FROM cv")
def s01(spark, sf_dir):
    """The samples of w07 from written dumps, read back in splits of 256 KB."""
    changes = dump.read_dumps(spark, _dumped(spark, sf_dir), split_bytes=1 << 18).withColumn("trace_id", F.lit("events"))
    return trace.cycle_values(changes, slicer.table(trace.clock_edges(adapters.clock(spark, sf_dir))))


@query("s02_dump_filters", f"""WITH {WAVE}, h AS (SELECT (min(t) + max(t)) // 2 AS half FROM wave)
SELECT split_part(signal, '.', 1) || '.' || split_part(signal, '.', 2) AS trace_id, signal, t, value FROM wave, h WHERE signal IN ('top.u1.view', 'top.u2.click', 'top.u2.view') AND t > half""")
def s02(spark, sf_dir):
    """Signals as an option of the reader, times as a filter, which the session may push down."""
    wave = adapters.wave(spark, sf_dir)
    half = wave.agg(F.floor((F.min("t") + F.max("t")) / 2).cast("long")).first()[0]
    found = dump.read_dumps(spark, _dumped(spark, sf_dir), signals=["top.u1.view", "top.u2.click", "top.u2.view"], split_bytes=1 << 18)
    return found.where(F.col("t") > half).select("trace_id", "signal", "t", "value")


@query("w08_cycle_start_sample", f"""WITH {WAVE}, l AS (SELECT trace_id, signal, t, max_by(value, seq) AS value FROM wave GROUP BY ALL)
SELECT g.trace_id, g.signal, g.cycle, l.value FROM (SELECT s.trace_id, s.signal, e.cycle, e.t_start FROM signals s JOIN edges e USING (trace_id)) g
ASOF JOIN l ON g.trace_id = l.trace_id AND g.signal = l.signal AND g.t_start >= l.t""")
def w08(spark, sf_dir):
    return trace.start_samples(*_trace(spark, sf_dir))


@query("w09_transitions", f"""WITH {WAVE}, m AS (SELECT *, lag(value) OVER (PARTITION BY trace_id, signal ORDER BY t, seq) AS old_value FROM placed)
SELECT trace_id, signal, cycle, t, old_value, value AS new_value FROM m WHERE old_value IS NOT NULL AND old_value <> value""")
def w09(spark, sf_dir):
    return trace.transitions(*_trace(spark, sf_dir))


@query("w10_find_signal", f"WITH {WAVE} SELECT trace_id, signal FROM signals WHERE lower(signal) LIKE '%view%' ORDER BY signal LIMIT 5")
def w10(spark, sf_dir):
    known = adapters.wave(spark, sf_dir).select("trace_id", "signal").distinct()
    return trace.find_signal(known, "VIEW", 5, trace.name_index(known))


@query("w11_snapshot", f"WITH {WAVE} SELECT signal, value FROM cv WHERE cycle = 7")
def w11(spark, sf_dir):
    return trace.snapshot(trace.cycle_values(*_trace(spark, sf_dir)), 7).select(F.explode("values").alias("signal", "value"))


@query("w12_value_changes", f"WITH {WAVE} SELECT trace_id, signal, cycle, old_value, value AS new_value FROM moved")
def w12(spark, sf_dir):
    return trace.run_changes(trace.cycle_runs(*_trace(spark, sf_dir)))


@query("w12_sample_changes", f"WITH {WAVE} SELECT trace_id, signal, cycle, old_value, value AS new_value FROM moved")
def w12s(spark, sf_dir):
    return trace.value_changes(trace.cycle_values(*_trace(spark, sf_dir)))


@query("w13_value_table", f"WITH {WAVE} SELECT signal, cycle, value FROM cv WHERE signal IN ('top.u0.view', 'top.u1.view') AND cycle BETWEEN 3 AND 40")
def w13(spark, sf_dir):
    changes, edges = _trace(spark, sf_dir)
    return trace.value_table(trace.cycle_values(changes, edges), ["top.u0.view", "top.u1.view"], 3, 40).select("signal", "cycle", "value")


@query("s03_signals", f"WITH {WAVE} SELECT signal FROM signals")
def s03(spark, sf_dir):
    return trace.signals(adapters.wave(spark, sf_dir)).select("signal")


@query("s04_metadata", f"WITH {WAVE} SELECT trace_id, min(t) AS start_time, max(t) AS end_time, count(DISTINCT signal) AS signal_count, (SELECT count(*) FROM edges) AS cycle_count, 'top.clock' AS clock FROM wave GROUP BY trace_id")
def s04(spark, sf_dir):
    clock = adapters.clock(spark, sf_dir)
    told = trace.metadata(*_trace(spark, sf_dir), trace.clock_signal(trace.signals(clock)))
    return told.select("trace_id", "start_time", "end_time", "signal_count", "cycle_count", "clock")


@query("a02_fail_cycle", f"""WITH {WAVE}, b AS (SELECT trace_id, signal, t, seq, cycle, substring(value, 4, 1) AS value FROM placed),
p AS (SELECT *, lag(value) OVER (PARTITION BY trace_id, signal ORDER BY t, seq) AS prev FROM b)
SELECT trace_id, signal, coalesce(min(cycle) FILTER (prev = '1' AND value = '0'), min(cycle) FILTER (value = '0'), 0) AS cycle FROM p GROUP BY trace_id, signal""")
def a02(spark, sf_dir):
    changes, edges = _trace(spark, sf_dir)
    return trace.fail_cycle(changes.withColumn("value", F.substring("value", 4, 1)), edges)


@query("a05_assertion_signals", f"""WITH {WAVE}, s AS (SELECT split_part(signal, '.', 2) AS trace_id, signal FROM signals UNION ALL SELECT DISTINCT split_part(signal, '.', 2), 'top.must_hold' FROM signals)
SELECT trace_id, signal FROM s WHERE CASE WHEN trace_id IN ('u0', 'u1', 'u2') THEN regexp_matches(lower(signal), 'assert|fail|error|property|should|must|valid|check') ELSE split_part(signal, '.', 3) IN ('view', 'click') END""")
def a05(spark, sf_dir):
    """By labels where a trace has such signals, by keyword in the three that don't."""
    named = adapters.wave(spark, sf_dir).select(F.split("signal", r"\.")[1].alias("trace_id"), "signal").distinct()
    own = named.where(~(F.col("trace_id").isin("u0", "u1", "u2") & F.col("signal").rlike("view|click")))
    every = own.unionByName(named.select("trace_id").distinct().withColumn("signal", F.lit("top.must_hold")))
    labels = spark.createDataFrame([("view",), ("click",)], "label string")
    return trace.assertion_signals(every, labels)


VALUES = "v AS (SELECT value AS a, lag(value) OVER (PARTITION BY signal ORDER BY t, seq) AS b, seq FROM wave), p AS (SELECT * FROM v WHERE b IS NOT NULL)"


def _pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("signal").orderBy("t", "seq")
    return adapters.wave(spark, sf_dir).select("seq", F.col("value").alias("a"), F.lag("value").over(w).alias("b")).where("b is not null")


@query("b01_parse_invert", f"WITH {WAVE}, {VALUES} SELECT seq, CAST(list_sum([CAST(a[i] AS INTEGER) * CAST(pow(2, 4 - i) AS INTEGER) FOR i IN [1, 2, 3, 4]]) AS BIGINT) AS number, translate(a, '01', '10') AS inverse, contains(a, '1') AS truth FROM p")
def b01(spark, sf_dir):
    a = F.col("a")
    return _pairs(spark, sf_dir).select("seq", bits.parse_binary(a).alias("number"), bits.invert(a).alias("inverse"), bits.truthy(a).alias("truth"))


@query("b03_differ", f"""WITH {WAVE}, {VALUES}, d AS (SELECT seq, a, b, len([i FOR i IN [1, 2, 3, 4] IF a[i] <> b[i]]) AS n FROM p)
SELECT seq, n > 0 AS differ, CAST(n AS INTEGER) AS bits, least(1.0, n / 4.0 + 0.5)::DOUBLE AS score FROM d""")
def b03(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("seq", bits.values_differ(a, b).alias("differ"), bits.differing_bits(a, b).alias("bits"), bits.contribution(a, b).alias("score"))


NUMBERS = "n AS (SELECT seq, a, b, CAST(list_sum([CAST(a[i] AS INTEGER) * CAST(pow(2, 4 - i) AS INTEGER) FOR i IN [1, 2, 3, 4]]) AS BIGINT) AS x, CAST(list_sum([CAST(b[i] AS INTEGER) * CAST(pow(2, 4 - i) AS INTEGER) FOR i IN [1, 2, 3, 4]]) AS BIGINT) AS y FROM p)"


@query("e06_bitwise", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, lpad(bin(x & y), 4, '0') AS "and", lpad(bin(x | y), 4, '0') AS "or", lpad(bin(xor(x, y)), 4, '0') AS "xor", lpad(bin(15 - xor(x, y)), 4, '0') AS "xnor" FROM n""")
def e06(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("seq", bits.bit_and(a, b).alias("and"), bits.bit_or(a, b).alias("or"), bits.bit_xor(a, b).alias("xor"), bits.bit_xnor(a, b).alias("xnor"))


@query("e09_arithmetic", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, lpad(bin((x + y) % 16), 4, '0') AS plus, lpad(bin((x - y + 16) % 16), 4, '0') AS minus, lpad(bin((x * y) % 16), 4, '0') AS times,
CASE WHEN y <> 0 THEN lpad(bin(x // y), 4, '0') END AS over, CASE WHEN y <> 0 THEN lpad(bin(x % y), 4, '0') END AS rest, lpad(bin((x << 1) % 16), 4, '0') AS shifted,
CASE WHEN x < y THEN '1' ELSE '0' END AS less, CASE WHEN a = b THEN '1' ELSE '0' END AS same, lpad(bin((16 - x) % 16), 4, '0') AS negative FROM n""")
def e09(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    named = {"plus": "+", "minus": "-", "times": "*", "over": "/", "rest": "%"}
    return _pairs(spark, sf_dir).select("seq", *(bits.arithmetic(a, op, b).alias(n) for n, op in named.items()), bits.arithmetic(a, "<<", F.lit("1")).alias("shifted"), bits.compare(a, "<", b).alias("less"), bits.equal(a, b).alias("same"), bits.negate(a).alias("negative"))


ARITHMETIC = {"plus": "+", "minus": "-", "times": "*", "over": "/", "rest": "%"}
COMPARED = {"less": "<", "more": ">", "upto": "<=", "least": ">="}


def _spread(pairs: DataFrame) -> DataFrame:
    """The pairs dealt over all tasks: behind the window they lie in as many as there are signals, at most."""
    return pairs.repartition("seq")


def _all_operators(operands: DataFrame) -> DataFrame:
    """Every arithmetic operator and comparison on operands(seq, bits, a, b); what carries from bit to bit goes by whole columns to Python's integers."""
    a, b = F.col("a"), F.col("b")
    told = [expr.operator_udf(op)(a, b).alias(n) for n, op in ARITHMETIC.items()] + [bits.compare(a, op, b).alias(n) for n, op in COMPARED.items()]
    moved = [bits.arithmetic(a, "<<", F.lit("101")).alias("shifted"), bits.arithmetic(a, ">>>", F.lit("111")).alias("back")]
    return operands.select("seq", "bits", *told, *moved, bits.equal(a, b).alias("same"), expr.operator_udf("u-")(a).alias("negative"))


def _all_operators_sql(n: int, a: str, b: str) -> str:
    """The same on n-bit numbers, n up to 64, in arithmetic of 127 bits."""
    top = f"{1 << n}::HUGEINT"
    told = {"plus": f"({a} + {b}) % {top}", "minus": f"({a} + {top} - {b}) % {top}", "times": f"({a} * ({b} % 4294967296) + {a} * ({b} // 4294967296) % 4294967296 * 4294967296) % {top}", "shifted": f"({a} * 32) % {top}", "back": f"{a} // 128", "negative": f"({top} - {a}) % {top}"}
    divided = {"over": f"{a} // {b}", "rest": f"{a} % {b}"}
    parts = [f"lpad(bin({v}), {n}, '0') AS {k}" for k, v in told.items()] + [f"CASE WHEN {b} > 0 THEN lpad(bin({v}), {n}, '0') END AS {k}" for k, v in divided.items()]
    parts += [f"CASE WHEN {a} {op} {b} THEN '1' ELSE '0' END AS {k}" for k, op in (COMPARED | {"same": "="}).items()]
    return f"SELECT seq, {n} AS bits, {', '.join(parts)} FROM (SELECT seq, {{a}}::HUGEINT AS a, {{b}}::HUGEINT AS b FROM n)"


@query("e09_wide_arithmetic", f"""WITH {WAVE}, {VALUES}, {NUMBERS}
{_all_operators_sql(60, "a", "b").format(a=f"x * {((1 << 60) - 1) // 15}", b=f"y * {((1 << 60) - 1) // 4095}")}
UNION ALL {_all_operators_sql(64, "a", "b").format(a=f"(x * 16 + y)::HUGEINT * {((1 << 64) - 1) // 255}", b=f"(y * 256 + x)::HUGEINT * {((1 << 64) - 1) // 65535}")}""")
def e09w(spark, sf_dir):
    """Operands of 60 and 64 bits: patterns of the trace's values."""
    p, zeros = _spread(_pairs(spark, sf_dir)), F.lit("0000")
    sixty = p.select("seq", F.lit(60).alias("bits"), F.repeat("a", F.lit(15)).alias("a"), F.repeat(F.concat(zeros, zeros, "b"), F.lit(5)).alias("b"))
    more = p.select("seq", F.lit(64).alias("bits"), F.repeat(F.concat("a", "b"), F.lit(8)).alias("a"), F.repeat(F.concat(zeros, "b", zeros, "a"), F.lit(4)).alias("b"))
    return _all_operators(sixty.unionByName(more))


# with a = x * K and b = y * K, K = 1 + 16 + ... + 16 ** 49, and 15 * K = 2 ** 200 - 1: results are patterns but for their last digits
DIGITS = "n4 AS (SELECT seq, x, y, x * y // 15 AS q, x * y % 15 AS s FROM n)"


def _pattern(digit: str, last: str, many: int = 49) -> str:
    return f"repeat(lpad(bin({digit}), 4, '0'), {many}) || lpad(bin({last}), {4 * (50 - many)}, '0')"


@query("e09_vectors_of_200_bits", f"""WITH {WAVE}, {VALUES}, {NUMBERS}, {DIGITS}
SELECT seq, CASE WHEN x + y <= 15 THEN {_pattern("x + y", "x + y")} ELSE {_pattern("x + y - 15", "x + y - 16")} END AS plus,
CASE WHEN x >= y THEN {_pattern("x - y", "x - y")} ELSE {_pattern("15 + x - y", "16 + x - y")} END AS minus,
CASE WHEN s * 17 >= q THEN {_pattern("s", "s * 17 - q", 48)} ELSE {_pattern("15", "256 + s * 17 - q", 48)} END AS times,
CASE WHEN y > 0 THEN lpad(bin(x // y), 200, '0') END AS over, CASE WHEN y > 0 THEN {_pattern("x % y", "x % y")} END AS rest,
CASE WHEN x = 0 THEN repeat('0', 200) ELSE {_pattern("15 - x", "16 - x")} END AS negative,
CASE WHEN x < y THEN '1' ELSE '0' END AS less, CASE WHEN x >= y THEN '1' ELSE '0' END AS least,
repeat(lpad(bin(x), 4, '0'), 50 - y) || repeat('0000', y) AS shifted, repeat('0', 4 * x + 3) || substring(repeat(lpad(bin(y), 4, '0'), 50), 1, 197 - 4 * x) AS back FROM n4""")
def e09v(spark, sf_dir):
    p = _spread(_pairs(spark, sf_dir)).select("seq", F.repeat("a", F.lit(50)).alias("a"), F.repeat("b", F.lit(50)).alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
    a, b = F.col("a"), F.col("b")
    told = [expr.operator_udf(op)(a, b).alias(n) for n, op in ARITHMETIC.items() if n != "times"] + [expr.operator_udf("*")(a, F.col("y")).alias("times"), expr.operator_udf("u-")(a).alias("negative")]
    moved = [bits.arithmetic(a, "<<", F.concat("y", F.lit("00"))).alias("shifted"), bits.arithmetic(b, ">>", F.concat("x", F.lit("11"))).alias("back")]
    return p.select("seq", *told, bits.compare(a, "<", b).alias("less"), bits.compare(a, ">=", b).alias("least"), *moved)


@query("e16_reductions", f"WITH {WAVE}, {VALUES} SELECT seq, CASE WHEN a = '1111' THEN '1' ELSE '0' END AS every, CASE WHEN a <> '0000' THEN '1' ELSE '0' END AS some, CAST(length(replace(a, '0', '')) % 2 AS VARCHAR) AS parity, CASE WHEN a = '0000' THEN '1' ELSE '0' END AS nothing FROM p")
def e16(spark, sf_dir):
    a = F.col("a")
    return _pairs(spark, sf_dir).select("seq", bits.reduce_and(a).alias("every"), bits.reduce_or(a).alias("some"), bits.reduce_xor(a).alias("parity"), bits.logical_not(a).alias("nothing"))


@query("e20_expressions", f"""WITH {WAVE}, {VALUES}, {NUMBERS} SELECT seq, CASE WHEN a <> '0000' THEN lpad(bin(x & y), 4, '0') ELSE translate(b, '01', '10') END AS chosen,
CASE WHEN x > y THEN CASE WHEN a <> '0000' AND b <> '0000' THEN '1' ELSE '0' END ELSE '1' END AS implied, a || b AS joined FROM n""")
def e20(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("env", F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")))
    for name, text in {"chosen": "a ? a & b : ~b", "implied": "a > b |-> ##[1:4] a && b", "joined": "{a, b}"}.items():
        rows = compiled.evaluated_text(rows, name, text)
    return rows.select("seq", "chosen", "implied", "joined")


@query("r01_names", f"WITH {WAVE} SELECT signal, split_part(signal, '.', 3) AS base, concat(split_part(signal, '.', 1), '.', split_part(signal, '.', 2)) AS hierarchy, signal AS qualified FROM signals")
def r01(spark, sf_dir):
    s = F.col("signal")
    told = adapters.wave(spark, sf_dir).select("signal").distinct()
    return told.select("signal", names.base(s).alias("base"), names.hierarchy(s).alias("hierarchy"), names.qualify(names.hierarchy(s), names.base(s)).alias("qualified"))


@query("p16_dependency_lookup", f"""WITH {DEPS}, named AS (SELECT dep_id, concat('m', dep_id % 3) AS module, concat('s', target) AS target, concat('s', source) AS source, dep_type FROM deps),
w AS (SELECT DISTINCT module, source AS signal FROM named UNION SELECT 'm1', concat('top.u.', source) FROM named UNION SELECT NULL, concat(module, '.', source) FROM named)
SELECT w.signal, w.module AS signal_module, d.dep_id, d.target, d.source, d.dep_type FROM w JOIN named d
ON split_part(w.signal, '.', -1) = d.target AND (strpos(w.signal, '.') = 0 OR true)""")
def p16(spark, sf_dir):
    """Each source as a name of its module, as a dotted name and as a qualified one without a module: targets are plain names, so all of
    a name's dependencies match."""
    d = _named_deps(spark, sf_dir)
    own = d.select("module", F.col("source").alias("signal"))
    dotted = d.select(F.lit("m1").alias("module"), F.concat(F.lit("top.u."), "source").alias("signal"))
    free = d.select(F.lit(None).cast("string").alias("module"), F.concat_ws(".", "module", "source").alias("signal"))
    wanted = own.union(dotted).union(free).distinct()
    return names.lookup(d, wanted).select("signal", "signal_module", "dep_id", "target", "source", "dep_type")


@query("p16_base_names", f"""WITH {DEPS}, named AS (SELECT dep_id, concat('m', dep_id % 3) AS module, concat('s', target) AS target FROM deps)
SELECT concat('p.', d.target) AS signal, 'm1' AS signal_module, d.dep_id FROM named d WHERE d.module = 'm1' UNION ALL SELECT concat('q.', d.target), NULL, d.dep_id FROM named d""")
def p16b(spark, sf_dir):
    """Targets u.s<n>, whose base name alone a name shares: it counts in the name's module, in any where the name has none."""
    d = _named_deps(spark, sf_dir).withColumn("target", F.concat(F.lit("u."), "target"))
    inside = d.select(F.lit("m1").alias("module"), F.concat(F.lit("p."), F.substring("target", 3, 99)).alias("signal"))
    free = d.select(F.lit(None).cast("string").alias("module"), F.concat(F.lit("q."), F.substring("target", 3, 99)).alias("signal"))
    return names.lookup(d, inside.union(free).distinct()).select("signal", "signal_module", "dep_id")


def _named_deps(spark, sf_dir):
    s = F.lit("s")
    return adapters.deps(spark, sf_dir).select("dep_id", F.concat(F.lit("m"), (F.col("dep_id") % 3).cast("string")).alias("module"), F.concat(s, F.col("target").cast("string")).alias("target"), F.concat(s, F.col("source").cast("string")).alias("source"), "dep_type")


@query("p17_dependency_index", f"""WITH {DEPS}, named AS (SELECT concat('m', dep_id % 3) AS module, concat('s', target) AS target, concat('s', source, ':', dep_type) AS x FROM deps),
k AS (SELECT target AS key, x FROM named UNION ALL SELECT concat(module, '.', target), x FROM named)
SELECT key, string_agg(DISTINCT x, ',' ORDER BY x) AS sources FROM k GROUP BY key""")
def p17(spark, sf_dir):
    index = names.dependency_index(_named_deps(spark, sf_dir))
    return index.select("key", F.array_join(F.array_sort(F.transform("sources", lambda x: F.concat(x["source"], F.lit(":"), x["dep_type"]))), ",").alias("sources"))


@query("g03_self_loops", f"WITH {DEPS} SELECT dep_id, target FROM deps WHERE source = target")
def g03(spark, sf_dir):
    return slicer.self_loops(adapters.deps(spark, sf_dir)).select("dep_id", "target")


@query("c01_parent_cycle", f"WITH {DEPS} SELECT dep_id, CAST(CASE WHEN dep_type = 'sequential' THEN greatest(dep_id % 3 - 1, 0) ELSE dep_id % 3 END AS BIGINT) AS cycle FROM deps")
def c01(spark, sf_dir):
    return adapters.deps(spark, sf_dir).select("dep_id", slicer.parent_cycle(F.col("dep_type"), F.col("dep_id") % 3).cast("bigint").alias("cycle"))


def _slice(spark, sf_dir):
    seeds = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit(0).alias("signal"), F.lit(5).alias("cycle"))
    return slicer.backward_slice(adapters.deps(spark, sf_dir), seeds, max_depth=60)


@query("g02_backward_slice", f"WITH RECURSIVE {DEPS}, {SLICE} SELECT signal, cycle FROM r")
def g02(spark, sf_dir):
    return _slice(spark, sf_dir)[0].select("signal", "cycle")


@query("g06_depth_bound", f"""WITH RECURSIVE {DEPS}, steps AS (SELECT DISTINCT target, source, dep_type FROM deps WHERE source <> target),
r AS (SELECT 0 AS signal, 5 AS cycle, 0 AS depth UNION
  SELECT s.source, CASE WHEN s.dep_type = 'sequential' THEN greatest(r.cycle - 1, 0) ELSE r.cycle END, depth + 1 FROM r JOIN steps s ON s.target = r.signal WHERE depth <= 4)
SELECT signal, cycle, min(depth) AS depth FROM r GROUP BY signal, cycle""")
def g06(spark, sf_dir):
    """A slice that its greatest depth cuts: nodes at that depth are still sliced, those behind it aren't."""
    seeds = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit(0).alias("signal"), F.lit(5).alias("cycle"))
    return slicer.backward_slice(adapters.deps(spark, sf_dir), seeds, max_depth=4)[0].select("signal", "cycle", "depth")


def _bounded_sql(levels: int, most: int) -> str:
    """Level by level: of the nodes that are new, the first by cycle and signal until there are ``most``."""
    out = "n0 AS (SELECT 0 AS signal, 5 AS cycle, 0 AS depth)"
    for k in range(levels):
        out += f""", f{k} AS (SELECT DISTINCT s.source AS signal, CASE WHEN s.dep_type = 'sequential' THEN greatest(n.cycle - 1, 0) ELSE n.cycle END AS cycle FROM n{k} n JOIN steps s ON s.target = n.signal WHERE n.depth = {k}),
n{k + 1} AS (SELECT * FROM n{k} UNION ALL SELECT signal, cycle, {k + 1} FROM (SELECT *, row_number() OVER (ORDER BY cycle, signal) AS n FROM f{k} ANTI JOIN n{k} USING (signal, cycle)) WHERE n <= {most} - (SELECT count(*) FROM n{k}))"""
    return out


@query("g07_node_bound", f"""WITH {DEPS}, steps AS (SELECT DISTINCT target, source, dep_type FROM deps WHERE source <> target),
{_bounded_sql(7, 90)} SELECT signal, cycle, depth, (SELECT count(*) FROM n7) >= 90 AS is_cut FROM n7""")
def g07(spark, sf_dir):
    """A slice that its number of nodes cuts."""
    seeds = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit(0).alias("signal"), F.lit(5).alias("cycle"))
    nodes, _, cut = slicer.backward_slice(adapters.deps(spark, sf_dir), seeds, max_depth=6, max_nodes=90)
    return nodes.join(cut.withColumn("is_cut", F.lit(True)), "trace_id", "left").select("signal", "cycle", "depth", F.coalesce("is_cut", F.lit(False)).alias("is_cut"))


@query("a09_last_cycle", f"WITH {WAVE} SELECT trace_id, count(*) - 1 AS cycle, max(t_start) AS t_start FROM edges GROUP BY trace_id")
def a09(spark, sf_dir):
    """Where an analysis that asks for the last cycle begins."""
    edges = _trace(spark, sf_dir)[1]
    return edges.join(trace.cycle_count(edges).select("trace_id", (F.col("cycles") - 1).alias("cycle")), ["trace_id", "cycle"])


@query("g05_slice_edges", f"""WITH RECURSIVE {DEPS}, {SLICE} SELECT DISTINCT s.source, CASE WHEN s.dep_type = 'sequential' THEN greatest(r.cycle - 1, 0) ELSE r.cycle END AS source_cycle, s.target, r.cycle AS target_cycle FROM r JOIN steps s ON s.target = r.signal""")
def g05(spark, sf_dir):
    return _slice(spark, sf_dir).edges.select("source", "source_cycle", "target", "target_cycle")


@query("g08_roots", f"""WITH RECURSIVE {DEPS}, {SLICE} SELECT signal, cycle FROM r WHERE signal NOT IN (SELECT target FROM steps) AND NOT (signal = 0 AND cycle = 5)""")
def g08(spark, sf_dir):
    return slicer.roots(*_slice(spark, sf_dir)[:2]).select("signal", "cycle")


@query("g01_node_ids", f"WITH {WAVE} SELECT signal, cycle, substring(md5(concat(signal, '@', CAST(cycle AS VARCHAR), '=', value)), 1, 12) AS id FROM cv")
def g01(spark, sf_dir):
    samples = trace.cycle_values(*_trace(spark, sf_dir))
    return samples.select("signal", "cycle", slicer.node_id(F.col("signal"), F.col("cycle"), F.col("value")).alias("id"))


@query("c04_toggle_correlation", f"""WITH {WAVE}, {DEPS}, g AS (SELECT signal, row_number() OVER (ORDER BY signal) - 1 AS n, count(*) OVER () AS m FROM signals),
p AS (SELECT DISTINCT s.signal AS source, t.signal AS target FROM deps d JOIN g s ON s.n = d.source % s.m JOIN g t ON t.n = d.target % t.m WHERE d.dep_type = 'sequential' AND s.signal <> t.signal),
m AS (SELECT trace_id, signal, cycle, value, lag(value) OVER (PARTITION BY trace_id, signal ORDER BY cycle) AS old_value FROM sampled),
k AS (SELECT trace_id, signal, cycle FROM m WHERE CASE WHEN old_value IS NULL THEN cycle > 0 ELSE old_value <> value END)
SELECT p.source, p.target, a.cycle, 0.7::DOUBLE AS score FROM p JOIN k a ON a.signal = p.source JOIN k b ON b.signal = p.target AND b.trace_id = a.trace_id AND b.cycle = a.cycle""")
def c04(spark, sf_dir):
    """The pairs that sequential dependencies name; signals stand for the design's by number."""
    from pyspark.sql import Window

    wave, edges = _trace(spark, sf_dir)
    changes = trace.run_changes(trace.cycle_runs(wave, edges))
    known = trace.signals(wave).select("signal", (F.row_number().over(Window.orderBy("signal")) - 1).alias("n"))  # a row a signal
    many = known.count()
    asked = adapters.deps(spark, sf_dir).where("dep_type = 'sequential'").select((F.col("source") % many).alias("s"), (F.col("target") % many).alias("t")).distinct()
    pairs = asked.join(known.select(F.col("n").alias("s"), F.col("signal").alias("source")), "s").join(known.select(F.col("n").alias("t"), F.col("signal").alias("target")), "t")
    return slicer.toggle_correlation(changes, pairs.where("source <> target").select("source", "target")).select("source", "target", "cycle", "score")


@query("v01_time_window", f"""WITH {DEPS} SELECT dep_id, CASE WHEN dep_id % 3 = 2 THEN NULL ELSE CAST(dep_id % 7 AS INTEGER) END AS least, CASE dep_id % 3 WHEN 0 THEN CAST(dep_id % 7 + 9 AS INTEGER) WHEN 1 THEN CAST(dep_id % 7 AS INTEGER) END AS most FROM deps""")
def v01(spark, sf_dir):
    k, n = F.col("dep_id") % 3, (F.col("dep_id") % 7).cast("string")
    text = F.when(k == 0, F.concat(F.lit("a |-> ##["), n, F.lit(":"), (F.col("dep_id") % 7 + 9).cast("string"), F.lit("] b"))).when(k == 1, F.concat(F.lit("a |-> ##"), n, F.lit(" b"))).otherwise("a |-> b")
    least, most = sva.time_window(text)
    return adapters.deps(spark, sf_dir).select("dep_id", least.alias("least"), most.alias("most"))


@query("v03_trigger_cycle", f"""WITH {WAVE}, h AS (SELECT signal, cycle, substring(value, 1, 1) = '1' AS holds FROM cv),
g AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY signal ORDER BY cycle) AS run FROM h),
s AS (SELECT signal, run, min(cycle) AS cycle FROM g WHERE holds GROUP BY signal, run)
SELECT signal, max(cycle) AS trigger_cycle FROM s GROUP BY signal""")
def v03(spark, sf_dir):
    samples = trace.cycle_values(*_trace(spark, sf_dir))
    truth = samples.select(F.col("signal").alias("trace_id"), "cycle", (F.substring("value", 1, 1) == "1").alias("holds"))
    return sva.trigger_cycle(truth).withColumnRenamed("trace_id", "signal")


@query("v05_interesting_cycles", f"""WITH {WAVE}, f AS (SELECT signal, cycle, row_number() OVER (PARTITION BY signal ORDER BY cycle) AS n FROM moved WHERE cycle BETWEEN 20 AND 60),
u AS (SELECT signal, cycle FROM f WHERE n <= 5 UNION SELECT signal, unnest([20, 60, 30, 40, 50]) FROM (SELECT DISTINCT signal FROM moved)),
o AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY cycle) AS n FROM u) SELECT signal, CAST(cycle AS BIGINT) AS cycle FROM o WHERE n <= 8""")
def v05(spark, sf_dir):
    changes = trace.value_changes(trace.cycle_values(*_trace(spark, sf_dir)))
    windows = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit(20).cast("bigint").alias("first"), F.lit(60).cast("bigint").alias("last"))
    return sva.interesting_cycles(changes, windows).select("signal", "cycle")


@query("v07_window_edges", f"""WITH {WAVE}, c AS (SELECT DISTINCT signal FROM signals WHERE signal LIKE '%.click'),
f AS (SELECT signal, cycle, row_number() OVER (PARTITION BY signal ORDER BY cycle) AS n FROM moved JOIN c USING (signal) WHERE cycle BETWEEN 20 AND 60),
u AS (SELECT signal, cycle FROM f WHERE n <= 5 UNION SELECT signal, unnest([20, 60, 30, 40, 50]) FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY cycle) AS n FROM u)
SELECT signal AS source, CAST(cycle AS BIGINT) AS source_cycle, CAST(60 AS BIGINT) AS target_cycle, 'state' AS type, 0.8::DOUBLE AS score FROM o WHERE n <= 8 UNION ALL SELECT 'top.fail', 15, 60, 'conditional', 1.0::DOUBLE""")
def v07(spark, sf_dir):
    wave, edges = _trace(spark, sf_dir)
    changes = trace.value_changes(trace.cycle_values(wave, edges))
    windows = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit("top.fail").alias("endpoint"), F.lit(15).alias("trigger"), F.lit(5).alias("least"), F.lit(100).alias("most"), F.lit(60).alias("fail"))
    clicks = wave.where("signal like '%.click'").select("trace_id", "signal").distinct()
    return sva.window_graph(windows, clicks, changes)[1].select("source", "source_cycle", "target_cycle", "type", "score")


def _graph(spark, sf_dir):
    seeds = spark.range(1).select(F.lit("events").alias("trace_id"), F.lit("s0").alias("signal"), F.lit(5).alias("cycle"))
    return build.causal_graph(adapters.design(spark, sf_dir), adapters.samples(spark, sf_dir), seeds, max_depth=100)


@query("g11_causal_nodes", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT id, concat('s', signal) AS signal, cycle, value, suspect_score, is_root, is_endpoint, rtl_missing FROM gn""")
def g11n(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.drop("trace_id", "depth", "is_orphan", "rtl_refs")


@query("g11_causal_edges", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT concat('s', source) AS source, source_cycle, concat('s', target) AS target, target_cycle, dep_id, type, score FROM ge""")
def g11e(spark, sf_dir):
    return _graph(spark, sf_dir).edges.select("source", "source_cycle", "target", "target_cycle", "dep_id", "type", "score")


@query("g10_statistics", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT 'events' AS trace_id, count(*) AS nodes, (SELECT count(*) FROM ge) AS edges, count(*) FILTER (is_root) AS roots, count(*) FILTER (rtl_missing) AS undetermined, false AS max_depth_reached, false AS max_nodes_reached FROM gn""")
def g10(spark, sf_dir):
    return build.statistics(*_graph(spark, sf_dir), limit=100).drop("max_depth")


@query("k01_json", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT source_cycle AS cycle, count(*) AS edges, sum(CAST(score * 100 AS BIGINT)) AS hundredths FROM ge GROUP BY source_cycle""")
def k01(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    lines = report.json_lines(nodes, edges)
    read = F.from_json("line", "src_node_id string, contribution_score double, id string, cycle int").alias("r")
    told = lines.select("part", read).select("part", "r.*")
    ends = told.where("part = 'edge'").select("src_node_id", "contribution_score")
    met = ends.join(slicer.large(told.where("part = 'node'").select(F.col("id").alias("src_node_id"), "cycle")), "src_node_id")
    return met.groupBy("cycle").agg(F.count("*").alias("edges"), F.sum(F.round(F.col("contribution_score") * 100).cast("bigint")).alias("hundredths"))


@query("k02_dot", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH},
head AS (SELECT * FROM (VALUES (0, 'digraph CausalGraph {{'), (1, '    rankdir=TB;'), (2, '    node [shape=box, fontsize=10];'), (3, '    edge [fontsize=8];'), (4, '    subgraph cluster_legend {{'), (5, '        label="Legend";'), (6, '        fontsize=12;'), (7, '        style=dashed;'), (8, '        color=gray;'), (9, '        rank=same;'),
  (10, '        legend_endpoint [label="Endpoint\\n(assertion fail)", style=filled, fillcolor=red, fontcolor=white];'), (11, '        legend_root [label="Root Cause\\nCandidate", style=filled, fillcolor=green];'), (12, '        legend_high_suspect [label="High Suspicion\\n(score > 0.7)", style=filled, fillcolor=orange];'),
  (13, '        legend_medium_suspect [label="Medium Suspicion\\n(score > 0.4)", style=filled, fillcolor=yellow];'), (14, '        legend_rtl_missing [label="RTL Context\\nMissing", style=dashed, color=gray];'), (15, '        legend_normal [label="Normal Node"];'), (16, '    }}'), (1000, '}}')) t(part, line)),
styled AS (SELECT *, CASE WHEN is_endpoint THEN ', style=filled, fillcolor=red, fontcolor=white' WHEN is_root THEN ', style=filled, fillcolor=green' WHEN rtl_missing THEN ', style=dashed, color=gray' WHEN suspect_score > 0.7 THEN ', style=filled, fillcolor=orange' WHEN suspect_score > 0.4 THEN ', style=filled, fillcolor=yellow' ELSE '' END AS style FROM gn)
SELECT 'events' AS trace_id, part, line FROM head UNION ALL SELECT 'events', 100, concat('    "', id, '" [label="s', signal, '\\n@', cycle, '=', value, '"', style, '];') FROM styled
UNION ALL SELECT 'events', 101, concat('    "', id, '" -> legend_endpoint [style=invis, constraint=false];') FROM gn WHERE is_endpoint
UNION ALL SELECT 'events', 102, concat('    "', a.id, '" -> "', b.id, '" [label="', type, '\\n', printf('%.2f', score), '", color=', CASE type WHEN 'state' THEN 'purple' WHEN 'conditional' THEN 'orange' WHEN 'toggle' THEN 'green' ELSE 'blue' END, ', penwidth=', printf('%.2f', 1 + 2 * score), '];')
FROM ge JOIN gn a ON a.signal = ge.source AND a.cycle = ge.source_cycle JOIN gn b ON b.signal = ge.target AND b.cycle = ge.target_cycle""")
def k02(spark, sf_dir):
    return report.graph_lines(*_graph(spark, sf_dir)[:2])


@query("k08_summary", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH},
top AS (SELECT *, row_number() OVER (ORDER BY suspect_score DESC, id) AS place FROM gn WHERE is_root),
strong AS (SELECT ge.*, row_number() OVER (ORDER BY score DESC, a.id, b.id) AS place FROM ge JOIN gn a ON a.signal = ge.source AND a.cycle = ge.source_cycle JOIN gn b ON b.signal = ge.target AND b.cycle = ge.target_cycle WHERE score > 0.7)
SELECT 'events' AS trace_id, 1 AS part, 0 AS place, concat('- Total nodes: ', (SELECT count(*) FROM gn)) AS line UNION ALL SELECT 'events', 1, 1, concat('- Total edges: ', (SELECT count(*) FROM ge))
UNION ALL SELECT 'events', 1, 2, concat('- Root cause candidates: ', (SELECT count(*) FROM top)) UNION ALL SELECT 'events', 1, 4, concat('- Undetermined nodes (missing RTL): ', (SELECT count(*) FROM gn WHERE rtl_missing))
UNION ALL SELECT 'events', 2, place, concat(place, '. `s', signal, '` @ cycle ', cycle, ' = ', value, ' (score: ', printf('%.2f', suspect_score), ')') FROM top WHERE place <= 10
UNION ALL SELECT 'events', 2, 11, '   ... and more' WHERE (SELECT count(*) FROM top) > 10
UNION ALL SELECT 'events', 3, place * 10, concat('- `s', source, '@', source_cycle, '` -> `s', target, '@', target_cycle, '` (score: ', printf('%.2f', score), ', type: ', type, ')') FROM strong WHERE place <= 5""")
def k08(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    lines = report.summary_lines(nodes, edges, build.statistics(nodes, edges))
    return lines.where("part > 1 or place <> 3")  # the SQL graph has no depth


@query("k09_evidence", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT gn.id, is_root, is_endpoint, (SELECT count(*) FROM ge WHERE target = signal AND target_cycle = cycle) AS incoming, (SELECT count(*) FROM ge WHERE source = signal AND source_cycle = cycle) AS outgoing FROM gn""")
def k09(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    told = report.evidence(nodes, edges, nodes)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return told.select("id", "is_root", "is_endpoint", F.greatest(n("incoming"), F.lit(0)).alias("incoming"), F.greatest(n("outgoing"), F.lit(0)).alias("outgoing"))


@query("k10_top_roots", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT id, suspect_score FROM gn WHERE is_root ORDER BY suspect_score DESC, id LIMIT 5""")
def k10(spark, sf_dir):
    return report.top_roots(_graph(spark, sf_dir).nodes, 5).select("id", "suspect_score")


@query("k05_node_csv", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT concat_ws(',', id, concat('s', signal), cycle, value, CAST(is_root AS INTEGER), CAST(is_endpoint AS INTEGER), CAST(rtl_missing AS INTEGER)) AS line FROM gn""")
def k05(spark, sf_dir):
    lines = report.node_lines(_graph(spark, sf_dir).nodes)
    part = F.split("line", ",")  # all but score, whose digits engines print differently, and depth
    return lines.select(F.concat_ws(",", *(part[i] for i in (0, 1, 2, 3, 5, 6, 8))).alias("line"))


@query("k04_edge_csv", f"""WITH RECURSIVE {DEPS}, {SLICE}, {GRAPH} SELECT concat(a.id, ',', b.id, ',', score, ',', type, ',"s', ge.source, ' affects s', ge.target, ' via ', dep_type, '"') AS line
FROM ge JOIN gn a ON a.signal = ge.source AND a.cycle = ge.source_cycle JOIN gn b ON b.signal = ge.target AND b.cycle = ge.target_cycle""")
def k04(spark, sf_dir):
    return report.edge_lines(_graph(spark, sf_dir).edges).select("line")


@query("a06_endpoint_by_keyword", f"""WITH {WAVE} SELECT concat('t', split_part(signal, '.', 2)) AS trace_id, min(signal) AS signal FROM signals WHERE contains(signal, 'view') GROUP BY 1""")
def a06(spark, sf_dir):
    signals = adapters.wave(spark, sf_dir).select(F.concat(F.lit("t"), F.split("signal", r"\.")[1]).alias("trace_id"), "signal").distinct()
    return build.endpoint_by_keyword(signals, ("none", "view", "click"))


@query("a08_batch_endpoints", f"""WITH {WAVE}, b AS (SELECT split_part(signal, '.', 2) AS trace_id, signal, t, seq, substring(value, 4, 1) AS value FROM wave WHERE signal LIKE '%.view'),
p AS (SELECT *, lag(value) OVER (PARTITION BY signal ORDER BY t, seq) AS prev FROM b), f AS (SELECT trace_id, signal, coalesce(min(t) FILTER (prev = '1' AND value = '0'), min(t) FILTER (value = '0'), 0) AS t FROM p GROUP BY ALL)
SELECT f.trace_id, f.signal, coalesce(e.cycle, 0) AS cycle FROM f ASOF LEFT JOIN edges e ON f.t >= e.t_start""")
def a08(spark, sf_dir):
    wave, edges = _trace(spark, sf_dir)
    many = wave.withColumn("trace_id", F.split("signal", r"\.")[1]).withColumn("value", F.substring("value", 4, 1))
    labels = spark.range(1).select(F.lit("view").alias("label"))
    clocks = many.select(F.lit("events").alias("trace_id"), F.col("trace_id").alias("part")).distinct()  # the parts of one trace share its clock
    ticks = edges.join(clocks, "trace_id").select(F.col("part").alias("trace_id"), "cycle", "t_start")
    return build.endpoints(many, ticks, labels)


@query("k06_styles", f"""WITH {DEPS} SELECT dep_id, CASE WHEN dep_id % 11 = 0 THEN 'red' WHEN dep_id % 7 = 0 THEN 'green' WHEN dep_id % 5 = 0 THEN 'gray' WHEN dep_id / 100.0 > 0.7 THEN 'orange' WHEN dep_id / 100.0 > 0.4 THEN 'yellow' ELSE 'none' END AS style,
CASE dep_type WHEN 'sequential' THEN 'purple' ELSE 'black' END AS colour FROM deps""")
def k06(spark, sf_dir):
    i = F.col("dep_id")
    kind = F.when(F.col("dep_type") == "sequential", "state").otherwise(F.col("dep_type"))
    return adapters.deps(spark, sf_dir).select("dep_id", report.node_style(i % 11 == 0, i % 7 == 0, i % 5 == 0, i / 100).alias("style"), report.edge_colour(kind).alias("colour"))
