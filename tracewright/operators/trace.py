"""Clock edges, cycles and samples of value-change traces.

One job analyses many traces, and one long trace or one busy signal is many tasks: windows are over buckets of time of about equal numbers of rows
(``ordered.py``). A cycle runs from one rising clock edge to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import ordered

EDGE_FROM = ("0", "x", "X")  # a rise from z is no edge
#: Parts of names that tell an assertion where no label does.
ASSERTION_WORDS = ("assert", "fail", "error", "property", "should", "must", "valid", "check")


def clock_edges(clock: DataFrame, crowd: int = ordered.CROWD) -> DataFrame:
    """(trace_id, cycle, t_start) of rising edges; a 1 at the first time counts."""
    rises = (F.col("value") == "1") & (F.col("_beside").isNull() | F.col("_beside.value").isin(*EDGE_FROM))
    told = ordered.numbered(clock, ["trace_id"], ["t", "seq"], rises, ["value"], "cycle", crowd)
    return told.select("trace_id", "cycle", F.col("t").alias("t_start"))


def cycle_count(edges: DataFrame) -> DataFrame:
    """(trace_id, cycles)."""
    return edges.groupBy("trace_id").agg(F.count("*").alias("cycles"))


def cycle_ranges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(trace_id, cycle, t_start, t_end): the last cycle ends with the trace."""
    ends = changes.groupBy("trace_id").agg(F.max("t").alias("t_last"))
    nexts = edges.select("trace_id", (F.col("cycle") - 1).alias("cycle"), (F.col("t_start") - 1).alias("t_next"))
    return edges.join(nexts, ["trace_id", "cycle"], "left").join(ends, "trace_id").select("trace_id", "cycle", "t_start", F.coalesce("t_next", "t_last").alias("t_end"))


def cycle_to_time(asked: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """asked(trace_id, cycle, ...) with t: the trace's first time for a negative cycle, its last one behind the last cycle."""
    ends = changes.groupBy("trace_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    met = asked.join(ends, "trace_id").join(edges.select("trace_id", "cycle", "t_start"), ["trace_id", "cycle"], "left")
    return met.select(*asked.columns, F.when(F.col("cycle") < 0, F.col("_first")).otherwise(F.coalesce("t_start", "_last")).alias("t"))


def time_to_cycle(points: DataFrame, edges: DataFrame, crowd: int = ordered.CROWD) -> DataFrame:
    """points(trace_id, t, ...) with the cycle they fall in; before the first edge and without edges 0."""
    marks = edges.select("trace_id", F.col("t_start").alias("t"), F.col("cycle").cast("bigint").alias("_cycle"))
    told = ordered.as_of(points, marks, ["trace_id"], "t", "_cycle", crowd=crowd)
    return told.select(*points.columns, F.coalesce("_cycle", F.lit(0)).cast("bigint").alias("cycle"))


def _runs(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle_from, cycle_to, value) from (trace_id, signal, cycle, t, seq, value): what holds from a cycle on."""
    last = first.groupBy("trace_id", "signal", "cycle").agg(F.max_by("value", F.struct("t", "seq")).alias("value"))
    told = ordered.beside(last, ["trace_id", "signal"], ["cycle"], ["cycle"], after=True)
    runs = told.withColumn("to", F.col("_beside.cycle") - 1).join(cycle_count(edges), "trace_id").where(F.col("cycle") < F.col("cycles"))
    return runs.select("trace_id", "signal", F.col("cycle").alias("cycle_from"), F.least(F.coalesce("to", F.col("cycles") - 1), F.col("cycles") - 1).alias("cycle_to"), "value")


def cycle_runs(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle_from, cycle_to, value): end-of-cycle samples, run-length coded."""
    return _runs(time_to_cycle(changes, edges), edges)


def start_runs(changes: DataFrame, edges: DataFrame, crowd: int = ordered.CROWD) -> DataFrame:
    """The same of samples at each edge's own time, changes of that time included: a change shows at the first edge that isn't before it."""
    marks = edges.select("trace_id", F.col("t_start").alias("t"), F.col("cycle").cast("bigint").alias("_cycle"))
    told = ordered.as_of(changes, marks, ["trace_id"], "t", "_cycle", before=True, crowd=crowd)
    return _runs(told.select("trace_id", "signal", "t", "seq", "value", F.coalesce(F.col("_cycle") + 1, F.lit(0)).cast("bigint").alias("cycle")), edges)


def _expanded(runs: DataFrame) -> DataFrame:
    return runs.select("trace_id", "signal", F.explode(F.sequence("cycle_from", "cycle_to")).alias("cycle"), "value")


def cycle_values(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle, value) for each signal and cycle; x before a signal's first change."""
    runs = cycle_runs(changes, edges)
    first = runs.groupBy("trace_id", "signal").agg(F.min("cycle_from").alias("_first")).where("_first > 0")
    gaps = first.select("trace_id", "signal", F.lit(0).cast("bigint").alias("cycle_from"), (F.col("_first") - 1).alias("cycle_to"), F.lit("x").alias("value"))
    return _expanded(runs.unionByName(gaps))


def start_samples(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle, value) at each edge's own time, from a signal's first value on."""
    return _expanded(start_runs(changes, edges))


def value_table(samples: DataFrame, signals: list[str], first: int, last: int) -> DataFrame:
    """cycle_values() of some signals between two cycles."""
    return samples.where(F.col("signal").isin(*signals) & F.col("cycle").between(first, last))


def transitions(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle, t, old_value, new_value) of every change from a known earlier value."""
    told = ordered.beside(changes, ["trace_id", "signal"], ["t", "seq"], ["value"])
    moved = told.withColumn("old_value", F.col("_beside.value")).drop("_beside").where("old_value is not null and old_value <> value")
    return time_to_cycle(moved, edges).select("trace_id", "signal", "cycle", "t", "old_value", F.col("value").alias("new_value"))


def run_changes(runs: DataFrame) -> DataFrame:
    """(trace_id, signal, cycle, old_value, new_value) between successive cycles, from cycle_runs(): no cycle is written out."""
    told = ordered.beside(runs, ["trace_id", "signal"], ["cycle_from"], ["value"])
    told = told.withColumn("old_value", F.coalesce("_beside.value", F.when(F.col("cycle_from") > 0, F.lit("x"))))
    return told.where("old_value is not null and value <> old_value").select("trace_id", "signal", F.col("cycle_from").alias("cycle"), "old_value", F.col("value").alias("new_value"))


def value_changes(samples: DataFrame) -> DataFrame:
    """The same from cycle_values() or any table of samples."""
    told = ordered.beside(samples, ["trace_id", "signal"], ["cycle"], ["value"]).where("_beside is not null and not (value <=> _beside.value)")
    return told.select("trace_id", "signal", "cycle", F.coalesce("_beside.value", F.lit("x")).alias("old_value"), F.coalesce("value", F.lit("x")).alias("new_value"))


def signals(changes: DataFrame) -> DataFrame:
    """(trace_id, signal), each once."""
    return changes.select("trace_id", "signal").distinct()


def metadata(changes: DataFrame, edges: DataFrame, clock: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """(trace_id, start_time, end_time, signal_count, cycle_count, clock, path, timescale) of each trace. clock(trace_id, signal);
    headers(trace_id, path, timescale, ...): of vcd.read_headers(); null where not given."""
    told = changes.groupBy("trace_id").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.countDistinct("signal").alias("signal_count"))
    told = told.join(cycle_count(edges).withColumnRenamed("cycles", "cycle_count"), "trace_id", "left").withColumn("cycle_count", F.coalesce("cycle_count", F.lit(0)))
    none = F.lit(None).cast("string")
    told = told.join(clock.select("trace_id", F.col("signal").alias("clock")), "trace_id", "left") if clock is not None else told.withColumn("clock", none)
    if headers is None:
        return told.withColumns({"path": none, "timescale": none})
    return told.join(headers.groupBy("trace_id").agg(F.min("path").alias("path"), F.min("timescale").alias("timescale")), "trace_id", "left")


def name_index(signals: DataFrame) -> DataFrame:
    """(gram, trace_id, signal): which names hold three letters in a row, whatever their case; a table in the order of gram, so that a filter on
    it reads few row groups. For find_signal() over many names."""
    low = F.lower("signal")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("signal") - 2), lambda i: F.substring(low, i, F.lit(3))))
    rows = signals.select("trace_id", "signal").distinct().where(F.length("signal") >= 3).select(F.explode(grams).alias("gram"), "trace_id", "signal")
    return tables.save(rows.repartitionByRange("gram").sortWithinPartitions("gram", "signal"))[0]


def find_signal(signals: DataFrame, pattern: str, most: int = 100, index: DataFrame | None = None) -> DataFrame:
    """The first signals by name that hold the pattern, whatever its case. index: of name_index(); then only names that hold all of the pattern's
    runs of three letters are looked at, where it has one."""
    wanted = pattern.lower()
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    if index is not None and grams:
        met = index.where(F.col("gram").isin(*grams)).groupBy("trace_id", "signal").agg(F.count("*").alias("_n"))
        signals = met.where(F.col("_n") == len(grams)).drop("_n")
    return signals.where(F.lower("signal").contains(wanted)).orderBy("signal").limit(most)


def snapshot(samples: DataFrame, cycle: int) -> DataFrame:
    """(trace_id, cycle, values map) at the end of one cycle."""
    return samples.where(F.col("cycle") == cycle).groupBy("trace_id", "cycle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "value")))).alias("values"))


def fail_cycle(changes: DataFrame, edges: DataFrame, before: str = "1", after: str = "0", strict: bool = False) -> DataFrame:
    """(trace_id, signal, cycle): where each signal first falls; else where it is first low; else 0. strict: signals that never fall have no row."""
    told = ordered.beside(changes, ["trace_id", "signal"], ["t", "seq"], ["value"]).withColumn("prev", F.col("_beside.value"))
    first = told.groupBy("trace_id", "signal").agg(F.min(F.when((F.col("prev") == before) & (F.col("value") == after), F.col("t"))).alias("fall"), F.min(F.when(F.col("value") == after, F.col("t"))).alias("low"))
    at = first.where("fall is not null").select("trace_id", "signal", F.col("fall").alias("t")) if strict else first.select("trace_id", "signal", F.coalesce("fall", "low", F.lit(-(1 << 62))).alias("t"))
    return time_to_cycle(at, edges).select("trace_id", "signal", "cycle")


def detect_clock(signals: DataFrame) -> DataFrame:
    """Per trace the signal whose last part is clock or clk: least nested, then by name. The width suffix doesn't count."""
    parts = F.split(F.regexp_replace("signal", r"\s*\[[^\]]*\]$", ""), r"\.")
    named = signals.withColumn("parts", F.size(parts)).where(F.lower(F.element_at(parts, -1)).isin("clock", "clk") & (F.col("parts") >= 2))
    return named.groupBy("trace_id").agg(F.min(F.struct("parts", "signal")).alias("best")).select("trace_id", F.col("best.signal").alias("signal"))


def clock_signal(signals: DataFrame, name: str | None = None) -> DataFrame:
    """(trace_id, signal): per trace the signal of that name, else detect_clock()'s, else the first by name that holds clock or clk."""
    exact = F.col("signal") == name if name else F.lit(False)
    best = detect_clock(signals).select("trace_id", F.col("signal").alias("_best"))
    ranked = signals.join(best, "trace_id", "left").withColumn("_rank", F.when(exact, 0).when(F.col("signal") == F.col("_best"), 1).when(F.lower("signal").rlike("clock|clk"), 2))
    return ranked.where("_rank is not null").groupBy("trace_id").agg(F.min(F.struct("_rank", "signal")).alias("x")).select("trace_id", "x.signal")


def assertion_signals(signals: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """signals whose last part is one of labels(label); for traces without any, those whose name holds one of ASSERTION_WORDS."""
    last = F.element_at(F.split(F.regexp_replace("signal", r"\s*\[[^\]]*\]$", ""), r"\."), -1)
    worded = signals.where(F.lower("signal").rlike("|".join(ASSERTION_WORDS)))
    if labels is None:
        return worded
    named = signals.withColumn("label", last).join(labels.select("label").distinct(), "label", "left_semi").select(*signals.columns)
    return named.unionByName(worded.join(named.select("trace_id").distinct(), "trace_id", "left_anti"))
