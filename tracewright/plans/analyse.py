"""From traces and design sources to causal graphs and their files: one job for any number of traces."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names, slicer, trace
from ..sources import rtl, vcd
from . import build, report


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    endpoints: DataFrame
    windows: DataFrame
    meta: DataFrame
    problems: DataFrame  # trace_id, problem


def analyse(
    spark: SparkSession,
    traces: list[str],
    sources: list[str],
    endpoint: str | None = None,
    cycle: int | None = None,
    clock: str | None = None,
    max_depth: int = 20,
    max_nodes: int | None = 200,
    last_cycle: bool = False,
    seed: int = 0,
) -> Graph:
    """The causes of each trace's failing assertion.

    What isn't given is found per trace: the clock by its name; the endpoint by the name of the trace's file, else among the design's
    assertions, else by keyword; the cycle where the endpoint first falls, or with last_cycle the trace's last one. A clock or endpoint that
    a trace doesn't have, or an endpoint that never falls, is a row of ``problems``, and that trace has no graph; where that is so
    for all traces, ValueError. Stats tell where max_depth or max_nodes cut a graph.
    """
    began = time.time()
    changes = slicer.table(vcd.read_vcd(spark, *traces).withColumn("signal", names.plain(F.col("signal"))))
    signals = slicer.table(trace.signals(changes))
    known = slicer.table(rtl.read_rtl(spark, *sources))
    ticks = slicer.table(trace.clock_signal(signals, clock))
    edges = slicer.table(trace.clock_edges(changes.join(ticks, ["trace_id", "signal"], "left_semi")))
    if endpoint:
        of = changes.where(F.col("signal") == endpoint)
        ends = of.select("trace_id", "signal").distinct().withColumn("cycle", F.lit(0).cast("bigint")) if cycle is not None or last_cycle else trace.fail_cycle(of, edges, strict=True)
    else:
        ends = build.endpoints(changes, edges, known.where("dep_type = 'assertion'").select(F.col("target").alias("label")).distinct(), strict=cycle is None and not last_cycle)
    if cycle is not None:
        ends = ends.withColumn("cycle", F.lit(cycle).cast("bigint"))
    elif last_cycle:
        ends = ends.drop("cycle").join(trace.cycle_count(edges).select("trace_id", (F.col("cycles") - 1).alias("cycle")), "trace_id")
    ends = slicer.table(ends.select("trace_id", "signal", "cycle").join(edges.select("trace_id").distinct(), "trace_id", "left_semi"))
    every = vcd.read_headers(spark, *traces).select("trace_id").distinct()
    lacking = every.join(edges.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit("no clock, or one that never rises").alias("problem"))
    lost = every.join(ends.select("trace_id"), "trace_id", "left_anti").select("trace_id", F.lit("no endpoint, or one that never falls").alias("problem"))
    problems = slicer.table(lacking.union(lost.join(lacking.select("trace_id"), "trace_id", "left_anti")))
    if ends.isEmpty():
        raise ValueError("; ".join(f"{r.trace_id}: {r.problem}" for r in problems.limit(5).collect()) or "no traces")
    deps = names.bind(known, rtl.read_instances(spark, *sources), signals.select("signal"))
    # an id that a rerun finds again: by place in the sources
    deps = deps.withColumn("dep_id", F.struct("file", "line", "target", "source", "expression"))
    graph, windows, consequents = build.assertion_graph(deps, None, ends, max_depth, max_nodes, runs=slicer.table(trace.cycle_runs(changes, edges)))
    stats = slicer.table(build.statistics(graph.nodes, graph.edges, graph.cut, max_depth))
    about = trace.metadata(changes, edges, ticks, vcd.read_headers(spark, *traces))
    meta = slicer.table(report.meta(stats, ends, about, windows, consequents, sources, max_depth, max_nodes, time.time() - began, seed))
    return Graph(graph.nodes, graph.edges, stats, ends, windows, meta, problems)


def _text(lines: DataFrame, path: str) -> None:
    """A folder for each trace, with its lines in order in one file: a graph has at most max_nodes nodes."""
    ordered = lines.repartition("trace_id").sortWithinPartitions("trace_id", "part", "line")
    ordered.select("trace_id", "line").write.mode("overwrite").partitionBy("trace_id").text(path)


def write(graph: Graph, folder: str) -> None:
    """causal_graph_json, causal_graph_dot, causal_nodes, causal_edges and summary under the folder."""
    nodes, edges = graph.nodes, graph.edges
    heads = graph.endpoints.select("trace_id").distinct()

    def headed(lines: DataFrame, head: str) -> DataFrame:
        return lines.select("trace_id", F.lit(1).alias("part"), "line").union(heads.select("trace_id", F.lit(0), F.lit(head)))

    about = graph.endpoints.select("trace_id", F.lit(0).alias("part"), F.format_string("# `%s` at cycle %d", "signal", "cycle").alias("line"))
    window = F.when(F.col("least").isNotNull(), F.format_string(", window [%d:%d]", "least", "most")).otherwise("")
    fired = graph.windows.where("trigger is not null").select("trace_id", F.lit(1).alias("part"), F.concat(F.format_string("Triggered at cycle %d", "trigger"), window).alias("line"))
    told = report.summary_lines(nodes, edges, graph.stats, graph.meta).select("trace_id", (F.col("part") * 100 + F.col("place")).alias("part"), "line")
    _text(report.json_documents(nodes, edges, graph.meta).select("trace_id", F.lit(0).alias("part"), F.col("document").alias("line")), f"{folder}/causal_graph_json")
    _text(report.graph_lines(nodes, edges), f"{folder}/causal_graph_dot")
    _text(headed(report.node_lines(nodes), report.NODE_HEADER), f"{folder}/causal_nodes")
    _text(headed(report.edge_lines(edges), report.EDGE_HEADER), f"{folder}/causal_edges")
    _text(about.union(fired).union(told), f"{folder}/summary")
