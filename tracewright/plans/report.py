"""Reports of a causal graph as causal_graph() builds it: styles, CSV, graph text, JSON, summary and evidence.

All are DataFrames of lines or rows, for many traces at once. Only json_documents() gathers a
trace's graph in one row; its size is that of the slice's max_nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.slicer import large

#: Colour of each kind of edge.
EDGE_COLOURS = {"expr_eval": "blue", "toggle": "green", "state": "purple", "conditional": "orange", "direct": "darkgreen", "unknown": "black"}
#: Attributes of each style of node.
STYLE_ATTRIBUTES = {
    "red": "style=filled, fillcolor=red, fontcolor=white",
    "green": "style=filled, fillcolor=green",
    "gray": "style=dashed, color=gray",
    "orange": "style=filled, fillcolor=orange",
    "yellow": "style=filled, fillcolor=yellow",
}
#: Legend entries, label and style.
LEGEND = (
    ("endpoint", r"Endpoint\n(assertion fail)", "red"),
    ("root", r"Root Cause\nCandidate", "green"),
    ("high_suspect", r"High Suspicion\n(score > 0.7)", "orange"),
    ("medium_suspect", r"Medium Suspicion\n(score > 0.4)", "yellow"),
    ("rtl_missing", r"RTL Context\nMissing", "gray"),
    ("normal", "Normal Node", None),
)
#: First lines of the CSV files.
NODE_HEADER = "id,signal,cycle,value,suspect_score,is_root,is_endpoint,depth,rtl_missing"
EDGE_HEADER = "source,target,weight,type,reason"


def node_style(endpoint: Column, root: Column, missing: Column, score: Column) -> Column:
    return F.when(endpoint, "red").when(root, "green").when(missing, "gray").when(score > 0.7, "orange").when(score > 0.4, "yellow").otherwise("none")


def _lookup(table: dict[str, str], key: Column, default: str | None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def edge_colour(kind: Column) -> Column:
    return _lookup(EDGE_COLOURS, kind, "black")


def _text(*cols: str) -> list[Column]:
    return [F.col(c).cast("string") for c in cols]


def _flag(name: str) -> Column:
    return F.col(name).cast("int").cast("string")


def node_lines(nodes: DataFrame) -> DataFrame:
    """trace_id, line: CSV under NODE_HEADER; commas leave the signal."""
    signal = F.translate(F.col("signal"), ",", ";")
    return nodes.select("trace_id", F.concat_ws(",", "id", signal, *_text("cycle", "value", "suspect_score"), _flag("is_root"), _flag("is_endpoint"), *_text("depth"), _flag("rtl_missing")).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """trace_id, line: CSV under EDGE_HEADER; commas and line ends leave the reason."""
    reason = F.translate("reason", ",\n", "; ")
    return edges.select("trace_id", F.concat(F.concat_ws(",", "source_id", "target_id", *_text("score"), "type"), F.lit(',"'), reason, F.lit('"')).alias("line"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, part, line: the graph as text. Order by part, then line, to write a file of one trace."""
    legend = [f'        legend_{name} [label="{label}"{", " + STYLE_ATTRIBUTES[style] if style else ""}];' for name, label, style in LEGEND]
    head = ["digraph CausalGraph {", "    rankdir=TB;", "    node [shape=box, fontsize=10];", "    edge [fontsize=8];", "    subgraph cluster_legend {", '        label="Legend";', "        fontsize=12;", "        style=dashed;", "        color=gray;", "        rank=same;", *legend, "    }"]
    frame = [(i, line) for i, line in enumerate(head)] + [(1000, "}")]
    fixed = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(line).alias("line")) for i, line in frame))).alias("x")
    text = nodes.select("trace_id").distinct().select("trace_id", fixed).select("trace_id", "x.part", "x.line")
    style = _lookup(STYLE_ATTRIBUTES, node_style(F.col("is_endpoint"), F.col("is_root"), F.col("rtl_missing"), F.col("suspect_score")), None)
    label = F.concat(F.lit('    "'), "id", F.lit('" [label="'), "signal", F.lit(r"\n@"), F.col("cycle").cast("string"), F.lit("="), "value", F.lit('"'))
    n = nodes.select("trace_id", F.lit(100).alias("part"), F.concat(label, F.coalesce(F.concat(F.lit(", "), style), F.lit("")), F.lit("];")).alias("line"))
    anchor = nodes.groupBy("trace_id").agg(F.min(F.struct(~F.col("is_endpoint"), "depth", "id")).alias("first"))
    tie = anchor.select("trace_id", F.lit(101).alias("part"), F.concat(F.lit('    "'), "first.id", F.lit('" -> legend_endpoint [style=invis, constraint=false];')).alias("line"))
    e = edges.select("trace_id", F.lit(102).alias("part"), F.format_string('    "%s" -> "%s" [label="%s\\n%.2f", color=%s, penwidth=%.2f];', "source_id", "target_id", "type", "score", edge_colour(F.col("type")), 1 + 2 * F.col("score")).alias("line"))
    return text.unionByName(n).unionByName(tie).unionByName(e)


def _node_record() -> Column:
    return F.struct("id", "signal", "cycle", "value", "suspect_score", "rtl_refs", F.col("rtl_missing").alias("rtl_context_missing"), "is_root", "is_endpoint", "depth")


def _edge_record() -> Column:
    return F.struct(F.col("source_id").alias("src_node_id"), F.col("target_id").alias("dst_node_id"), "reason", F.col("type").alias("contribution_type"), F.col("score").alias("contribution_score"), "evidence", F.filter(F.array("example"), lambda x: x.isNotNull()).alias("change_examples"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, part (node or edge), line: one JSON object for each node and edge, for graphs of any size."""
    n = nodes.select("trace_id", F.lit("node").alias("part"), F.to_json(_node_record()).alias("line"))
    return n.union(edges.select("trace_id", F.lit("edge").alias("part"), F.to_json(_edge_record()).alias("line")))


#: The fields of a graph's record, in order.
META = (
    "fst_path", "verilog_paths", "clock_signal", "endpoint_signal", "endpoint_cycle", "max_depth", "max_nodes", "generation_time", "runtime_seconds", "tool_version", "random_seed", "cycle_count",
    "timescale", "total_nodes", "total_edges", "root_nodes", "max_depth_reached", "max_nodes_reached", "undetermined_nodes", "sva_trigger_cycle", "sva_time_window", "sva_window_end_cycle",
    "sva_consequent_signals",
)


def meta(stats: DataFrame, ends: DataFrame, about: DataFrame, windows: DataFrame, consequents: DataFrame, sources: list[str], max_depth: int, max_nodes: int | None, runtime: float, seed: int = 0) -> DataFrame:
    """trace_id and META for each trace of stats(): of build.statistics(). ends: trace_id, signal, cycle; about: of trace.metadata();
    windows, consequents: of build.assertion_graph(); runtime: seconds taken so far. Nothing draws random numbers; the seed is only told."""
    from .. import __version__

    late = consequents.groupBy("trace_id").agg(F.array_sort(F.collect_set("signal")).alias("sva_consequent_signals"))
    fired = windows.select("trace_id", F.col("trigger").alias("sva_trigger_cycle"), F.when(F.col("least").isNotNull(), F.array("least", "most")).alias("sva_time_window"), F.when(F.col("least").isNotNull(), F.col("fail")).alias("sva_window_end_cycle"))
    rows = stats.select("trace_id", F.col("nodes").alias("total_nodes"), F.col("edges").alias("total_edges"), F.col("roots").alias("root_nodes"), "max_depth_reached", "max_nodes_reached", F.col("undetermined").alias("undetermined_nodes"))
    rows = rows.join(ends.select("trace_id", F.col("signal").alias("endpoint_signal"), F.col("cycle").alias("endpoint_cycle")), "trace_id", "left")
    rows = rows.join(about.select("trace_id", F.col("path").alias("fst_path"), F.col("clock").alias("clock_signal"), "cycle_count", "timescale"), "trace_id", "left")
    rows = rows.join(fired, "trace_id", "left").join(late, "trace_id", "left")
    told = {"verilog_paths": F.array(*(F.lit(x) for x in sources)).cast("array<string>"), "max_depth": F.lit(max_depth), "max_nodes": F.lit(max_nodes).cast("int"), "generation_time": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "runtime_seconds": F.lit(round(runtime, 3)), "tool_version": F.lit(__version__), "random_seed": F.lit(seed)}
    return rows.withColumns(told).select("trace_id", *META)


def json_documents(nodes: DataFrame, edges: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """trace_id, document: {nodes, edges, meta} of each trace, nodes by depth, then falling cycle. meta: of meta(); only counts where not given."""
    order = F.struct("depth", -F.col("cycle"), "id")
    n = nodes.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), _node_record().alias("r")))).alias("nodes"), F.sum(F.col("is_root").cast("long")).alias("roots"))
    e = edges.groupBy("trace_id").agg(F.array_sort(F.collect_list(_edge_record())).alias("edges"))
    both = n.join(e, "trace_id", "left").withColumn("nodes", F.col("nodes.r"))
    none = F.array().cast(e.schema["edges"].dataType)
    both = both.withColumn("edges", F.coalesce("edges", none))
    counts = F.struct(F.size("nodes").alias("total_nodes"), F.size("edges").alias("total_edges"), F.col("roots").alias("root_nodes"))
    if meta is not None:
        both = both.join(meta.select("trace_id", F.struct(*META).alias("_meta")), "trace_id", "left")
    last = counts if meta is None else F.col("_meta")
    return both.select("trace_id", F.to_json(F.struct("nodes", "edges", last.alias("meta"))).alias("document"))


def image(lines: str, path: str, dpi: int = 300) -> str:
    """The graph text of one trace drawn as png, svg or pdf, by path's ending: on this machine, by the dot program. RuntimeError without it."""
    import shutil
    import subprocess

    if not shutil.which("dot"):
        raise RuntimeError("the dot program isn't there")
    drawn = subprocess.run(["dot", f"-T{path.rpartition('.')[2]}", f"-Gdpi={dpi}", "-Grankdir=BT", "-o", path], input=lines.encode(), capture_output=True)
    if drawn.returncode:
        raise RuntimeError(drawn.stderr.decode(errors="replace"))
    return path


def top_roots(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Root candidates of each trace by falling score, at most so many, with their place from 1."""
    w = Window.partitionBy("trace_id").orderBy(F.col("suspect_score").desc(), "id")
    return nodes.where("is_root").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def summary_lines(nodes: DataFrame, edges: DataFrame, stats: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """trace_id, part, place, line of a text summary: counts, ten roots, five of the strongest edges with the first line of their source
    text, and with meta() how it was made. stats: of build.statistics()."""
    counts = F.array(*(F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")) for label, c in (("Total nodes", "nodes"), ("Total edges", "edges"), ("Root cause candidates", "roots"), ("Depth reached", "max_depth"), ("Undetermined nodes (missing RTL)", "undetermined"))))
    overview = stats.select("trace_id", F.lit(1).alias("part"), F.posexplode(counts).alias("place", "line"))
    roots = top_roots(nodes).select("trace_id", F.lit(2).alias("part"), "place", F.format_string("%d. `%s` @ cycle %d = %s (score: %.2f)", "place", "signal", "cycle", "value", "suspect_score").alias("line"))
    more = stats.where("roots > 10").select("trace_id", F.lit(2).alias("part"), F.lit(11).alias("place"), F.lit("   ... and more").alias("line"))
    w = Window.partitionBy("trace_id").orderBy(F.col("score").desc(), "source_id", "target_id")
    strong = edges.where("score > 0.7").withColumn("place", F.row_number().over(w)).where("place <= 5")
    said = F.format_string("- `%s@%d` -> `%s@%d` (score: %.2f, type: %s)", "source", "source_cycle", "target", "target_cycle", "score", "type")
    shown = F.substring(F.substring_index(F.trim(F.regexp_replace("evidence.snippet", r"^\s+", "")), "\n", 1), 1, 60)
    lines = F.filter(F.array(F.struct(F.lit(0).alias("n"), said.alias("line")), F.struct(F.lit(1).alias("n"), F.when(shown != "", F.concat(F.lit("  RTL: `"), shown, F.lit("...`"))).alias("line"))), lambda x: x["line"].isNotNull())
    paths = strong.select("trace_id", F.lit(3).alias("part"), "place", F.explode(lines).alias("x")).select("trace_id", "part", (F.col("place") * 10 + F.col("x.n")).alias("place"), "x.line")
    out = overview.union(roots).union(more).union(paths)
    if meta is None:
        return out
    made = F.array(F.format_string("- Runtime: %.3fs", "runtime_seconds"), F.concat(F.lit("- Tool version: "), "tool_version"), F.concat(F.lit("- Random seed: "), F.col("random_seed").cast("string")), F.concat(F.lit("- Generated: "), "generation_time"))
    return out.union(meta.select("trace_id", F.lit(4).alias("part"), F.posexplode(made).alias("place", "line")))


def evidence(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of wanted(trace_id, id): found, its node's flags and rtl_refs, and its incoming and outgoing edges by dep_id, each with evidence and example."""
    asked = wanted.select("trace_id", "id").distinct()
    rows = asked.join(large(nodes.select("trace_id", "id", "signal", "cycle", "is_root", "is_endpoint", "rtl_refs", F.lit(True).alias("found"))), ["trace_id", "id"], "left")
    for end, other, name in (("target_id", "source_id", "incoming"), ("source_id", "target_id", "outgoing")):
        few = edges.withColumnRenamed(end, "id").join(large(asked), ["trace_id", "id"], "left_semi")
        told = few.groupBy("trace_id", "id").agg(F.array_sort(F.collect_list(F.struct("dep_id", other, "type", "score", "reason", "evidence", "example"))).alias(name))
        rows = rows.join(large(told), ["trace_id", "id"], "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False)))
