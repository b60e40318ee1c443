"""Backward slicing through time, level by level, for many endpoints at once.

Each level is one join of the frontier with the dependencies; an endpoint that many traces share is sliced once. Depth is the least distance. A level is
written to the shared folder before the next reads it, so lineage stays short.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import tables
from . import names

SAME_CYCLE = ("combinational", "assertion", "port_input", "port_output", "wire")
IGNORED = ("hasBeenReset", "hasBeenResetReg", "reset")


def parent_cycle(kind: Column, cycle: Column) -> Column:
    return F.when(kind.isin(*SAME_CYCLE), cycle).otherwise(F.greatest(cycle - 1, F.lit(0)))


def contribution_type(kind: Column, condition: Column, toggled: Column) -> Column:
    return F.when(kind == "sequential", "state").when(F.length(condition) > 0, "conditional").when(toggled, "toggle").otherwise("expr_eval")


def node_id(signal: Column, cycle: Column, value: Column) -> Column:
    return F.substring(F.md5(F.concat(signal.cast("string"), F.lit("@"), cycle.cast("string"), F.lit("="), value).cast("binary")), 1, 12)


def table(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there."""
    return tables.save(df)[0]


def large(df: DataFrame) -> DataFrame:
    """df for a join that sorts and never broadcasts it: tables of save() are compressed, and what they hold is many times the size that Spark goes by."""
    return df.hint("merge")


class Slice(NamedTuple):
    """What backward_slice() gives."""

    nodes: DataFrame  # trace_id, signal, cycle, depth, is_orphan
    edges: DataFrame  # trace_id, source, source_cycle, target, target_cycle, dep_type and, of a judge, dep_id, score, kind, example
    cut: DataFrame  # trace_id of each trace that max_nodes cut


#: Levels of a plain slice that one job takes.
LEVELS = 3
KEY = ["trace_id", "signal", "cycle"]
PAIR = ["trace_id", "source", "source_cycle", "target", "target_cycle"]


class _Visited:
    """Nodes seen so far, in tables whose sizes double: a level is written once for each doubling of what is known."""

    def __init__(self, first: DataFrame, written: bool = False):
        self.spark, self.parts = first.sparkSession, []
        if written:
            self.parts.append((first.count(), first, ""))
        else:
            self.add(first)

    def add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        counted = Observation()  # by the write itself
        made, path = tables.save(rows.observe(counted, F.count(F.lit(1)).alias("n")))
        n = counted.get["n"]
        self.parts.append((n, made, path))
        level = made
        while len(self.parts) > 1 and self.parts[-2][0] <= 2 * self.parts[-1][0] and len(self.parts) > 6:
            (m, x, _), (k, y, _) = self.parts.pop(-2), self.parts.pop()
            both, path = tables.save(x.union(y))
            self.parts.append((m + k, both, path))
        return level, n

    def all(self) -> DataFrame:
        out = self.parts[0][1]
        for _, part, _ in self.parts[1:]:
            out = out.union(part)
        return out


def _levels(known: DataFrame, seeds: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges PAIR, dep_id, dep_type) backwards from seeds, nodes at depths up to last sliced. Nothing is decided between levels, so
    some go in one job: their nodes are told apart from those seen before it, and by their least depth."""
    visited = _Visited(seeds.select(*KEY).distinct().withColumn("depth", F.lit(0)))
    edges, frontier, depth = None, visited.parts[0][1], 0
    while depth <= last:
        levels, now = [], frontier
        for i in range(min(LEVELS, last + 1 - depth)):
            step = now.select("trace_id", F.col("signal").alias("target"), F.col("cycle").alias("target_cycle")).join(large(known), "target")
            step = step.withColumn("source_cycle", parent_cycle(F.col("dep_type"), F.col("target_cycle")))
            levels.append(step.groupBy(*PAIR).agg(F.min(F.struct("dep_id", "dep_type")).alias("dep")).withColumn("_depth", F.lit(depth + i)))
            now = levels[-1].select("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle")).distinct().join(large(visited.all()), KEY, "left_anti")
        found = reduce(DataFrame.union, levels)
        if len(levels) > 1:  # a node met at several of these depths was sliced at each
            found = found.groupBy(*PAIR).agg(F.min("dep").alias("dep"), F.min("_depth").alias("_depth"))
        found = table(found.select(*PAIR, "dep.*", "_depth"))
        edges = found if edges is None else edges.union(found)
        fresh = found.groupBy("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle")).agg((F.min("_depth") + 1).alias("depth"))
        fresh, n = visited.add(fresh.join(large(visited.all()), KEY, "left_anti"))
        if not n:
            break
        depth += len(levels)
        frontier = fresh.where(F.col("depth") == depth)
    return visited.all(), edges.drop("_depth")


def _shared(known: DataFrame, seeds: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """The same, with each endpoint sliced once, however many traces and cycles it is asked at: from its latest cycle. Cycles of dependencies are
    differences, so a trace's slice is that one moved to its own cycle; what would fall before cycle 0 is at 0 there, too."""
    seeds = seeds.select(*KEY).distinct()
    tops = table(seeds.groupBy("signal").agg(F.max("cycle").alias("_top")))
    nodes, edges = _levels(known, tops.select(F.col("signal").alias("trace_id"), "signal", F.col("_top").alias("cycle")), last)
    asked = seeds.join(large(tops), "signal").select(F.col("signal").alias("_end"), F.col("trace_id").alias("_trace"), (F.col("_top") - F.col("cycle")).alias("_back"))
    moved = lambda rows, *cycles: rows.join(large(asked), rows["trace_id"] == asked["_end"]).drop("trace_id", "_end").withColumnRenamed("_trace", "trace_id").withColumns({c: F.greatest(F.col(c) - F.col("_back"), F.lit(0)).cast(rows.schema[c].dataType) for c in cycles})
    nodes = moved(nodes, "cycle").groupBy(*KEY).agg(F.min("depth").alias("depth"))
    edges = moved(edges, "source_cycle", "target_cycle").groupBy(*PAIR).agg(F.min(F.struct("dep_id", "dep_type")).alias("dep")).select(*PAIR, "dep.*")
    return table(nodes), table(edges)


def backward_slice(deps: DataFrame, seeds: DataFrame, max_depth: int = 20, max_nodes: int | None = None, judge=None, later: DataFrame | None = None, closed: DataFrame | None = None, free: int = 0) -> Slice:
    """Nodes and edges reachable backwards from seeds(trace_id, signal, cycle) in up to max_depth + 1 steps.

    An edge has the lowest dep_id for its pair. max_nodes bounds each trace level by level: of a level's nodes the first by cycle and
    signal stay, the others are neither kept nor sliced, nor are edges from them. judge(step, depth) may add score, kind and example
    columns to a level's candidate edges and nulls the score of those it rejects; the lowest dep_id that it accepts then stands for a
    pair. What only rejected edges lead from is a node, too, marked is_orphan, and isn't sliced.
    free: the judge rejects nothing at depths below this; those levels are sliced first and all their edges judged together (dep_id tells dependencies apart).
    later(trace_id, signal, cycle): more seeds, at depth 1; closed(trace_id): traces whose seeds at depth 0 aren't sliced.
    A dependency of a name on its own base name is none, whatever the scopes, nor is one on a reset.
    """
    source, target = (names.base(F.col(c).cast("string")) for c in ("source", "target"))
    known = table(deps.where((source != target) & ~source.isin(*IGNORED)))
    told = ["dep_id", "dep_type", "score", "kind", "example"]
    edges, unjudged, lost, cut, depth, waiting = None, None, None, None, 0, None
    ahead = max_depth if judge is None else min(free - 1, max_depth)
    if max_nodes is None and later is None and closed is None and ahead >= 0:
        nodes, unjudged = _shared(known, seeds, ahead)
        visited, depth = _Visited(nodes, written=True), ahead + 1
        frontier = nodes.where(F.col("depth") == depth)
        if judge is not None and depth <= max_depth and frontier.isEmpty():
            depth = max_depth + 1
    else:
        nodes = seeds.select(*KEY).distinct().withColumn("depth", F.lit(0))
        if later is not None:
            nodes = nodes.union(later.select(*KEY).distinct().join(seeds.select(*KEY), KEY, "left_anti").withColumn("depth", F.lit(1)))
        visited = _Visited(nodes)
        first = visited.parts[0][1]
        waiting, frontier = first.where("depth = 1"), first.where("depth = 0")
        if closed is not None:
            frontier = frontier.join(closed.select("trace_id"), "trace_id", "left_anti")
    while depth <= max_depth:
        step = frontier.select("trace_id", F.col("signal").alias("target"), F.col("cycle").alias("target_cycle")).join(large(known), "target")
        step = step.withColumn("source_cycle", parent_cycle(F.col("dep_type"), F.col("target_cycle")))
        if judge is None or depth < free:
            found = table(step.groupBy(*PAIR).agg(F.min(F.struct("dep_id", "dep_type")).alias("dep")).select(*PAIR, "dep.*"))
            unjudged = found if unjudged is None else unjudged.union(found)
        else:
            order = F.struct(F.col("score").isNull().alias("rejected"), *told)
            found = judge(step, depth).groupBy(*PAIR).agg(F.min(order).alias("first"))
            found = table(found.select(*PAIR, *(F.col(f"first.{c}").alias(c) for c in told)))
            rejected = found.where("score is null").select("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle"), F.lit(depth + 1).alias("depth"))
            lost = rejected if lost is None else lost.union(rejected)
            found = found.where("score is not null")
            edges = found if edges is None else edges.union(found)
        fresh = found.select("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle")).distinct().join(large(visited.all()), KEY, "left_anti").withColumn("depth", F.lit(depth + 1))
        if max_nodes is not None:
            w = Window.partitionBy("trace_id").orderBy("cycle", "signal")
            have = visited.all().groupBy("trace_id").agg(F.count("*").alias("_have"))
            fresh = table(fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_nodes + 1).join(have, "trace_id", "left").withColumn("_in", F.col("_n") + F.coalesce("_have", F.lit(0)) <= max_nodes))
            over = fresh.where("not _in").select("trace_id")
            cut = over if cut is None else cut.union(over)
            fresh = fresh.where("_in").drop("_n", "_have", "_in")
        frontier, n = visited.add(fresh)
        if depth == 0 and later is not None:
            frontier = frontier.unionByName(waiting)
        if not n and (depth or later is None or waiting.isEmpty()):
            break
        depth += 1
    if judge is None:
        edges = unjudged.select(*PAIR, "dep_type")
    elif unjudged is not None:
        judged = judge(unjudged.select("trace_id", "source_cycle", "target_cycle", "dep_id", "dep_type").join(large(known), ["dep_id", "dep_type"]), 0)
        judged = judged.groupBy(*PAIR).agg(F.min(F.struct(*told)).alias("first"))  # a dependency may be there twice
        judged = table(judged.select(*PAIR, *(F.col(f"first.{c}").alias(c) for c in told)))
        edges = judged if edges is None else judged.unionByName(edges)
    nodes = visited.all()
    orphan = F.lit(False).alias("is_orphan")
    if lost is not None:
        lost = lost.groupBy(*KEY).agg(F.min("depth").alias("depth")).join(large(nodes), KEY, "left_anti")
        nodes = nodes.select(*KEY, "depth", orphan).union(lost.select(*KEY, "depth", F.lit(True)))
        if max_nodes is not None:  # orphans come after all others
            w = Window.partitionBy("trace_id").orderBy("is_orphan", "depth", "cycle", "signal")
            nodes = table(nodes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_nodes + 1))
            cut = nodes.where(F.col("_n") > max_nodes).select("trace_id").union(cut)
            nodes = nodes.where(F.col("_n") <= max_nodes).drop("_n")
    else:
        nodes = nodes.select(*KEY, "depth", orphan)
    if max_nodes is not None:
        edges = edges.join(large(nodes.select("trace_id", F.col("signal").alias("source"), F.col("cycle").alias("source_cycle"))), ["trace_id", "source", "source_cycle"], "left_semi")
    # a node is sliced once, at its least depth, so no edge comes twice
    return Slice(nodes, edges, nodes.select("trace_id").limit(0) if cut is None else cut.distinct())


def self_loops(deps: DataFrame) -> DataFrame:
    """Dependencies of a name on its own base name, which no slice follows."""
    source, target = (names.base(F.col(c).cast("string")) for c in ("source", "target"))
    return deps.where(source == target)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing leads to, endpoints apart; what only rejected edges lead from is one, too."""
    led = edges.select("trace_id", F.col("target").alias("signal"), F.col("target_cycle").alias("cycle"))
    return nodes.where("depth > 0").join(large(led), ["trace_id", "signal", "cycle"], "left_anti")


def toggle_correlation(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(source, target) with every cycle where both changed, from value_changes(): score 0.7."""
    moved = changes.select("trace_id", "signal", "cycle")
    both = pairs.join(moved.withColumnRenamed("signal", "source"), "source").join(moved.withColumnRenamed("signal", "target"), ["trace_id", "target", "cycle"])
    return both.select("trace_id", "source", "target", "cycle", F.lit(0.7).alias("score"))


def suspect_scores(edges: DataFrame) -> DataFrame:
    """The best score of what a node leads to, times 0.9. edges: trace_id, source, score."""
    return edges.groupBy("trace_id", "source").agg((F.max("score") * 0.9).alias("suspect_score"))


def counterfactuals(cases: DataFrame, key: str = "source", shapes: list[str] | None = None) -> DataFrame:
    """cases(expression, env map, source) with original, perturbed, causal and score. key: the column that names the source in env; shapes: of
    compiled.shapes_in(), if they are known.

    The source is flipped and the expression evaluated again. Where that changes nothing and the expression compares
    the source with a literal, the source is set to that literal, or to its inverse where it is equal already.
    Cases without a value of the source aren't causal; original is null where the expression can't be told.
    """
    from ..functions import bits, compiled

    def score(perturbed: str) -> Column:
        causal = F.coalesce(bits.values_differ(F.col("_o.original"), F.col(perturbed)), F.lit(False))
        return F.when(causal, bits.contribution(F.col("_o.original"), F.col(perturbed)))

    out = compiled.outcomes(cases, "_o", key, shapes=shapes).withColumn("_score", score("_o.flipped"))
    out = out.withColumn("score", F.coalesce("_score", score("_o.tried"))).withColumn("causal", F.col("score").isNotNull())
    perturbed = F.when(F.col("_score").isNull() & F.col("causal"), F.col("_o.tried")).otherwise(F.col("_o.flipped"))
    told = {"original": F.col("_o.original"), "perturbed": perturbed, "score": F.coalesce("score", F.lit(0.0))}
    return out.withColumns(told).drop("_o", "_score")
