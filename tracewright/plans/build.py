"""Causal graphs: slices whose edges are judged by counterfactuals, toggles and structure.

A level's candidate edges are judged together. Values come from equi-joins on
(trace, signal, cycle), so many traces and endpoints are one job.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, compiled
from ..operators import ordered, slicer
from ..operators.slicer import PAIR


def _valued(rows: DataFrame, samples: DataFrame, signal: str, cycle: Column, name: str) -> DataFrame:
    """rows with the value of a signal at a cycle; null where the trace has none."""
    at = samples.select("trace_id", F.col("signal").alias(signal), F.col("cycle").alias("_cycle"), F.col("value").alias(name))
    return rows.withColumn("_cycle", cycle).join(slicer.large(at), ["trace_id", signal, "_cycle"], "left").drop("_cycle")


def with_before(samples: DataFrame) -> DataFrame:
    """samples with before, the value of the cycle just before; null at cycle 0 and where that cycle has none."""
    w = Window.partitionBy("trace_id", "signal").orderBy("cycle")
    return samples.select("trace_id", "signal", "cycle", "value", F.when(F.lag("cycle").over(w) == F.col("cycle") - 1, F.lag("value").over(w)).alias("before"))


def values_at(points: DataFrame, runs: DataFrame) -> DataFrame:
    """with_before() of the samples at points(trace_id, signal, cycle) alone, from trace.cycle_runs(): each point meets the run it lies in, and no cycle
    that isn't asked is written out. Before a signal's first run it is x; signals without runs and cycles behind the trace have no row."""
    key = ["trace_id", "signal"]
    asked = points.select(*key, F.col("cycle").cast("bigint").alias("cycle")).where("cycle >= 0").distinct().join(runs.select(*key).distinct(), key, "left_semi")
    told = ordered.beside(runs.join(asked.select(*key).distinct(), key, "left_semi"), key, ["cycle_from"], ["value"])
    told = told.select(*key, F.col("cycle_from").alias("_from"), "cycle_to", "value", F.coalesce("_beside.value", F.when(F.col("cycle_from") > 0, F.lit("x"))).alias("_earlier"))
    marks = runs.select(*key, F.col("cycle_from").alias("cycle"), F.col("cycle_from").alias("_from"))
    met = ordered.as_of(asked, marks, key, "cycle", "_from").join(told, [*key, "_from"], "left").where("_from is null or cycle <= cycle_to")
    value = F.when(F.col("_from").isNull(), F.lit("x")).otherwise(F.col("value"))
    before = F.when(F.col("cycle") > 0, F.when(F.col("cycle") == F.col("_from"), F.col("_earlier")).otherwise(value))
    return met.select(*key, "cycle", value.alias("value"), before.alias("before"))


#: An edge's example: how it was judged. Fields that don't belong to its type are null.
EXAMPLE = (
    "struct<type:string,source_original:string,source_perturbed:string,target_original:string,target_perturbed:string,expression:string,source_before:string,source_after:string,"
    "target_before:string,target_after:string,trigger_cycle:bigint,signal:string,cycle:bigint,value:string,expected:string,reason:string>"
)


def _example(kind: str, **fields: Column | str) -> Column:
    names = [f.split(":")[0] for f in EXAMPLE[len("struct<") : -1].split(",")]
    told = {"type": F.lit(kind)} | {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    return F.struct(*(told.get(n, F.lit(None)).alias(n) for n in names)).cast(EXAMPLE)


def judge(deps: DataFrame, samples: DataFrame | None, max_depth: int, triggers: DataFrame | None = None, runs: DataFrame | None = None):
    """A judge for backward_slice(). samples: of with_before(); or runs, of trace.cycle_runs(), from which a step takes the values it needs.

    Counterfactual score, or 0.7 where the expression says nothing and source and target both toggled; else 0.85 for the antecedent
    at a trigger cycle of triggers(trace_id, trigger_cycle), else 0.3 in the upper half of the depth; the rest is rejected.
    Expressions see the sources of their target under the names that the design gives them: deps.source_name, else source.
    """
    sources = deps.select("target", F.col("source").alias("_of"), F.col("source_name").alias("_as")).distinct()
    shapes = compiled.shapes_in(deps)

    def told(step: DataFrame, depth: int) -> DataFrame:
        # one environment for each target and cycle, not for each edge
        wanted = step.select("trace_id", "target", "source_cycle").distinct().join(slicer.large(sources), "target")
        # the points that the step asks for: all joins meet these few values, and the samples are read once
        ends = [step.select("trace_id", F.col(x).alias("signal"), F.col(f"{x}_cycle").alias("cycle")) for x in ("source", "target")]
        asked = wanted.select("trace_id", F.col("_of").alias("signal"), F.col("source_cycle").alias("cycle")).union(ends[0]).union(ends[1])
        known = slicer.table(values_at(asked, runs) if runs is not None else samples.join(slicer.large(asked.distinct()), ["trace_id", "signal", "cycle"], "left_semi"))
        wanted = _valued(wanted, known, "_of", F.col("source_cycle"), "_value").where("_value is not null")
        env = wanted.groupBy("trace_id", "target", "source_cycle", "_as").agg(F.min("_value").alias("_value"))
        env = env.groupBy("trace_id", "target", "source_cycle").agg(F.map_from_entries(F.collect_list(F.struct("_as", "_value"))).alias("env"))
        rows = step.join(slicer.large(env), ["trace_id", "target", "source_cycle"], "left")
        for end, name in (("source", "s"), ("target", "t")):
            here = known.select("trace_id", F.col("signal").alias(end), F.col("cycle").alias(f"{end}_cycle"), F.col("before").alias(f"_{name}0"), F.col("value").alias(f"_{name}1"))
            rows = rows.join(slicer.large(here), ["trace_id", end, f"{end}_cycle"], "left")
        rows = slicer.counterfactuals(rows.withColumn("env", F.coalesce("env", F.create_map().cast("map<string,string>"))), "source_name", shapes)
        silent = F.col("original").isNull()
        both_known = F.col("_s1").isNotNull() & F.col("_t1").isNotNull()
        both = [F.coalesce(bits.values_differ(F.col(f"_{x}0"), F.col(f"_{x}1")), F.lit(False)) for x in "st"]
        toggled = silent & both_known & both[0] & both[1]
        told_apart = _example("counterfactual", source_original=F.col("_s1"), source_perturbed=bits.invert(F.col("_s1")), target_original=F.col("original"), target_perturbed=F.col("perturbed"), expression=F.col("expression"))
        moved = _example("toggle_correlation", source_before=F.col("_s0"), source_after=F.col("_s1"), target_before=F.col("_t0"), target_after=F.col("_t1"))
        verdict = F.when(both_known & F.col("causal"), F.struct(F.col("score").alias("score"), told_apart.alias("example"))).when(toggled, F.struct(F.lit(0.7).alias("score"), moved.alias("example")))
        if triggers is not None:
            rows = rows.join(triggers.select("trace_id", "trigger_cycle"), "trace_id", "left")
            fired = _example("sva_antecedent", trigger_cycle=F.col("trigger_cycle"), expression=F.col("expression"), signal=F.col("source"), value=F.coalesce("_s1", F.lit("x")))
            verdict = F.coalesce(verdict, F.when(F.col("expression").contains("|->") & (F.col("target_cycle") == F.col("trigger_cycle")), F.struct(F.lit(0.85).alias("score"), fired.alias("example"))))
        if depth < max_depth // 2:
            verdict = F.coalesce(verdict, F.struct(F.lit(0.3).alias("score"), _example("structural", reason="RTL dependency exists but counterfactual not conclusive").alias("example")))
        kind = slicer.contribution_type(F.col("dep_type"), F.col("condition"), toggled)
        out = rows.withColumn("_verdict", verdict).select(*PAIR, "dep_id", "dep_type", "_verdict.score", kind.alias("kind"), "_verdict.example")
        return out

    return told


class CausalGraph(NamedTuple):
    """What causal_graph() gives."""

    nodes: DataFrame  # trace_id, id, signal, cycle, value, depth, suspect_score, is_root, is_endpoint, rtl_missing, is_orphan, rtl_refs
    edges: DataFrame  # trace_id, source, source_cycle, source_id, target, target_cycle, target_id, dep_id, type, score, reason, example, evidence
    cut: DataFrame  # trace_id of each trace that max_nodes cut


EVIDENCE = "struct<file:string,line:int,line_end:int,snippet:string,expression:string,condition:string>"


def causal_graph(deps: DataFrame, samples: DataFrame | None, seeds: DataFrame, max_depth: int = 20, max_nodes: int | None = None, triggers: DataFrame | None = None, late: tuple[DataFrame, DataFrame] | None = None, runs: DataFrame | None = None) -> CausalGraph:
    """The causes of seeds(trace_id, signal, cycle).

    deps: dep_id, target, source, dep_type, expression, condition and, if there are any, source_name, file, line, line_end, snippet;
    samples: trace_id, signal, cycle, value, of all cycles; or None, and runs, of trace.cycle_runs(). A node's value is x where unknown; rtl_refs are the places of the dependencies of its signal;
    an orphan is what only rejected edges lead from. An edge's evidence is its dependency's place and text.
    late: (seeds, edges) of sva.window_graph(). Its traces are sliced from those seeds, not from their endpoints; its edges have no dep_id
    and don't count in suspect_score.
    """
    if "source_name" not in deps.columns:
        deps = deps.withColumn("source_name", F.col("source"))
    # every level joins with both, so neither is worked out again
    deps, samples = slicer.table(deps), None if runs is not None else slicer.table(with_before(samples))
    more, said = late or (None, None)
    closed = None if said is None else said.select("trace_id").distinct()
    nodes, edges, cut = slicer.backward_slice(deps, seeds, max_depth, max_nodes, judge(deps, samples, max_depth, triggers, runs), more, closed, free=max_depth // 2)
    if runs is not None:
        asked = nodes.select("trace_id", "signal", "cycle")
        if said is not None:
            asked = asked.union(said.select("trace_id", "source", "source_cycle"))
        samples = slicer.table(values_at(asked, runs))
    place = [F.col(c) if c in deps.columns else F.lit(None).alias(c) for c in ("file", "line", "line_end", "snippet")]
    told = deps.select("dep_id", F.struct(*place, "expression", "condition").cast(EVIDENCE).alias("evidence"))
    refs = deps.select("target", F.struct(*place[:2], F.col("dep_type").alias("type")).cast("struct<file:string,line:int,type:string>").alias("_ref"))
    defined = refs.groupBy(F.col("target").alias("signal")).agg(F.array_sort(F.collect_set("_ref")).alias("rtl_refs"))
    scores = edges.groupBy("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle")).agg((F.max("score") * 0.9).alias("_suspect"))
    reason = F.concat_ws(" ", F.col("source"), F.lit("affects"), F.col("target"), F.lit("via"), F.col("dep_type"))
    edges = edges.withColumn("reason", reason).join(slicer.large(told), "dep_id", "left")
    if said is not None:
        none = F.lit(None).cast(edges.schema["dep_id"].dataType)
        value = samples.select("trace_id", F.col("signal").alias("source"), F.col("cycle").alias("source_cycle"), F.col("value").alias("_value"))
        late_edges = said.join(value, ["trace_id", "source", "source_cycle"], "left")
        waited = _example("window_consequent", signal=F.col("source"), cycle=F.col("source_cycle"), value=F.coalesce("_value", F.lit("x")), expected="should become true within window")
        shown = F.when(F.col("type") == "state", waited)
        edges = edges.unionByName(late_edges.select(*PAIR, none.alias("dep_id"), F.lit("assertion").alias("dep_type"), "score", F.col("type").alias("kind"), shown.alias("example"), "reason", F.lit(None).cast(EVIDENCE).alias("evidence")))
    led = edges.select("trace_id", F.col("target").alias("signal"), F.col("target_cycle").alias("cycle"), F.lit(True).alias("_led")).distinct()
    rows = _valued(nodes, samples, "signal", F.col("cycle"), "value").withColumn("value", F.coalesce("value", F.lit("x")))
    key = ["trace_id", "signal", "cycle"]
    rows = rows.join(slicer.large(scores), key, "left").join(slicer.large(led), key, "left").join(slicer.large(defined), "signal", "left")
    first = F.col("depth") == 0
    # seeds are endpoints: score 1, never roots
    rows = rows.select(
        "trace_id",
        slicer.node_id(F.col("signal"), F.col("cycle"), F.col("value")).alias("id"),
        "signal",
        "cycle",
        "value",
        "depth",
        F.when(first, 1.0).otherwise(F.coalesce("_suspect", F.lit(0.0))).alias("suspect_score"),
        (~first & F.col("_led").isNull()).alias("is_root"),
        first.alias("is_endpoint"),
        F.col("rtl_refs").isNull().alias("rtl_missing"),
        "is_orphan",
        F.coalesce("rtl_refs", F.array().cast("array<struct<file:string,line:int,type:string>>")).alias("rtl_refs"),
    )
    rows = slicer.table(rows)
    ids = rows.select("trace_id", "signal", "cycle", "id")
    named = edges
    for end in ("source", "target"):
        named = named.join(slicer.large(ids.select("trace_id", F.col("signal").alias(end), F.col("cycle").alias(f"{end}_cycle"), F.col("id").alias(f"{end}_id"))), ["trace_id", end, f"{end}_cycle"])
    told = named.select("trace_id", "source", "source_cycle", "source_id", "target", "target_cycle", "target_id", "dep_id", F.col("kind").alias("type"), "score", "reason", "example", "evidence")
    return CausalGraph(rows, told, cut)


def has_cycle(edges: DataFrame, most: int = 200) -> DataFrame:
    """(trace_id) of graphs that hold a cycle: edges whose source nothing is left to lead to go, round by round, until none does."""
    left = slicer.table(edges.select("trace_id", "source_id", "target_id").distinct())
    n = left.count()
    for _ in range(most):
        led = left.select("trace_id", F.col("target_id").alias("source_id")).distinct()
        now = slicer.table(left.join(led, ["trace_id", "source_id"], "left_semi"))
        m = now.count()
        if m in (0, n):
            left = now
            break
        left, n = now, m
    return left.select("trace_id").distinct()


def assertion_graph(deps: DataFrame, samples: DataFrame | None, ends: DataFrame, max_depth: int = 20, max_nodes: int | None = None, runs: DataFrame | None = None) -> tuple[CausalGraph, DataFrame, DataFrame]:
    """(graph, windows, consequents) of the failures ends(trace_id, signal, cycle), one in a trace.

    Implications that have a delay, a trigger and consequents are sliced from their window and trigger, the rest from the endpoint.
    windows: trace_id, endpoint, trigger, least, most, fail of every implication; consequents: trace_id, signal. samples or runs: as causal_graph() takes them.
    """
    from ..operators import sva, trace

    deps, samples = slicer.table(deps), None if runs is not None else slicer.table(samples)
    windows, consequents = (slicer.table(x) for x in failed_windows(deps, samples, ends, runs))
    taken = windows.where("least is not null and trigger is not null").join(consequents, "trace_id", "left_semi")
    moved = trace.value_changes(samples.join(consequents, ["trace_id", "signal"], "left_semi")) if runs is None else trace.run_changes(runs.join(consequents, ["trace_id", "signal"], "left_semi"))
    late = tuple(slicer.table(x) for x in sva.window_graph(taken, consequents, moved))
    triggers = windows.where("trigger is not null").select("trace_id", F.col("trigger").alias("trigger_cycle"))
    return causal_graph(deps, samples, ends, max_depth, max_nodes, triggers, late, runs), windows, consequents


def failed_windows(deps: DataFrame, samples: DataFrame | None, ends: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, consequents) for sva.window_graph(), of the implications that failed at ends(trace_id, signal, cycle).

    windows: trace_id, endpoint, trigger, least, most, fail. The trigger starts the latest run of cycles, up to the failure less the greatest delay,
    in which the antecedent holds; null where there is none. Delays are null where the property has no window.
    """
    from ..operators import names, sva

    props = deps.where(F.col("expression").contains("|->")).groupBy(F.col("target").alias("signal")).agg(F.min("expression").alias("expression"))
    least, most = sva.time_window(F.col("expression"))
    failed = ends.select("trace_id", "signal", F.col("cycle").alias("fail")).join(props, "signal").withColumns({"least": least, "most": most})
    last = (F.col("fail") - F.coalesce("most", F.lit(0))).cast("bigint")
    cycles = failed.where(last >= 0).select("trace_id", "signal", F.substring_index("expression", "|->", 1).alias("before"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("cycle"))
    sources = deps.select(F.col("target").alias("signal"), F.col("source").alias("_of")).distinct()
    seen = cycles.join(sources, "signal")
    if runs is not None:
        samples = values_at(seen.select("trace_id", F.col("_of").alias("signal"), "cycle"), runs)
    env = _valued(seen, samples, "_of", F.col("cycle"), "_value").where("_value is not null")
    env = env.groupBy("trace_id", "before", "cycle").agg(F.map_from_entries(F.collect_set(F.struct("_of", "_value"))).alias("env"))
    env = cycles.join(env, ["trace_id", "before", "cycle"], "left")  # a cycle without values ends a run too
    shapes = compiled.shapes_in(props.select(F.substring_index("expression", "|->", 1).alias("before")), "before")
    truth = compiled.evaluated(env, "_held", "before", "env", shapes=shapes).select("trace_id", "cycle", bits.truthy(F.col("_held")).alias("holds"))
    windows = failed.join(sva.trigger_cycle(truth), "trace_id", "left").select("trace_id", F.col("signal").alias("endpoint"), F.col("trigger_cycle").alias("trigger"), "least", "most", "fail")
    near = sources.groupBy("signal").agg(F.collect_set(names.base(F.col("_of"))).alias("_near"))
    late = failed.join(near, "signal").select("trace_id", "signal", sva.consequent_signals(F.col("expression"), F.col("_near")).alias("_late")).join(sources, "signal")
    return windows, late.where(F.array_contains("_late", names.base(F.col("_of")))).select("trace_id", F.col("_of").alias("signal")).distinct()


def statistics(nodes: DataFrame, edges: DataFrame, cut: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """trace_id, nodes, edges, roots, undetermined, max_depth, max_depth_reached, max_nodes_reached. cut: of causal_graph(); limit: its max_depth."""
    n = nodes.groupBy("trace_id").agg(F.count("*").alias("nodes"), F.sum(F.col("is_root").cast("long")).alias("roots"), F.sum(F.col("rtl_missing").cast("long")).alias("undetermined"), F.max("depth").alias("max_depth"))
    e = edges.groupBy("trace_id").agg(F.count("*").alias("edges"))
    full = n.limit(0).select("trace_id") if cut is None else cut
    met = n.join(e, "trace_id", "left").join(full.withColumn("_cut", F.lit(True)), "trace_id", "left")
    deep = F.lit(False) if limit is None else F.col("max_depth") > limit
    return met.select("trace_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "roots", "undetermined", "max_depth", deep.alias("max_depth_reached"), F.coalesce("_cut", F.lit(False)).alias("max_nodes_reached"))


def endpoint_by_keyword(signals: DataFrame, keywords: tuple[str, ...] = ("assert", "fail", "error")) -> DataFrame:
    """(trace_id, signal): per trace the first signal by name that holds the first keyword found at all."""
    rank = F.lit(None).cast("int")
    for i, word in reversed(list(enumerate(keywords))):
        rank = F.when(F.lower("signal").contains(word), i).otherwise(rank)
    ranked = signals.withColumn("_rank", rank).where("_rank is not null")
    return ranked.groupBy("trace_id").agg(F.min(F.struct("_rank", "signal")).alias("best")).select("trace_id", F.col("best.signal").alias("signal"))


def endpoints(changes: DataFrame, edges: DataFrame, asserted: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(trace_id, signal, cycle): for every trace of a batch its endpoint and failing cycle.

    The endpoint is the signal that the trace is named after; else the first by name of asserted(label) that the trace has, else the one that a
    keyword finds. strict: no row for an endpoint that never falls.
    """
    from ..operators import names, trace

    signals = changes.select("trace_id", "signal").distinct()
    chosen = endpoint_by_keyword(signals)
    if asserted is not None:
        named = signals.withColumn("label", names.base(F.col("signal"))).join(asserted, "label", "left_semi")
        first = named.groupBy("trace_id").agg(F.min("signal").alias("_named"))
        chosen = chosen.join(first, "trace_id", "full").select("trace_id", F.coalesce("_named", "signal").alias("signal"))
    own = endpoint_by_name(signals).withColumnRenamed("signal", "_own")
    chosen = chosen.join(own, "trace_id", "full").select("trace_id", F.coalesce("_own", "signal").alias("signal"))
    return trace.fail_cycle(changes.join(chosen, ["trace_id", "signal"], "left_semi"), edges, strict=strict)


def endpoint_by_name(signals: DataFrame) -> DataFrame:
    """(trace_id, signal): the signal whose full name is the trace's, which is its file's without the ending."""
    from ..operators import names

    return signals.where(names.plain(F.col("signal")) == F.col("trace_id")).groupBy("trace_id").agg(F.min("signal").alias("signal"))
