"""Assertion windows and trigger cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Parts of names that tell a consequent where the property's text has none.
LATE_WORDS = ("eating", "done", "ready", "valid", "complete", "finish", "state")
#: Words of properties that are no signals.
WORDS = ("if", "else", "and", "or", "not", "h", "b", "d", "o")


def time_window(text: Column) -> tuple[Column, Column]:
    """Least and most delay of ##[m:n] or ##n; null where there is none."""
    span, one = r"##\[\s*(\d+)\s*:\s*(\d+)\s*\]", r"##(\d+)"
    pick = lambda pattern, i: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i).cast("int"))
    return F.coalesce(pick(span, 1), pick(one, 1)), F.coalesce(pick(span, 2), pick(one, 1))


def consequent_signals(text: Column, sources: Column | None = None) -> Column:
    """Names after |->, without keywords and literals, in order.

    sources: array of names the property depends on. Where there is no |-> or nothing (or ...) after it, those that hold one of LATE_WORDS.
    """
    after = F.when(F.instr(text, "|->") > 0, F.substring_index(text, "|->", -1))
    plain = F.regexp_replace(after, r"\d*'[bhdo][0-9a-fA-F_xXzZ]+", " ")
    told = F.array_except(F.regexp_extract_all(plain, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), F.array(*(F.lit(w) for w in WORDS)))
    if sources is None:
        return told
    rest = F.trim(F.regexp_replace(after, r"##(\[\d+:\d+\]|\d+)\s*", ""))
    guessed = F.filter(sources, lambda s: F.lower(s).rlike("|".join(LATE_WORDS)))
    return F.when(rest.isNull() | rest.isin("", "..."), guessed).otherwise(told)


def trigger_cycle(truth: DataFrame) -> DataFrame:
    """truth(trace_id, cycle, holds) up to the last cycle asked: the first cycle of the latest run that holds. A run begins where the cycle before
    doesn't hold, so only neighbours are compared; a long trace is many tasks."""
    told = ordered.beside(truth.select("trace_id", "cycle", F.coalesce("holds", F.lit(False)).alias("holds")), ["trace_id"], ["cycle"], ["holds"], crowd=ordered.CROWD)
    begins = told.where(F.col("holds") & ~F.coalesce(F.col("_beside.holds"), F.lit(False)))
    return begins.groupBy("trace_id").agg(F.max("cycle").alias("trigger_cycle"))


def window_samples(windows: DataFrame) -> DataFrame:
    """(trace_id, cycle) to look at in windows(trace_id, first, last): ends, and quarters where longer than 10."""
    size = F.col("last") - F.col("first")
    inner = F.when(size > 10, F.array(*(F.col("first") + F.floor(size * q).cast("bigint") for q in (0.25, 0.5, 0.75)))).otherwise(F.array().cast("array<bigint>"))
    cycles = F.array_distinct(F.concat(F.array("first", "last"), inner))
    return windows.where("first <= last").select("trace_id", F.explode(cycles).alias("cycle"))


def interesting_cycles(changes: DataFrame, windows: DataFrame, most_changes: int = 5, most: int = 8, signals: DataFrame | None = None) -> DataFrame:
    """Per signal the first changes inside the window and its samples, at most ``most`` in order.

    signals(trace_id, signal): those to look at, unchanging ones too; all that change where not given.
    """
    w = Window.partitionBy("trace_id", "signal").orderBy("cycle")
    known = (changes if signals is None else signals).select("trace_id", "signal").distinct()
    changes = changes.join(known, ["trace_id", "signal"], "left_semi")
    inside = changes.join(windows, "trace_id").where(F.col("cycle").between(F.col("first"), F.col("last")))
    few = inside.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_changes).select("trace_id", "signal", "cycle")
    samples = known.join(window_samples(windows), "trace_id")
    both = few.union(samples.select("trace_id", "signal", "cycle")).distinct()
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def window_graph(windows: DataFrame, consequents: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges) of assertions that failed at the end of a time window.

    windows: trace_id, endpoint, trigger, least, most, fail; consequents: trace_id, signal. Each consequent's cycles of interest between
    trigger + least and the earlier of trigger + most and fail lead to the failure with 0.8, the trigger itself with 1.
    Slicing goes on from the seeds, not from the failing endpoint. No trigger, no rows.
    """
    known = windows.where("trigger is not null")
    bounds = known.select("trace_id", (F.col("trigger") + F.col("least")).cast("bigint").alias("first"), F.least(F.col("trigger") + F.col("most"), F.col("fail")).cast("bigint").alias("last"))
    inside = interesting_cycles(changes, bounds, signals=consequents)
    end = [F.col("endpoint").alias("target"), F.col("fail").cast("bigint").alias("target_cycle")]
    stayed = F.format_string("%s@%d stayed false in window [%d:%d]", "signal", "cycle", "least", "most")
    late = inside.join(known.select("trace_id", "least", "most", *end), "trace_id").select("trace_id", F.col("signal").alias("source"), F.col("cycle").cast("bigint").alias("source_cycle"), "target", "target_cycle", F.lit("state").alias("type"), F.lit(0.8).alias("score"), stayed.alias("reason"))
    fired = F.format_string("triggered at cycle %d, failed at cycle %d", "trigger", "fail")
    start = known.where("trigger < fail").select("trace_id", F.col("endpoint").alias("source"), F.col("trigger").cast("bigint").alias("source_cycle"), *end, F.lit("conditional").alias("type"), F.lit(1.0).alias("score"), fired.alias("reason"))
    edges = late.union(start)
    return edges.select("trace_id", F.col("source").alias("signal"), F.col("source_cycle").alias("cycle")).distinct(), edges
