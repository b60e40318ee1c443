"""Signal names and dependency lookups, as equi-joins on prepared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of samples and names that a task of resolve() brings together.
MET = 500_000


def base(name: Column) -> Column:
    """The last part, without a width suffix."""
    return F.element_at(F.split(F.regexp_replace(name, r"\s*\[[^\]]*\]$", ""), r"\."), -1)


def hierarchy(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(name, r"\s*\[[^\]]*\]$", ""), r"^(.*)\.[^.]*$", 1)


def qualify(module: Column, name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, name).otherwise(F.concat_ws(".", module, name))


def dependency_index(deps: DataFrame) -> DataFrame:
    """(key, sources): what each target depends on, in order. With a module column, under its plain and its qualified name."""
    keys = F.array("target")
    if "module" in deps.columns:
        keys = F.array_distinct(F.array(F.col("target"), qualify(F.col("module"), F.col("target"))))
    rows = deps.select(F.explode(keys).alias("key"), F.struct("source", "dep_type").alias("_s"))
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("_s")).alias("sources"))


def sources_of(deps: DataFrame) -> DataFrame:
    """(module, signal, sources): the distinct sources of each target of a module, in order."""
    return deps.groupBy("module", F.col("target").alias("signal")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def suffixes(name: Column) -> Column:
    """The name and all that follows one of its dots."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def lookup(deps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Dependencies of wanted(module, signal), each once for a signal: of targets with its name, plain or qualified, or with a name that it
    ends with after a dot; else of targets in its module with its base name, in any module where the signal has none.

    Equi-joins on prepared keys. dep_id tells dependencies apart. A null module of a dependency is every module.
    """
    signal, target = plain(F.col("signal")), plain(F.col("target"))
    some = F.when(F.col("module") != "", F.col("module"))
    key = lambda kind, name, module=F.lit(""): F.struct(F.lit(kind).alias("kind"), module.alias("module"), name.alias("name"))
    d = deps.withColumn("_keys", F.array_distinct(F.array(key("name", target), key("name", plain(qualify(F.col("module"), F.col("target")))), key("base", base(F.col("target")), F.coalesce(some, F.lit(""))), key("any", base(F.col("target"))))))
    asked = F.concat(F.transform(suffixes(signal), lambda x: key("name", x)), F.when(some.isNull(), F.array(key("any", base(F.col("signal"))))).otherwise(F.array(key("base", base(F.col("signal")), some), key("base", base(F.col("signal"))))))
    w = wanted.select("module", "signal").distinct().select("module", "signal", F.explode(asked).alias("_key"))
    rows = d.select("dep_id", F.explode("_keys").alias("_key")).join(w, "_key").select("dep_id", "module", "signal").distinct()
    return rows.select("dep_id", "signal", F.col("module").alias("signal_module")).join(deps, "dep_id").select("signal", "signal_module", *deps.columns)


def resolve(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(trace_id, signal, cycle, scope) with a value: in its own scope, else by its plain name, else that of the first signal by
    name that ends with it after a dot; else unknown. Width suffixes of the trace's names don't count. trace_id may be left out
    of wanted, for samples of one trace."""
    given = "trace_id" in wanted.columns
    trace = ["trace_id"] if given else []
    last = lambda name: F.element_at(F.split(name, r"\."), -1)
    scoped, text = F.concat_ws(".", "scope", "signal"), lambda: F.lit(None).cast("string")
    # a name and all that it may stand for end alike, so rows meet where they are dealt by that end; no row is sent twice
    asked = wanted.select(*trace, "cycle", last(scoped).alias("_last"), "signal", "scope", text().alias("_full"), text().alias("value"), F.lit(True).alias("_asked"))
    known = samples.select(*trace, "cycle", last(plain(F.col("signal"))).alias("_last"), text().alias("signal"), text().alias("scope"), F.col("signal").alias("_full"), "value", F.lit(False).alias("_asked"))
    known = known.where(" and ".join(f"{c} is not null" for c in [*trace, "cycle", "_full"]))
    parts = max(1, -(-(wanted.count() + samples.count()) // MET))
    met = asked.unionByName(known).repartition(parts, *trace, "cycle", "_last")
    met = met.select("*", F.posexplode(F.when(F.col("_asked"), F.array(scoped, "signal")).otherwise(suffixes(plain(F.col("_full"))))).alias("_n", "_name"))
    near = Window.partitionBy(*trace, "cycle", "_last", "_name")
    first = lambda told: F.min(F.when(~F.col("_asked") & told, F.struct("_full", "value"))).over(near)
    met = met.select("*", first(F.col("_n") == 0).alias("_same"), first(F.col("_n") > 0).alias("_ends")).where("_asked")
    best = F.when(F.col("_same").isNotNull(), F.struct(F.col("_n").alias("rank"), F.col("_same").alias("of"))).when((F.col("_n") == 1) & F.col("_ends").isNotNull(), F.struct(F.lit(2).alias("rank"), F.col("_ends").alias("of")))
    rows = met.groupBy(*trace, "cycle", "_last", "signal", "scope").agg(F.min(best).alias("_best"))
    return rows.select(*trace, "signal", F.col("cycle").cast(wanted.schema["cycle"].dataType).alias("cycle"), "scope", F.col("_best.of._full").alias("resolved"), F.coalesce("_best.of.value", F.lit("x")).alias("value"))


def plain(name: Column) -> Column:
    """Without a width suffix."""
    return F.regexp_replace(name, r"\s*\[[^\]]*\]$", "")


def owning_module(scopes: DataFrame, modules: DataFrame, instances: DataFrame) -> DataFrame:
    """scopes(scope) with owner: the module that the rightmost part names, or whose only instance it is; else the first part.

    modules: module; instances: instance, module. An instance name of several modules says nothing.
    """
    single = instances.groupBy(F.col("instance").alias("part")).agg(F.countDistinct("module").alias("n"), F.min("module").alias("module")).where("n = 1")
    known = modules.select(F.col("module").alias("part"), "module", F.lit(1).alias("exact")).distinct().unionByName(single.select("part", "module", F.lit(0).alias("exact")))
    # sorted joins: each side may be as large as a design, whatever Spark takes it for
    parts = scopes.select("scope").distinct().select("scope", F.posexplode(F.split("scope", r"\.")).alias("place", "part")).join(known.hint("merge"), "part")
    best = parts.groupBy("scope").agg(F.max_by("module", F.struct("place", "exact")).alias("owner"))
    return scopes.join(best.hint("merge"), "scope", "left").withColumn("owner", F.coalesce("owner", F.element_at(F.split("scope", r"\."), 1)))


def rtl_context(wanted: DataFrame, signals: DataFrame, deps: DataFrame) -> DataFrame:
    """For each of wanted(module, signal): found, definition, dependencies and rtl_refs (file, line, type), the definition's first.

    signals: module, name, signal_type, width, file, line; deps: module, target, source, dep_type, file, line. Only what is asked is gathered.
    """
    asked = wanted.select("module", "signal").distinct()
    key = ["module", "signal"]
    place = F.struct("file", "line", F.lit("definition").alias("type"))
    known = signals.withColumnRenamed("name", "signal").join(asked.hint("merge"), key, "left_semi").groupBy(*key).agg(F.min(F.struct("signal_type", "width", "file", "line")).alias("definition"), F.min(place).alias("_first"))
    few = deps.withColumnRenamed("target", "signal").join(asked.hint("merge"), key, "left_semi")
    told = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "source", "dep_type", "file"))).alias("dependencies"))
    rows = asked.join(known.hint("merge"), key, "left").join(told.hint("merge"), key, "left")
    refs = F.transform("dependencies", lambda d: F.struct(d["file"].alias("file"), d["line"].alias("line"), d["dep_type"].alias("type")))
    first = F.when(F.col("_first").isNotNull(), F.array("_first"))
    both = F.concat(F.coalesce(first, F.array().cast("array<struct<file:string,line:int,type:string>>")), F.coalesce(refs, F.array().cast("array<struct<file:string,line:int,type:string>>")))
    return rows.select(*key, F.col("definition").isNotNull().alias("found"), "definition", "dependencies", both.alias("rtl_refs"))


def bind(deps: DataFrame, instances: DataFrame, signals: DataFrame) -> DataFrame:
    """deps of a design for the signals of traces: target and source are full names of signals(signal).

    A target is the last part or the last two parts (instance and port) of a name whose scope belongs to the row's module. The source lies in the same
    scope; where the traces have none there, its plain name stands if they have that. source_name: what expressions call it. Equi-joins only.
    """
    named = signals.select(plain(F.col("signal")).alias("signal")).distinct()
    parts = F.split("signal", r"\.")
    n = F.size(parts)
    cuts = F.explode(F.array(*(F.struct(F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".").alias("key"), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - k, F.lit(0))), ".").alias("scope"), (n > k).alias("fits")) for k in (1, 2))))
    keyed = named.select("signal", cuts.alias("x")).select("signal", "x.*").where("fits")
    owned = owning_module(keyed, deps.select("module"), instances)
    met = deps.withColumnRenamed("target", "key").join(owned.withColumnRenamed("owner", "module"), ["module", "key"])
    met = met.withColumn("_near", F.concat_ws(".", "scope", "source"))
    for name, key in (("_near", "_a"), ("source", "_b")):
        met = met.join(named.select(F.col("signal").alias(name), F.lit(True).alias(key)), name, "left")
    source = F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), F.col("source")).otherwise(F.col("_near"))
    rest = [c for c in deps.columns if c not in ("source", "target")]
    return met.select(*(c for c in rest if c != "source_name"), F.col("signal").alias("target"), source.alias("source"), F.col("source").alias("source_name"))
