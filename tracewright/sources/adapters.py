"""The driver's tables as traces and dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("trace_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), "user_id", "event_type", "value")


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value_changes(trace_id, signal, t, seq, value): events as a trace of 40 four-bit signals."""
    e = _events(spark, sf_dir)
    name = F.concat(F.lit("top.u"), (F.col("user_id") % 8).cast("string"), F.lit("."), F.col("event_type"))
    return e.select("trace_id", name.alias("signal"), "t", "seq", F.lpad(F.bin(F.floor("value").cast("bigint") % 16), 4, "0").alias("value"))


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace's clock: high on views."""
    e = _events(spark, sf_dir)
    return e.select("trace_id", F.lit("top.clock").alias("signal"), "t", "seq", F.when(F.col("event_type") == "view", "1").otherwise("0").alias("value"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dependencies(dep_id, target, source, dep_type): three of each target, some of them feedback or on themselves."""
    kind = F.element_at(F.array(F.lit("combinational"), F.lit("sequential"), F.lit("assertion")), (F.col("p_size") % 3 + 1).cast("int"))
    target = F.floor(F.col("p_partkey") / 3)
    source = F.when(F.col("p_size") % 11 == 0, F.floor(target / 2)).when(F.col("p_size") % 13 == 0, target).otherwise(target * 3 + 1 + F.col("p_size") % 7)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dep_id"), target.cast("int").alias("target"), source.cast("int").alias("source"), kind.alias("dep_type"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deps() with named signals, an expression over the source (empty for every fourth) and a condition."""
    source = F.concat(F.lit("s"), F.col("source").cast("string"))
    k = F.col("dep_id") % 4
    expression = F.when(k == 0, F.concat(source, F.lit(" & 4'b0001"))).when(k == 1, F.concat(source, F.lit(" ? 4'b0101 : 4'b0011"))).when(k == 3, F.concat(source, F.lit(" == 4'd5"))).otherwise("")
    condition = F.when(F.col("dep_type") == "assertion", "@(posedge clock)").otherwise("")
    target = F.concat(F.lit("s"), F.col("target").cast("string"))
    return deps(spark, sf_dir).select("dep_id", target.alias("target"), source.alias("source"), "dep_type", expression.alias("expression"), condition.alias("condition"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle_values(trace_id, signal, cycle, value): quantities of line items, a signal for each part and a cycle for each line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("bigint")).alias("q"))
    return lines.select(F.lit("events").alias("trace_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("signal"), (F.col("l_linenumber") - 1).cast("int").alias("cycle"), F.lpad(F.bin(F.col("q") % 16), 4, "0").alias("value"))


#: Sources that a task makes and reads.
TEXTS = 5000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes of the parts, dealt over tasks: the table is small, and a task or two would read it, where the texts made of it take long to parse."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return parts.repartition(max(1, -(-parts.count() // TEXTS)), "p_partkey")


def design_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value): a source text of two modules for each part, with its size as a width and a delay."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = (
        ("module c", k, "(input i, output o);"),
        ("  assign o = ~i;",),
        ("endmodule",),
        ("module m", k, "(input clock, input [", n, ":0] a, b, input en, output reg [3:0] y);"),
        ("  reg [7:0] q;",),
        ("  wire z, w;",),
        ("  wire v = a + ", n, "'h1;"),
        ("  assign w = q ^ v;",),
        ("  always @(posedge clock) begin",),
        ("    if (en) q <= a;",),
        ("    else if (w) q <= y;",),
        ("    else q <= 8'h0;",),
        ("  end",),
        ("  c", k, " u (.i(b), .o(z));"),
        ("  p", k, ":"),
        ("    assert property (@(posedge clock) disable iff (~hasBeenReset) a |-> ##[1:", n, "] y);"),
        ("endmodule",),
    )
    text = F.concat_ws("\n", *(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in line)) for line in lines))
    return _parts(spark, sf_dir).select(F.concat(F.lit("m"), k, F.lit(".sv")).alias("path"), text.alias("value"))


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value): a module for each part, with one to three arms of a case by its size, and a default arm."""
    k, n, arms = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.sequence(F.lit(0), F.col("p_size") % 3)
    lines = F.transform(arms, lambda i: F.concat(F.lit("      2'd"), i.cast("string"), F.lit(": y <= a + "), n, F.lit("'h"), i.cast("string"), F.lit(";")))
    head = F.concat(F.lit("module q"), k, F.lit("(input clock, input [1:0] s, input a, b, output reg y, output reg z);\n  always @(posedge clock) begin\n    case (s)\n"))
    rest = "\n      default: y <= b;\n    endcase\n  end\n  always @(*) if (b) z = s; else z = a;\nendmodule"
    return _parts(spark, sf_dir).select(F.concat(F.lit("q"), k, F.lit(".sv")).alias("path"), F.concat(head, F.array_join(lines, "\n"), F.lit(rest)).alias("value"))
