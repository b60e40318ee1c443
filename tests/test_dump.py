"""Dumps in splits of any size give the rows of the whole; filters reach the reader."""

import random

import pytest
from pyspark.sql import functions as F
from tracewright.sources import dump, vcd

HEAD = "$timescale 1ns $end\n$scope module top $end\n$var wire 1 ! clk $end\n$var wire 8 % bus [7:0] $end\n$scope module u $end\n$var wire 8 % alias $end\n$var real 64 & r $end\n$upscope $end\n$upscope $end\n$enddefinitions $end\n"


def text(n=400):
    r, t, out = random.Random(2), 0, ["#0", "$dumpvars", "x!", "bx %", "$end", "$comment a note", "#999 not a time", "1!", "$end"]
    for i in range(n):
        if r.random() < 0.4:
            t += r.choice([1, 5, 1000])
            out.append(f"#{t}")
        out.append(r.choice([f"{r.choice('01xz')}!", f"b{r.randint(0, 255):b} %", f"r{r.random():.3f} &", f"b1 % {r.choice('01')}!"]))
        if i == 200:
            out.append("$comment in one line $end 0!")
    return HEAD + "\n".join(out)


@pytest.mark.parametrize("end", ["", "\n"])
def test_splits(spark, tmp_path, end):
    path = tmp_path / "one.vcd"
    path.write_text(text() + end)
    whole = sorted((s, t, v) for s, t, _, v in vcd.parse_vcd(text()))
    order = [(s, t, v) for s, t, _, v in vcd.parse_vcd(text()) if s == "top.clk"]
    for size in (7, 61, 1000, 1 << 20):
        df = dump.read_dumps(spark, str(path), split_bytes=size)
        rows = df.collect()
        assert sorted((r.signal, r.t, r.value) for r in rows) == whole and {r.trace_id for r in rows} == {"one"}
        assert [(r.signal, r.t, r.value) for r in sorted(rows, key=lambda r: (r.t, r.seq)) if r.signal == "top.clk"] == order
    assert df.rdd.getNumPartitions() == 1 and dump.read_dumps(spark, str(path), split_bytes=1000).rdd.getNumPartitions() > 4


def test_filters_reach_the_reader(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.vcd").write_text(text())
    wanted = (F.col("t") > 50) & (F.col("t") <= 4000) & (F.col("signal") == "top.u.alias") & (F.col("trace_id") == "b")
    plain = sorted(map(tuple, dump.read_dumps(spark, str(tmp_path), split_bytes=500).where(wanted).collect()))
    spark.conf.set(dump.PUSHDOWN, "true")
    try:
        pushed = dump.read_dumps(spark, str(tmp_path), split_bytes=500).where(wanted)
        assert sorted(map(tuple, pushed.collect())) == plain and plain
        assert " Filter " not in pushed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(dump.PUSHDOWN)
    asked = dump.read_dumps(spark, str(tmp_path / "b.vcd"), signals=["top.u.alias"], since=51, until=4000, split_bytes=500)
    assert sorted(map(tuple, asked.collect())) == plain


def test_written_dumps(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.choice(["top.a", "top.u.b", "flat"]), t, i, f"{r.randint(0, 15):04b}") for k in ("p", "q") for i, t in enumerate(sorted(r.choices(range(300), k=200)))]
    df = spark.createDataFrame(rows, "trace_id string, signal string, t long, seq long, value string")
    dump.write_dumps(df, str(tmp_path / "out"))
    back = dump.read_dumps(spark, str(tmp_path / "out"), split_bytes=300).collect()
    assert sorted((r.trace_id, r.signal, r.t, r.value) for r in back) == sorted((k, s, t, v) for k, s, t, _, v in rows)
    by = lambda got: {k: [x[2] for x in sorted(got) if x[0] == k] for k in {x[0] for x in got}}
    assert by([((r.trace_id, r.signal), (r.t, r.seq), r.value) for r in back]) == by([((k, s), (t, i), v) for k, s, t, i, v in rows])


def test_broken_dumps(spark, tmp_path):
    (tmp_path / "bad.vcd").write_text("$scope module top $end\n#0\n1!\n")
    with pytest.raises(Exception, match="enddefinitions"):
        dump.read_dumps(spark, str(tmp_path / "bad.vcd")).collect()
    with pytest.raises(Exception, match="missing"):
        dump.read_dumps(spark, str(tmp_path / "missing.vcd")).collect()
    (tmp_path / "empty.vcd").write_text(HEAD)
    assert dump.read_dumps(spark, str(tmp_path / "empty.vcd")).count() == 0
