"""python -m tracewright TRACE... --design SOURCE... --out FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import trace
from .plans import analyse
from .sources import rtl, vcd


def main() -> None:
    p = argparse.ArgumentParser(prog="tracewright", description="Causal graphs of failing assertions.")
    p.add_argument("traces", nargs="+", help="value-change dumps; patterns are allowed")
    p.add_argument("--design", nargs="+", default=[], help="SystemVerilog sources")
    p.add_argument("--out", default="causal_graphs", help="folder of the results")
    p.add_argument("--endpoint", help="full name of the failing signal")
    p.add_argument("--cycle", type=int)
    p.add_argument("--clock", help="full name of the clock")
    p.add_argument("--last-cycle", action="store_true", help="analyse the last cycle, not the first failing one")
    p.add_argument("--list-signals", action="store_true", help="only list the assertion-like signals of the traces")
    p.add_argument("--max-depth", type=int, default=20)
    p.add_argument("--max-nodes", type=int, default=200)
    a = p.parse_args()
    spark = SparkSession.builder.appName("tracewright").getOrCreate()
    if a.list_signals:
        listed = trace.signals(vcd.read_vcd(spark, *a.traces))
        labels = rtl.parse_labels(rtl.read_texts(spark, *a.design)) if a.design else None
        trace.assertion_signals(listed, labels).orderBy("trace_id", "signal").show(1000, truncate=False)
        return
    graph = analyse.analyse(spark, a.traces, a.design, a.endpoint, a.cycle, a.clock, a.max_depth, a.max_nodes, a.last_cycle)
    graph.problems.show(truncate=False)
    analyse.write(graph, a.out)
    graph.stats.show(truncate=False)


if __name__ == "__main__":
    main()
