"""Value-change dumps as a data source: ``spark.read.format("value_change_dump")``.

A dump is read in splits of some bytes, each its own task: a split owns the lines that begin in it. Which time holds where it begins is found by reading
backwards to the last time mark, so no task waits for another one and none reads a whole file. Filters on trace_id, signal and t reach the reader where
``spark.sql.python.filterPushdown.enabled`` is set, as do the options signals, since and until: lines of other signals aren't decoded, and a split stops
at the first time behind the last one asked for. Values and their codes stand on one line, as writers put them.

Rows are those of ``vcd.read_vcd()``, but seq is the change's place in the file in bytes. trace_id is that of a directory ``trace_id=...``, else the
file's name without its ending. Folders are read as a whole, files that begin with a dot or an underscore left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .. import tables
from .vcd import SCHEMA, parse_header, widened

NAME = "value_change_dump"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT = 64 << 20
CHUNK = 4 << 20
ROWS = 1 << 16
COMMENT = re.compile(rb"\$comment\b.*?\$end\b", re.S)
MARK = re.compile(rb"^[ \t]*#(\d+)", re.M)


def _open(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inside


def _files(path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in order."""
    from pyarrow import fs

    system, inside = _open(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(inside, recursive=True)), key=lambda x: x.path)
    scheme = path[: len(path) - len(inside)] if path.endswith(inside) else "file://" if path.startswith("file:") else ""
    for x in every:
        if x.is_file and not x.base_name.startswith((".", "_")):
            yield scheme + x.path, x.size


def trace_of(path: str) -> str:
    told = re.search(r"/trace_id=([^/]*)/", path)
    name = path.rpartition("/")[2]
    return told[1] if told else name.rpartition(".")[0] or name


def _header(f) -> tuple[list[tuple[str, str, int]], int]:
    """The variables, and where the changes begin."""
    head = b""
    while True:
        more = f.read(CHUNK)
        head += more
        end = head.find(b"$end", head.find(b"$enddefinitions") + 15) if b"$enddefinitions" in head else -1
        if end >= 0:
            return parse_header(head[: end + 4].decode("utf-8", "replace"))[1], end + 4
        if not more:
            raise ValueError("a dump without $enddefinitions")


def _lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a split; start is where one begins."""
    f.seek(start)
    at, rest = start, b""
    while at < end:
        more = f.read(CHUNK)
        *whole, rest = (rest + more).split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        if not more:
            if rest and at < end:
                yield at, rest
            return


def _line_from(f, start: int, first: int) -> int:
    """Where the first line at or behind start begins; changes begin at first."""
    if start <= first:
        return first
    at = start - 1
    f.seek(at)
    while more := f.read(4096):
        cut = more.find(b"\n")
        if cut >= 0:
            return at + cut + 1
        at += len(more)
    return at


def _before(f, start: int, first: int) -> tuple[int, bool]:
    """(the time, whether in a comment) at the start of a line, read backwards in growing steps."""
    step = 1 << 12
    while True:
        low = max(first, start - step)
        f.seek(low)
        text = COMMENT.sub(b"", f.read(start - low))
        opened = text.rfind(b"$comment")
        marks = MARK.findall(text if opened < 0 else text[:opened]) if low == first else MARK.findall((text if opened < 0 else text[:opened]).partition(b"\n")[2])
        if marks or low == first:
            return int(marks[-1]) if marks else 0, opened >= 0
        step *= 8


def _changes(f, start: int, end: int, known: dict[bytes, list[tuple[str, int]]], now: int, comment: bool, since: int | None, until: int | None) -> Iterator[tuple[str, int, int, str]]:
    """(signal, t, seq, value) of the lines of a split."""
    if until is not None and now > until:
        return
    for at, line in _lines(f, start, end):
        words = iter(enumerate(line.split()))
        for k, w in words:
            if comment or w == b"$comment":
                comment = w != b"$end"
            elif w[:1] == b"#":
                now = int(w[1:])
                if until is not None and now > until:
                    return
            elif w[0] in b"01xXzZ" and len(w) > 1 or w[0] in b"bBrR" and len(w) > 1:
                long = w[0] in b"bBrR"
                value, code = (w[1:], next(words, (k, b""))[1]) if long else (w[:1], w[1:])
                if since is None or now >= since:
                    for name, width in known.get(code, ()):
                        yield name, now, at + k, value.decode() if w[0] in b"rR" else widened(value.decode(), width)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitbytes") or SPLIT)
        self.signals = frozenset(json.loads(options["signals"])) if options.get("signals") else None
        self.since, self.until = (int(options[k]) if options.get(k) else None for k in ("since", "until"))
        self.traces: frozenset[str] | None = None

    def partitions(self) -> list[Split]:
        found = [(p, size) for path in self.paths for p, size in _files(path) if self.traces is None or trace_of(p) in self.traces]
        return [Split(p, at, min(size, at + self.split)) for p, size in found for at in range(0, size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, inside = _open(partition.path)
        with system.open_input_file(inside) as f:
            variables, first = _header(f)
            known: dict[bytes, list[tuple[str, int]]] = {}
            for code, signal, width in variables:
                if self.signals is None or signal in self.signals:
                    known.setdefault(code.encode(), []).append((signal, width))
            start = _line_from(f, partition.start, first)
            if start >= partition.end or not known:
                return
            now, comment = _before(f, start, first)
            rows: list[tuple] = []
            for row in _changes(f, start, partition.end, known, now, comment, self.since, self.until):
                rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(trace_of(partition.path), rows)
                    rows = []
            if rows:
                yield self._batch(trace_of(partition.path), rows)

    @staticmethod
    def _batch(trace: str, rows: list[tuple]) -> pa.RecordBatch:
        signal, t, seq, value = zip(*rows, strict=True)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([trace] * len(rows), signal, t, seq, value), kinds, strict=True)], ["trace_id", "signal", "t", "seq", "value"])


class FilteringReader(DumpReader):
    """Takes filters of trace_id, signal and t over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for x in filters:
            column = x.attribute[0] if getattr(x, "attribute", None) and len(x.attribute) == 1 else None
            if column in ("signal", "trace_id") and isinstance(x, EqualTo | In):
                values = frozenset([x.value] if isinstance(x, EqualTo) else x.value)
                name = "signals" if column == "signal" else "traces"
                before = getattr(self, name)
                setattr(self, name, values if before is None else before & values)
            elif column == "t" and isinstance(x, GreaterThan | GreaterThanOrEqual | EqualTo):
                least = x.value + isinstance(x, GreaterThan)
                self.since = least if self.since is None else max(self.since, least)
                if isinstance(x, EqualTo):
                    self.until = x.value if self.until is None else min(self.until, x.value)
            elif column == "t" and isinstance(x, LessThan | LessThanOrEqual):
                most = x.value - isinstance(x, LessThan)
                self.until = most if self.until is None else min(self.until, most)
            elif not isinstance(x, IsNotNull):  # no column is ever null
                yield x


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else DumpReader)(self.options)


def read_dumps(spark: SparkSession, *paths: str, signals: list[str] | None = None, since: int | None = None, until: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """trace_id, signal, t, seq, value of dumps or folders of them, in splits of so many bytes."""
    spark.dataSource.register(DumpSource)
    options = {"paths": json.dumps(paths), "splitBytes": split_bytes, "pushdown": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    options |= {k: v for k, v in (("signals", json.dumps(signals) if signals is not None else None), ("since", since), ("until", until)) if v is not None}
    return spark.read.format(NAME).options(**options).load()


def write_dumps(changes: DataFrame, path: str, timescale: str = "1us") -> None:
    """changes(trace_id, signal, t, seq, value) as a dump for each trace, ``path/trace_id=.../``: Spark's text writer gets each trace's lines in order.
    Names before the last dot are scopes; a signal is as wide as its widest value. A dump is one file, so a trace is written by one task."""
    from pyspark.sql import Window

    code = F.concat(F.lit("s"), F.row_number().over(Window.partitionBy("trace_id").orderBy("signal")).cast("string"))  # a row a signal
    known = changes.groupBy("trace_id", "signal").agg(F.max(F.length("value")).alias("width")).withColumn("code", code)
    parts = F.split("signal", r"\.")
    scopes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.concat(F.lit("$scope module "), s, F.lit(" $end\n")))
    ups = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _: F.lit("\n$upscope $end"))
    var = F.concat(F.array_join(scopes, ""), F.lit("$var wire "), F.col("width").cast("string"), F.lit(" "), "code", F.lit(" "), F.element_at(parts, -1), F.lit(" $end"), F.array_join(ups, ""))
    line = lambda kind, value: (F.lit(kind).alias("kind"), value.alias("line"))
    none = (F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("seq"))
    traces = known.select("trace_id").distinct()
    lines = traces.select("trace_id", *none, *line(0, F.lit(f"$timescale {timescale} $end")))
    lines = lines.unionByName(known.select("trace_id", none[0], F.row_number().over(Window.partitionBy("trace_id").orderBy("signal")).cast("long").alias("seq"), *line(1, var)))
    lines = lines.unionByName(traces.select("trace_id", *none, *line(2, F.lit("$enddefinitions $end"))))
    told = changes.join(known.select("trace_id", "signal", "code"), ["trace_id", "signal"])
    lines = lines.unionByName(told.select("trace_id", "t", "seq", *line(3, F.concat(F.lit("#"), F.col("t").cast("string"), F.lit("\nb"), "value", F.lit(" "), "code"))))
    lines.repartition("trace_id").sortWithinPartitions("trace_id", "kind", "t", "seq").select("trace_id", "line").write.partitionBy("trace_id").text(path)


def saved_dumps(changes: DataFrame) -> str:
    """write_dumps() to a new folder of the shared one; where."""
    path = tables.new_path(changes.sparkSession)
    write_dumps(changes, path)
    return path
