"""Value-change dumps (text) as value_changes rows, one file per trace."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "trace_id string, signal string, t long, seq long, value string"
HEADER = "trace_id string, path string, timescale string, ordinal long, signal string, width int"


def parse_header(text: str) -> tuple[str, list[tuple[str, str, int]], str]:
    """(timescale, (code, signal, width) of each variable in order, the rest of the text); signals are named by their scopes."""
    scopes: list[str] = []
    found, scale = [], ""
    head, _, body = text.partition("$enddefinitions")
    for part in head.split("$end"):
        word = part.split()
        if not word:
            continue
        if word[0] == "$scope":
            scopes.append(word[-1])
        elif word[0] == "$upscope":
            scopes.pop()
        elif word[0] == "$timescale":
            scale = "".join(word[1:])
        elif word[0] == "$var":
            found.append((word[3], ".".join([*scopes, " ".join(word[4:])]), int(word[2]) if word[2].isdigit() else 1))
    return scale, found, body.partition("$end")[2]


def widened(value: str, width: int) -> str:
    """Dumps leave out leading zeros, and leading x or z that repeat."""
    return value.rjust(width, value[0] if value[0] in "xXzZ" else "0")


def parse_vcd(text: str, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(signal, t, seq, value) in file order, values as wide as declared. wanted: only these signals are decoded. Comments are left out;
    real numbers stay as they are written."""
    _, variables, body = parse_header(text)
    names: dict[str, list[tuple[str, int]]] = {}
    for code, signal, width in variables:
        if wanted is None or signal in wanted:
            names.setdefault(code, []).append((signal, width))
    now, seq = 0, 0
    words = iter(body.split())
    for w in words:
        if w[0] == "#":
            now = int(w[1:])
            continue
        if w == "$comment":
            for w in words:
                if w == "$end":
                    break
            continue
        if w[0] in "01xXzZ" and len(w) > 1:
            value, code = w[0], w[1:]
        elif w[0] in "bBrR" and len(w) > 1:
            value, code = w[1:], next(words, "")
        else:
            continue  # $dumpvars and the like
        for name, width in names.get(code, ()):
            yield name, now, seq, value if w[0] in "rR" else widened(value, width)
            seq += 1


def _files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """Files are read by Spark's own reader; one that is missing stops the job."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def _trace(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


def read_vcd(spark: SparkSession, *paths: str, signals: list[str] | None = None) -> DataFrame:
    """Traces from text dumps; trace_id is the file's name without its ending. signals: only these."""
    wanted = None if signals is None else frozenset(signals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows = [(_trace(path), *r) for r in parse_vcd(text, wanted)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["trace_id", "signal", "t", "seq", "value"])

    return _files(spark, paths).mapInArrow(run, SCHEMA)


def read_headers(spark: SparkSession, *paths: str) -> DataFrame:
    """trace_id, path, timescale, ordinal, signal, width: the declared signals in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                scale, found, _ = parse_header(text)
                rows = [{"trace_id": _trace(path), "path": path, "timescale": scale, "ordinal": i, "signal": s, "width": w} for i, (_, s, w) in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("trace_id", pa.string()), ("path", pa.string()), ("timescale", pa.string()), ("ordinal", pa.int64()), ("signal", pa.string()), ("width", pa.int32())]))

    return _files(spark, paths).mapInArrow(run, HEADER)
