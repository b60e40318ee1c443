"""A reader for the synthesizable subset of SystemVerilog that generated designs use: modules, ports,
declarations, assigns, always blocks with if and case, instances and assertions.

``parse_design`` turns one source into rows; ``read_rtl`` does so for many files in one job.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.slicer import IGNORED

NAME = re.compile(r"(?<![\w'$.])[A-Za-z_]\w*")
#: Words of the language that are no signals.
KEYWORDS = frozenset(
    "if else begin end case casex casez endcase default posedge negedge and or not assign always always_ff always_comb always_latch property endproperty assert assume cover "
    "disable iff signed unsigned logic wire reg bit byte int integer input output inout module endmodule for while do repeat forever parameter localparam genvar generate "
    "endgenerate initial final unique unique0 priority function endfunction task endtask return automatic inside".split()
)
SNIPPET_LINES = 5
#: Rows that a parsing task gives at once, or those of one text.
ROWS = 4096


def _at(*words: str) -> str:
    """A pattern of words that starts with their letters, which a search looks for, and not with a boundary, which it tries at each place."""
    return "(?:" + "|".join(rf"{w}(?<=\b{w})" for w in words) + ")" if len(words) > 1 else rf"{words[0]}(?<=\b{words[0]})"


MODULE = re.compile(_at("module") + r"\s+(\w+)")
ENDMODULE = re.compile(_at("endmodule") + r"\b")
WAY = re.compile(r"\b(input|output|inout)\b")
ITEM = re.compile(r"[,()]")
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
DIMENSION = re.compile(r"\[[^\]]*\]")


def sanitize(text: str) -> str:
    """Without the file list that a generator may append, and without trailing file names."""
    if "firrtl_black_box_resource_files.f" in text:
        text = re.sub(r"//[^\n]*firrtl_black_box_resource_files\.f.*", "", text, flags=re.DOTALL)
    lines = text.rstrip().split("\n")
    while lines and re.fullmatch(r"\s*[\w./-]+\.(?:s?v|f)\s*|\s*", lines[-1]):
        lines.pop()
    return "\n".join(lines)


def strip_comments(text: str) -> str:
    """Comments and directives blanked; line numbers stay."""
    if "/*" in text:
        text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL)
    if "//" in text:
        text = re.sub(r"//[^\n]*", "", text)
    return re.sub(r"^\s*`[^\n]*", "", text, flags=re.MULTILINE) if "`" in text else text


def modules_of(text: str) -> Iterator[tuple[str, str, int]]:
    """(module, what stands between its name and its end, offset of that)."""
    at = 0
    while (m := MODULE.search(text, at)) and (end := ENDMODULE.search(text, m.end())):
        yield m[1], text[m.end() : end.start()], m.end()
        at = end.end()


def word_before(text: str, least: int, at: int) -> int:
    """Where the word begins that ends at ``at``; ``at`` if none does."""
    while at > least and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return at


def space_before(text: str, least: int, at: int) -> int:
    """Where the white space begins that ends at ``at``."""
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def line_of(text: str) -> Callable[[int], int]:
    """The line, from 1, of each place in text."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(ends, at - 1) + 1


def number(text: str, known: dict[str, int]) -> int | None:
    """The value of a constant expression over known parameters; None if it has none."""
    if len(text) <= 200 and text.isascii() and (plain := text.strip()).isdigit():
        return int(plain)
    text = re.sub(r"\d+'[bdh][0-9a-fA-F_]+", lambda m: str(int(re.sub(r"^\d+'.", "", m[0]).replace("_", ""), {"b": 2, "d": 10, "h": 16}[m[0][m[0].index("'") + 1]])), text)
    text = re.sub(r"\$clog2\s*\(\s*(\w+)\s*\)", lambda m: str((n - 1).bit_length()) if (n := number(m[1], known)) else m[0], text)
    text = re.sub(r"[A-Za-z_]\w*", lambda m: str(known.get(m[0], m[0])), text)
    if not re.fullmatch(r"[\d\s()+*/<-]+", text) or len(text) > 200 or "**" in text:
        return None
    values, ops = [], []  # the usual precedence, left to right
    strength = {"<<": 0, "+": 1, "-": 1, "*": 2, "/": 2}

    def settle() -> None:
        b, a = values.pop(), values.pop()
        op = ops.pop()
        values.append({"+": a + b, "-": a - b, "*": a * b, "/": a // b if b else 0, "<<": a << min(b, 64)}[op])

    try:
        for token in re.findall(r"\d+|<<|[-+*/()]", text):
            if token.isdigit():
                values.append(int(token))
            elif token == "(":
                ops.append(token)
            elif token == ")":
                while ops[-1] != "(":
                    settle()
                ops.pop()
            else:
                while ops and ops[-1] != "(" and strength[ops[-1]] >= strength[token]:
                    settle()
                ops.append(token)
        while ops:
            settle()
    except (IndexError, KeyError):
        return None
    return values[0] if len(values) == 1 else None


def parameters(text: str) -> dict[str, int]:
    """Names of a module's parameters that have a constant value."""
    known: dict[str, int] = {}
    if "param" not in text:
        return known
    for m in re.finditer(r"\b(?:parameter|localparam)\b(?:\s+(?:int|integer|logic|signed|unsigned))*\s*(?:\[[^\]]*\])?\s*([^;()]*(?:\([^()]*\)[^;()]*)*)", text):
        for part in m[1].split(","):
            name, sign, value = part.partition("=")
            found = number(value.strip(), known) if sign else None
            if found is not None and re.fullmatch(r"\w+", name.split()[-1] if name.split() else ""):
                known[name.split()[-1]] = found
    return known


def targets_of(text: str) -> list[str]:
    """What an assignment's left side names: one signal, or each of a concatenation."""
    text = text.strip()
    if text.startswith("{"):
        return [t for part in re.split(r",(?![^\[]*\])", text.strip("{} \n\t")) for t in targets_of(part)]
    m = PATH.match(text)
    return [m[0]] if m else []


PATH = re.compile(r"[A-Za-z_][\w.]*")
LITERAL = re.compile(r"\d+'[bhdo][0-9a-fA-F_xXzZ]+")


def signals_of(text: str) -> list[str]:
    """Distinct names in order, without keywords and literals."""
    return list(_signals_of(text))


@lru_cache(1024)  # a condition comes with every statement that it guards
def _signals_of(text: str) -> tuple[str, ...]:
    return tuple(n for n in dict.fromkeys(NAME.findall(LITERAL.sub(" ", text))) if n not in KEYWORDS)


def closing(text: str, at: int, pair: str = "()") -> int:
    """Where the bracket at ``at`` closes."""
    if text[at : at + 1] not in pair:
        return at  # nothing opens there
    depth = 0
    for m in _either(pair).finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    raise ValueError("brackets don't match")


@cache
def _either(pair: str) -> re.Pattern:
    return re.compile(f"[{re.escape(pair)}]")


ASSERT = re.compile(r"assert\s+property\s*(?=\()")


def assertions(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(label, what is asserted, offset, offset of the closing bracket); those without a label are numbered."""
    least = 0
    for n, m in enumerate(ASSERT.finditer(text)):
        end, start, label = closing(text, m.end()), m.start(), ""
        colon = space_before(text, least, start) - 1
        if colon >= least and text[colon] == ":":
            last = space_before(text, least, colon)
            first = word_before(text, least, last)
            if first < last:
                start, label = first, text[first:last]
        yield label or f"assert_{n}", text[m.end() + 1 : end].strip(), start, end
        least = m.end()


def assertion_parts(inner: str) -> tuple[str, str, str]:
    """(clock condition, disable condition, body)."""
    clock, off = "", ""
    if inner.startswith("@"):
        end = closing(inner, inner.index("("))
        clock, inner = inner[: end + 1], inner[end + 1 :].strip()
    if inner.startswith("disable iff"):
        end = closing(inner, inner.index("("))
        off, inner = inner[inner.index("(") + 1 : end], inner[end + 1 :].strip()
    return clock, off, inner


SPACE = re.compile(r"\s*")
BLOCK_NAME = re.compile(r":\s*\w+")
ARM = re.compile(r"([^:;]+?)\s*:")
ASSIGNED = re.compile(r"\s*(\{[^=]*\}|[A-Za-z_][\w.]*\s*(?:\[[^=]*\])?)\s*(?:<=|=)(?!=)(.*)", re.DOTALL)


HEAD = re.compile(r"\s*(?:(begin|if|unique0?|priority|for|while|repeat|case[xz]?)\b)?")
ELSE, IF, END, ENDCASE = (re.compile(rf"\s*{word}\b") for word in ("else", "if", "end", "endcase"))
LOOP = re.compile(r"(?:int|integer|genvar)?\s*([A-Za-z_]\w*)\s*=")


class Statements:
    """Walks procedural code from a place on, with the condition under which it runs."""

    def __init__(self, text: str, at: int, emit, kind: str):
        self.text, self.at, self.emit, self.kind = text, at, emit, kind
        self.loops: list[str] = []  # variables of the loops around
        self.of: list[str] = []  # what default arms are arms of: their conditions don't name it

    def space(self) -> None:
        self.at = SPACE.match(self.text, self.at).end()

    def word(self, word: re.Pattern) -> bool:
        m = word.match(self.text, self.at)
        if m:
            self.at = m.end()
        return bool(m)

    def bracket(self) -> str:
        self.space()
        end = closing(self.text, self.at)
        inside, self.at = self.text[self.at + 1 : end], end + 1
        return " ".join(inside.split())

    def one(self, condition: str) -> None:
        m = HEAD.match(self.text, self.at)
        self.at, word = m.end(), m[1]
        if not word:
            end = self.text.find(";", self.at)
            end = len(self.text) if end < 0 else end
            part, start = self.text[self.at : end], self.at
            self.at = end + 1
            m = ASSIGNED.match(part)
            for target in targets_of(m[1]) if m else ():
                self.emit(target, m[2], self.kind, condition, start, end, skip=tuple(self.loops), also=" ".join(self.of))
        elif word == "begin":
            self.space()
            m = BLOCK_NAME.match(self.text, self.at)
            self.at = m.end() if m else self.at
            while not self.word(END):
                self.space()
                if self.at >= len(self.text):
                    return
                self.one(condition)
        elif word == "if":
            test = self.bracket()
            self.one(both(condition, test))
            while self.word(ELSE):
                if self.word(IF):  # a further arm doesn't carry the negation of those before it
                    self.one(both(condition, self.bracket()))
                else:
                    self.one(both(condition, f"!({test})"))
                    break
        elif word == "for":
            own = LOOP.match(self.bracket().split(";")[0])
            self.loops.append(own[1] if own else "")
            self.one(condition)
            self.loops.pop()
        elif word in ("while", "repeat"):
            self.one(both(condition, self.bracket()))
        elif word.startswith("case"):
            of = self.bracket()
            while not self.word(ENDCASE):
                self.space()
                m = ARM.match(self.text, self.at)
                if not m:
                    return
                self.at = m.end()
                if m[1] == "default":
                    self.of.append(of)
                    self.one(both(condition, "default"))
                    self.of.pop()
                else:
                    self.one(both(condition, f"{of}=={m[1]}"))
        else:  # unique, unique0, priority
            self.one(condition)


def both(condition: str, test: str) -> str:
    return f"{condition} && {test}" if condition else test


ASSIGN = re.compile(_at("assign") + r"\s+(\{[^=;]*\}|[\w.]+\s*(?:\[[^=;]*\])?)\s*=(?!=)([^;]*);")
DECLARED = re.compile(r"^\s*(?:wire|logic|reg)\s+(?:signed\s+)?(?:\[[^\]]*\]\s*)*(\w+)\s*=([^;]*);", re.MULTILINE)
ALWAYS = re.compile(_at("always") + r"(?:_ff|_comb|_latch)?\b\s*(@\s*(?:\*|\([^)]*\)))?")
PORTS = re.compile(r"\(\s*(?=\.)")
PORT = re.compile(r"\.(\w+)\s*(?=\()")


def instantiated(body: str) -> Iterator[tuple[str, str, int, int]]:
    """(module, instance, offset, offset of the bracket) of what is followed by named ports."""
    least = 0
    for m in PORTS.finditer(body):
        last = space_before(body, least, m.start())
        name = word_before(body, least, last)
        gap = space_before(body, least, name)
        first = word_before(body, least, gap)
        if first < gap < name < last:
            yield body[first:gap], body[name:last], first, m.start()
        least = m.end()


def parse_design(text: str, keep: Callable[[str, str], bool] | None = None, snippets: bool = True) -> list[dict]:
    """Dependency rows of all modules of one source, each with up to SNIPPET_LINES lines of it. A concatenation on the left has rows for
    each of its signals; a loop's body counts once, and its variable is no signal. Rows are made where keep(dep_type, target) holds;
    the whole text is read all the same, and what can't be parsed raises the same errors."""
    text = sanitize(text)
    lines = text.split("\n") if snippets else []
    text = strip_comments(text)
    line = line_of(text)
    rows: list[dict] = []

    def add(module, sources, target, kind, expression, condition, start, end):
        if not sources or keep and not keep(kind, target):
            return
        first = line(start)
        row = {"module": module, "source": "", "target": target, "dep_type": kind, "expression": expression, "condition": condition, "line": first, "line_end": first if end == start else line(end)}
        if snippets:
            row["snippet"] = "\n".join(lines[first - 1 : min(row["line_end"], first - 1 + SNIPPET_LINES)])
        rows.extend({**row, "source": s} for s in sources)

    modules = list(modules_of(text))
    ports: dict[str, dict[str, str]] = {}
    for module, body, _ in modules:
        found, way = {}, ""
        for item in ITEM.split(body[: body.find(";")]):
            if d := WAY.search(item):
                way = d[1]
            if way and (n := IDENTIFIER.findall(DIMENSION.sub(" ", item) if "[" in item else item)):
                found[n[-1]] = way
        ports[module] = found
    for module, body, offset in modules:
        constants = frozenset(parameters(body))

        def emit(target, expression, kind, condition, at, end, module=module, offset=offset, skip=(), also="", constants=constants):
            if keep and not keep(kind, target):
                return
            expression = " ".join(expression.split())
            direct = [s for s in _signals_of(expression) if s != target and s not in skip and s not in constants]
            add(module, direct, target, kind, expression, condition, offset + at, offset + end)
            if condition or also:
                guards = [s for s in _signals_of(f"{condition} {also}") if s != target and s not in direct and s != "default" and s not in skip and s not in constants]
                add(module, guards, target, kind, condition, condition, offset + at, offset + end)

        for label, inner, at, end in assertions(body):
            clock, _, said = assertion_parts(inner)
            said = " ".join(said.split())
            add(module, [s for s in _signals_of(said) if s not in IGNORED], label, "assertion", said, clock, offset + at, offset + end)
        for a in ASSIGN.finditer(body):
            for target in targets_of(a[1]):
                emit(target, a[2], "combinational", "", a.start(), a.end())
        for a in DECLARED.finditer(body):
            emit(a[1], a[2], "combinational", "", a.start(1), a.end())
        for a in ALWAYS.finditer(body):
            clocked = a[1] and ("posedge" in a[1] or "negedge" in a[1])
            Statements(body, a.end(), emit, "sequential" if clocked else "combinational").one("")
        for of, instance, at, opens in instantiated(body):
            if of in ports and of != module:
                inside, at = body[opens + 1 : closing(body, opens)], offset + at
                for p in PORT.finditer(inside):
                    said = inside[p.end() + 1 : closing(inside, p.end())]
                    way, port = ports[of].get(p[1], "inout"), f"{instance}.{p[1]}"
                    for s in _signals_of(said):
                        if way in ("input", "inout"):
                            add(module, (s,), port, "port_input", said.strip(), "", at, at)
                        if way in ("output", "inout"):
                            add(module, (port,), s, "port_output", said.strip(), "", at, at)
    return rows


def instances_of(text: str) -> list[tuple[str, str]]:
    """(instance, module) of every instantiation by named ports."""
    found = re.findall(r"\b([A-Za-z_]\w*)\s+([A-Za-z_]\w*)\s*\(\s*(?=\.)", strip_comments(sanitize(text)))
    return [(instance, module) for module, instance in found if module not in KEYWORDS]


LABEL = re.compile(r"^\s*([a-zA-Z_$][\w$]*)\s*:\s*assert\s+property\b", re.MULTILINE)
PORT_TYPES = {"input": "in", "output": "out"}
RANGE = re.compile(r"\[([^\[\]:]+):([^\[\]:]+)\]")


def labels_of(text: str) -> list[str]:
    """Labels of assertions, on the same line or the line before; those without a label are left out."""
    return LABEL.findall(text)


def width(text: str, known: dict[str, int] | None = None) -> int:
    """Bits of a range of numbers or known parameters; 1 without one."""
    m = RANGE.search(text) if "[" in text else None
    if not m:
        return 1
    ends = [number(x, known or {}) for x in (m[1], m[2])]
    return 1 if None in ends else abs(ends[0] - ends[1]) + 1


PORT_LIST = re.compile(r"[^,()]+")
DECLARATION = re.compile(_at("wire", "logic", "reg") + r"\b\s*(?:signed\b)?\s*((?:\[[^\]]*\]\s*)*)(\w[^;]*);")
FIRST = re.compile(r"\s*([A-Za-z_]\w*)")


def signals_in(text: str) -> list[dict]:
    """(module, name, signal_type, width, line) of ports and inner declarations; the latter are all reg."""
    text = strip_comments(sanitize(text))
    line = line_of(text)
    rows: list[dict] = []
    for module, body, offset in modules_of(text):
        known = parameters(body)
        head = body.find(";")
        way, bits, ported, inside = "", 1, body[:head], body[head:]
        for item in PORT_LIST.finditer(ported):
            said = item[0]
            if d := WAY.search(said):
                way, bits = d[1], width(said, known)
            if way and (n := list(IDENTIFIER.finditer(RANGE.sub(lambda r: " " * len(r[0]), said) if "[" in said else said))):
                rows.append({"module": module, "name": n[-1][0], "signal_type": PORT_TYPES.get(way, way), "width": bits, "line": line(offset + item.start() + n[-1].start())})
        for d in DECLARATION.finditer(inside):
            names = [d[2].split("=")[0]] if "=" in d[2] else d[2].split(",")
            found, bits, at = [m[1] for n in names if (m := FIRST.match(n))], width(d[1], known), line(offset + head + d.start(2))
            rows.extend({"module": module, "name": n, "signal_type": "reg", "width": bits, "line": at} for n in found)
    return rows


def assertions_in(text: str) -> list[dict]:
    """(label, clock, disable, body, line) of every assertion, with whitespace squeezed."""
    text = strip_comments(sanitize(text))
    line = line_of(text)
    return [dict(zip(("label", "clock", "disable", "body", "line"), (label, *(" ".join(x.split()) for x in assertion_parts(inner)), line(at)), strict=True)) for label, inner, at, _ in assertions(text)]


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value (the whole text) of many source files."""
    from pyspark.sql import functions as F

    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def _parsed(texts: DataFrame, parse, columns: str) -> DataFrame:
    """The rows that parse(text) gives for texts(path, value), with file. A text that can't be parsed gives a warning and no rows."""
    fields = [f.split() for f in columns.split(", ")]
    made = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}[t]) for n, t in fields] + [("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, files = [], []
        batch = lambda: pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in found], made.field(n).type) for n, _ in fields), pa.array(files, pa.string())], schema=made)
        for given in batches:
            for path, text in zip(given.column("path").to_pylist(), given.column("value").to_pylist(), strict=True):
                try:
                    rows = parse(text or "")
                except (ValueError, IndexError, RecursionError) as wrong:
                    warnings.warn(f"{path} can't be parsed: {wrong}", stacklevel=1)
                    continue
                found += rows
                files += [path] * len(rows)
                if len(found) >= ROWS:
                    yield batch()
                    found, files = [], []
        yield batch()

    return texts.select("path", "value").mapInArrow(run, f"{columns}, file string")


def parse_signals(texts: DataFrame) -> DataFrame:
    return _parsed(texts, signals_in, "module string, name string, signal_type string, width int, line int")


def parse_assertions(texts: DataFrame) -> DataFrame:
    return _parsed(texts, assertions_in, "label string, clock string, disable string, body string, line int")


def parse_labels(texts: DataFrame) -> DataFrame:
    return _parsed(texts, lambda text: [{"label": x} for x in labels_of(text)], "label string")


def parse_instances(texts: DataFrame) -> DataFrame:
    return _parsed(texts, lambda text: [{"instance": i, "module": m} for i, m in instances_of(text)], "instance string, module string")


def parse_dependencies(texts: DataFrame, keep: Callable[[str, str], bool] | None = None, snippets: bool = True) -> DataFrame:
    """Rows of parse_design(), those for which keep(dep_type, target) holds, with or without the column snippet."""
    columns = "module string, source string, target string, dep_type string, expression string, condition string, line int, line_end int"
    return _parsed(texts, lambda text: parse_design(text, keep, snippets), columns + ", snippet string" * snippets)


def read_instances(spark: SparkSession, *paths: str) -> DataFrame:
    """instance, module of many source files."""
    return parse_instances(read_texts(spark, *paths)).select("instance", "module")


def read_rtl(spark: SparkSession, *paths: str) -> DataFrame:
    """Dependency rows of many source files, with the file of each."""
    return parse_dependencies(read_texts(spark, *paths))
