"""Expressions of a table as Columns: no row goes to Python.

Expressions that differ in their names only have one shape. The shapes that occur are collected, parsed at the driver and each compiled to a Column over the
values that a row's names have; a row takes the Column of its shape. Where there are more than MOST shapes, or one that isn't plain ASCII, the
pandas UDFs of ``expr`` do the same row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits, expr

#: A signal's name in an expression, not the digits of a literal.
NAME = r"(?<![A-Za-z0-9_'$.])[A-Za-z_$][A-Za-z0-9_$.]*(?:\[[^\]]*\])*"
HOLE = "\x01"
MOST = 64


def shape_of(text: Column) -> Column:
    """An expression with a HOLE for each name; null for one that has holes of its own."""
    return F.when(~F.contains(text, F.lit(HOLE)), F.regexp_replace(text, NAME, HOLE))


def names_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(0))


def shapes_in(rows: DataFrame, text: str = "expression", most: int = MOST) -> list[str] | None:
    """The shapes of a column's expressions; None where there are too many to compile, or some that can't be."""
    found = [r[0] for r in rows.select(shape_of(F.col(text)).alias("shape")).where("shape is not null").distinct().limit(most + 1).collect()]
    return None if len(found) > most or not all(s.isascii() for s in found) else sorted(found)


def _numbered(shape: str) -> str:
    holes = iter(range(len(shape)))
    return re.sub(HOLE, lambda _: f"_{next(holes)}", shape)


def _built(tree: tuple, value: Callable[[int], Column]) -> Column:
    kind = tree[0]
    if kind == "literal":
        return F.lit(tree[1])
    if kind == "signal":
        return value(int(tree[1][1:]))
    parts = [_built(t, value) for t in tree[1:]]
    if kind == "?":
        return bits.let(lambda test: F.when(test.isNotNull(), F.when(bits.truthy(test), parts[1]).otherwise(parts[2])), parts[0])
    if kind == "{":
        return F.concat(*parts)
    if kind[0] == "u":
        f = {"!": bits.logical_not, "~": bits.invert, "-": bits.negate, "&": bits.reduce_and, "|": bits.reduce_or, "^": bits.reduce_xor}[kind[1]]
        return bits.let(lambda x: F.when(x.isNotNull(), f(x)), parts[0])
    told = {
        "&&": lambda x, y: F.when(bits.truthy(x) & bits.truthy(y), "1").otherwise("0"),
        "||": lambda x, y: F.when(bits.truthy(x) | bits.truthy(y), "1").otherwise("0"),
        "&": bits.bit_and, "|": bits.bit_or, "^": bits.bit_xor, "~^": bits.bit_xnor, "^~": bits.bit_xnor, "==": bits.equal, "===": bits.equal,
        "!=": lambda x, y: bits.invert(bits.equal(x, y)), "!==": lambda x, y: bits.invert(bits.equal(x, y)),
    }
    if kind in ("<", ">", "<=", ">="):
        f = lambda x, y: bits.compare(x, kind, y)
    else:
        f = told.get(kind) or (lambda x, y: bits.arithmetic(x, kind, y))
    return bits.let(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), f(x, y)), *parts)


def column(shape: str, value: Callable[[int], Column], precedence: str = "table") -> Column:
    """A shape's value, as expr.evaluate() tells it; value(k) is the value of its k-th name."""
    none = F.lit(None).cast("string")

    def side(text: str) -> Column:
        try:
            return _built(expr.parse(text, precedence), value)
        except (expr.Unreadable, ValueError, IndexError):
            return none

    text = _numbered(shape)
    before, arrow, after = text.partition("|->")
    if not text.strip():
        return none
    if not arrow:
        return side(text)
    try:
        expr.parse(expr.WINDOW.sub("", after), precedence)
        consequent = F.coalesce(side(expr.WINDOW.sub("", after)), F.lit("0"))
    except (expr.Unreadable, ValueError, IndexError):
        consequent = none
    return bits.let(lambda held: F.when(held.isNotNull(), F.when(bits.truthy(held), consequent).otherwise("1")), side(before))


def _by_shape(shape: Column, shapes: list[str], told: Callable[[str], Column]) -> Column:
    out = F.lit(None).cast("string")
    for s in reversed(shapes):
        out = F.when(shape == F.lit(s), told(s)).otherwise(out)
    return out


def _key(name: Column, env: Column) -> Column:
    """The name that env has for a name: itself, else the first that ends with it after a dot, else after an underscore."""

    def behind(mark: str) -> Column:
        return F.array_min(F.filter(F.map_keys(env), lambda k: F.endswith(k, F.concat(F.lit(mark), name))))

    return F.when(F.array_contains(F.map_keys(env), name), name).otherwise(F.coalesce(behind("."), behind("_")))


def _with_keys(rows: DataFrame, expression: str, env: str) -> DataFrame:
    told = rows.withColumns({"_shape": shape_of(F.col(expression)), "_names": names_of(F.col(expression))})
    return told.withColumn("_keys", F.transform("_names", lambda n: _key(n, F.col(env))))


def evaluated(rows: DataFrame, out: str, expression: str = "expression", env: str = "env", precedence: str = "table", shapes: list[str] | None = None) -> DataFrame:
    """rows with the value of each row's expression under its env map. shapes: of shapes_in(), collected here if not given."""
    shapes = shapes_in(rows, expression) if shapes is None else shapes
    if shapes is None:
        return rows.withColumn(out, expr.evaluate_udf(precedence=precedence)(expression, env))
    told = _with_keys(rows, expression, env)
    told = told.withColumn("_values", F.transform("_keys", lambda k: F.try_element_at(F.col(env), k)))
    value = lambda k: F.get("_values", F.lit(k))
    return told.withColumn(out, _by_shape(F.col("_shape"), shapes, lambda s: column(s, value, precedence))).drop("_shape", "_names", "_keys", "_values")


def evaluated_text(rows: DataFrame, out: str, text: str, env: str = "env", precedence: str = "table") -> DataFrame:
    """rows with the value of one expression under each row's env map."""
    shape = re.sub(NAME, HOLE, text)
    return evaluated(rows.withColumn("_text", F.lit(text)), out, "_text", env, precedence, [shape]).drop("_text")


def _compared(shape: str, source: Column) -> Column:
    """The bits of the first literal that a shape compares the source with."""
    out = F.lit(None).cast("string")
    try:
        tokens = expr.split_tokens(_numbered(shape).replace("|->", "?"))
    except expr.Unreadable:
        return out
    for i in range(len(tokens) - 2, 0, -1):
        if tokens[i] in ("==", "==="):
            for one, other in ((tokens[i + 1], tokens[i - 1]), (tokens[i - 1], tokens[i + 1])):
                if other[0].isdigit() and re.fullmatch(r"_\d+", one):
                    name = F.get("_names", F.lit(int(one[1:])))
                    out = F.when((name == source) | F.endswith(source, F.concat(F.lit("."), name)), F.lit(expr.literal(other))).otherwise(out)
    return out


def outcomes(rows: DataFrame, out: str, key: str, expression: str = "expression", env: str = "env", shapes: list[str] | None = None) -> DataFrame:
    """rows with a struct (original, flipped, tried), as expr.outcomes() tells it for the source that the column key names."""
    shapes = shapes_in(rows, expression) if shapes is None else shapes
    if shapes is None:
        return rows.withColumn(out, expr.outcomes_udf()(expression, env, key))
    env_, source = F.col(env), F.col(key)
    told = _with_keys(rows, expression, env).withColumn("_now", F.try_element_at(env_, source))
    wanted = _by_shape(F.col("_shape"), shapes, lambda s: _compared(s, source))
    told = told.withColumn("_wanted", wanted)
    n = F.greatest(F.length("_wanted"), F.length("_now"))
    other = F.when(bits.wide(F.col("_wanted"), n) == bits.wide(F.col("_now"), n), bits.invert(F.col("_wanted"))).otherwise(F.col("_wanted"))
    put = lambda value: F.transform("_keys", lambda k: F.when(k == source, value).otherwise(F.try_element_at(env_, k)))
    told = told.withColumn("_other", other).withColumns({"_v0": F.transform("_keys", lambda k: F.try_element_at(env_, k)), "_v1": put(bits.invert(F.col("_now"))), "_v2": put(F.col("_other"))})
    results = [_by_shape(F.col("_shape"), shapes, lambda s, i=i: column(s, lambda k: F.get(f"_v{i}", F.lit(k)))) for i in range(3)]
    told = told.withColumns({f"_r{i}": r for i, r in enumerate(results)})
    changed = F.col("_now").isNotNull() & F.col("_r0").isNotNull()
    struct = F.struct(F.col("_r0").alias("original"), F.when(changed, F.col("_r1")).alias("flipped"), F.when(changed & F.col("_wanted").isNotNull(), F.col("_r2")).alias("tried"))
    return told.withColumn(out, struct).drop("_shape", "_names", "_keys", "_now", "_wanted", "_other", "_v0", "_v1", "_v2", "_r0", "_r1", "_r2")
