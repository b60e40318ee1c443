"""Expressions compiled to Columns against the evaluator that walks their trees."""

import random

import pytest
from pyspark.sql import functions as F
from tracewright.functions import compiled, expr

NAMES = ["a", "b", "top.m.c", "u.v_d", "w[3]", "e"]
USED = ["a", "b", "c", "d", "m.c", "w[3]", "missing"]
LITERALS = ["4'b10x1", "8'hf0", "3'd9", "5", "1'b0", "2'hx"]
SCHEMA = "i long, expression string, env map<string,string>, source string"


def some(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.3:
        return r.choice(USED + LITERALS)
    if k < 0.4:
        return r.choice("!~-&|^") + f"({some(r, depth + 1)})"
    if k < 0.5:
        return f"({some(r, depth + 1)} ? {some(r, depth + 1)} : {some(r, depth + 1)})"
    if k < 0.55:
        return "{" + f"{some(r, depth + 1)}, {some(r, depth + 1)}" + "}"
    return f"{some(r, depth + 1)} {r.choice(list(expr.PRECEDENCE))} {some(r, depth + 1)}"


def rows(n=40, seed=11):
    r, out = random.Random(seed), []
    texts = [some(r) for _ in range(n)] + ["a |-> ##[1:3] b == 4'd5", "a |-> ) b", "( |-> b", "missing |-> b", "a |-> missing", "", "  ", "a b", "a == 4'd5 && 4'd2 === b", "5 == a", "@(posedge clk) a", "4'hff & w[3]"]
    for i, text in enumerate(texts * 3):
        env = {n: "".join(r.choices("0011x", k=r.choice([1, 4, 4, 8, 40]))) for n in r.sample(NAMES, r.randint(1, len(NAMES)))}
        out.append((i, text, env, r.choice(list(env))))
    return [*out, (9000, None, {"a": "1"}, "a"), (9001, "a", None, "a"), (9002, "\x01", {"a": "1"}, "a"), (9003, "a == 4'd5", {"a": "0101"}, None)]


@pytest.mark.parametrize("precedence", ["table", "ieee"])
def test_values(spark, precedence):
    cases = rows()
    df = spark.createDataFrame(cases, SCHEMA)
    assert len(compiled.shapes_in(df, most=1000)) > 30
    got = {x.i: x.told for x in compiled.evaluated(df, "told", precedence=precedence, shapes=compiled.shapes_in(df, most=1000)).collect()}
    assert got == {i: expr.evaluate(text, env or {}, precedence=precedence) for i, text, env, _ in cases}


def test_outcomes(spark):
    cases = rows(12, 5)
    df = spark.createDataFrame(cases, SCHEMA)
    out = compiled.outcomes(df, "o", "source", shapes=compiled.shapes_in(df, most=1000))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == [*df.columns, "o"]
    got = {x.i: tuple(x.o) for x in out.collect()}
    assert got == {i: expr.outcomes(text, env or {}, source) for i, text, env, source in cases}


def test_fall_back(spark):
    """More shapes than are compiled, or letters that Java's pattern doesn't take for a name."""
    df = spark.createDataFrame([(1, "sé & a", {"sé": "01", "a": "11"}, "a"), (2, "a + 1", {"a": "11"}, "a")], SCHEMA)
    assert compiled.shapes_in(df) is None and compiled.shapes_in(df.where("i = 2"), most=0) is None
    assert {x.i: x.told for x in compiled.evaluated(df, "told").collect()} == {1: "01", 2: "00"}
    assert {x.i: x.o.flipped for x in compiled.outcomes(df, "o", "source").collect()} == {1: "00", 2: "01"}
