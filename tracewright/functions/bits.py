"""Four-state bit vectors as strings, most significant bit first, in Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_binary(v: Column) -> Column:
    """The unsigned value of up to 63 known bits; null where any bit is unknown."""
    return F.when(v.rlike("^[01]{1,63}$"), F.conv(v, 2, 10).cast("bigint"))


def invert(v: Column) -> Column:
    return F.translate(v, "01", "10")


def wide(v: Column, n: Column) -> Column:
    """Padded with zeros on the left, never cut."""
    return F.lpad(v, F.greatest(F.length(v), n), F.lit("0"))


def _pairs(a: Column, b: Column, f) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.zip_with(F.split(wide(a, n), ""), F.split(wide(b, n), ""), f)


def _known(x: Column) -> Column:
    return x.isin("0", "1")


def values_differ(a: Column, b: Column) -> Column:
    """Whether a position differs where both are known; false where either is empty or null."""
    differ = F.exists(_pairs(a, b, lambda x, y: _known(x) & _known(y) & (x != y)), lambda x: x)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), differ).otherwise(F.lit(False))


def differing_bits(a: Column, b: Column) -> Column:
    return F.size(F.filter(_pairs(a, b, lambda x, y: _known(x) & _known(y) & (x != y)), lambda x: x))


def contribution(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), differing_bits(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b)) + F.lit(0.5))


def truthy(v: Column) -> Column:
    return F.coalesce(v.rlike("^[^xXzZ]*1[^xXzZ]*$"), F.lit(False))


def bit_and(a: Column, b: Column) -> Column:
    return F.array_join(_pairs(a, b, lambda x, y: F.when((x == "0") | (y == "0"), "0").when((x == "1") & (y == "1"), "1").otherwise("x")), "")


def bit_or(a: Column, b: Column) -> Column:
    return F.array_join(_pairs(a, b, lambda x, y: F.when((x == "1") | (y == "1"), "1").when((x == "0") & (y == "0"), "0").otherwise("x")), "")


def bit_xor(a: Column, b: Column) -> Column:
    return F.array_join(_pairs(a, b, lambda x, y: F.when(~(_known(x) & _known(y)), "x").when(x == y, "0").otherwise("1")), "")


def bit_xnor(a: Column, b: Column) -> Column:
    return invert(bit_xor(a, b))


def equal(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(wide(a, n) == wide(b, n), "1").otherwise("0")


#: Bits of a limb: a product of two limbs, and sums of many, fit a long.
LIMB = 24
MASK = (1 << LIMB) - 1
#: Bits of a limb that is only added.
ADDED = 60


def known(v: Column) -> Column:
    return v.rlike("^[01]+$")


def let(f, *values: Column) -> Column:
    """f of the values, each computed once however often f names it."""
    bound = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(bound, lambda s: f(*(s[f"v{i}"] for i in range(len(values))))), F.lit(0))


def _limbs(v: Column, many: Column, size: int = LIMB) -> Column:
    """The low ``many`` limbs of known bits as longs, the lowest first."""
    padded = F.lpad(v, F.greatest(F.length(v), many * size), F.lit("0"))
    return let(lambda p, m: F.transform(F.sequence(F.lit(1), m), lambda i: F.conv(F.substring(p, F.length(p) - i * size + 1, F.lit(size)), 2, 10).cast("bigint")), padded, many)


def _bits(x: Column, size: int = LIMB) -> Column:
    return F.lpad(F.bin(x), size, "0")


def _carried(sums: Column, first: int = 0, size: int = LIMB) -> Column:
    """Bits of limbs that may hold more than ``size`` bits each, a carry added to the lowest."""
    start = F.struct(F.lit(first).cast("bigint").alias("carry"), F.lit("").alias("out"))
    put = lambda x, out: F.struct(F.shiftright(x, size).alias("carry"), F.concat(_bits(x.bitwiseAND((1 << size) - 1), size), out).alias("out"))
    return F.aggregate(sums, start, lambda acc, x: let(put, x + acc["carry"], acc["out"]), lambda acc: acc["out"])


def _many(n: Column, size: int = LIMB) -> Column:
    return F.ceil(n / F.lit(size)).cast("int")


def _plus(a: Column, b: Column, n: Column, carry: int = 0) -> Column:
    sums = F.zip_with(_limbs(a, _many(n, ADDED), ADDED), _limbs(b, _many(n, ADDED), ADDED), lambda x, y: x + y)
    return F.right(_carried(sums, carry, ADDED), n)


def _minus(a: Column, b: Column, n: Column) -> Column:
    """a - b modulo 2 ** n: a, the inverse of b and one."""
    whole = _many(n, ADDED) * ADDED
    return _plus(a, invert(F.lpad(b, whole, F.lit("0"))), n, 1)


def _times(a: Column, b: Column, n: Column) -> Column:
    def product(x: Column, y: Column) -> Column:
        column = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(x, i) * F.get(y, k - i))
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), column)

    return F.right(_carried(let(product, _limbs(a, _many(n)), _limbs(b, _many(n)))), n)


def _by_halves(p: Column, q: Column) -> Column:
    """The product of longs below 2 ** 62, modulo 2 ** 62."""
    half = (1 << 31) - 1

    def product(p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
        return (p1 * q0 + p0 * q1).bitwiseAND(half) * (1 << 31) + p0 * q0

    return let(product, p.bitwiseAND(half), F.shiftright(p, 31), q.bitwiseAND(half), F.shiftright(q, 31))


def _settled(sums: Column) -> Column:
    """Limbs, the lowest first, of signed sums; and the carry that is left."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
    put = lambda x, out: F.struct(F.shiftright(x, LIMB).alias("carry"), F.concat(out, F.array(x.bitwiseAND(MASK))).alias("out"))
    return F.aggregate(sums, start, lambda acc, x: let(put, x + acc["carry"], acc["out"]))


def _divided(a: Column, b: Column, n: Column, op: str) -> Column:
    """Long division, a limb at a time: b, which is not zero, is moved until its first bit is a limb's first. A limb of the quotient is told by the
    first three limbs of the rest and the first two of b; that is right or one too much."""
    by = F.ltrim(b, F.lit("0"))

    def moved(u: Column, v: Column, m: Column, far: Column) -> Column:
        high, next_ = F.get(v, m - 1), F.coalesce(F.get(v, m - 2), F.lit(0).cast("bigint"))
        longer = F.concat(v, F.array(F.lit(0).cast("bigint")))

        def within(v1: Column, v2: Column, w: Column) -> Column:
            def step(acc: Column, limb: Column) -> Column:
                def guessed(rest: Column, quotient: Column) -> Column:
                    top = F.get(rest, m) * (1 << LIMB) + F.get(rest, m - 1)
                    below = F.coalesce(F.get(rest, m - 2), F.lit(0).cast("bigint"))

                    def lowered(q: Column, first: Column, third: Column) -> Column:
                        over = q * v2 - ((first - q * v1) * (1 << LIMB) + third)
                        return F.when(over > 0, q - F.call_function("div", over + v1 * (1 << LIMB) + v2 - 1, v1 * (1 << LIMB) + v2)).otherwise(q)

                    guess = let(lambda first, third: let(lowered, F.call_function("div", first, v1), first, third), top, below)

                    def taken(q: Column, left: Column) -> Column:
                        back = _settled(F.zip_with(left["out"], w, lambda x, y: x + y))
                        right = left["carry"] >= 0
                        return F.struct(F.slice(F.when(right, left["out"]).otherwise(back["out"]), F.lit(1), m).alias("rest"), F.concat(quotient, _bits(F.when(right, q).otherwise(q - 1))).alias("quotient"))

                    return let(lambda q: let(taken, q, _settled(F.zip_with(rest, w, lambda x, y: x - q * y))), guess)

                return let(guessed, F.concat(F.array(limb), acc["rest"]), acc["quotient"])

            k = F.size(u)
            first = F.concat(F.slice(u, k - m + 2, m - 1), F.array(F.lit(0).cast("bigint")))
            start = F.struct(first.alias("rest"), F.lit("").alias("quotient"))
            told = lambda acc: acc["quotient"]
            if op == "%":
                whole = lambda acc: F.aggregate(acc["rest"], F.lit(""), lambda out, x: F.concat(_bits(x), out))
                told = lambda acc: F.left(whole(acc), m * LIMB - far)
            return F.aggregate(F.reverse(F.slice(u, F.lit(1), k - m + 1)), start, step, told)

        return let(within, high, next_, longer)

    def sized(x: Column, y: Column, width: Column) -> Column:
        m = _many(F.length(y))

        def shifted(many: Column, far: Column) -> Column:
            zeros = F.repeat(F.lit("0"), far)
            return let(moved, _limbs(F.concat(x, zeros), _many(width + far)), _limbs(F.concat(y, zeros), many), many, far)

        return let(lambda out: F.right(F.lpad(out, F.greatest(F.length(out), width), F.lit("0")), width), let(shifted, m, m * LIMB - F.length(y)))

    return let(sized, a, by, n)


def _shifted(a: Column, op: str, b: Column, n: Column) -> Column:
    """By the value of b, up to all of a's bits."""
    far = (F.length(b) > 31) & (F.instr(F.left(b, F.length(b) - 31), "1") > 0)
    by = F.when(far, n).otherwise(F.least(n, F.conv(F.right(b, F.lit(31)), 2, 10).cast("int")))
    zeros = F.repeat(F.lit("0"), by)
    return F.right(F.concat(a, zeros), n) if op[0] == "<" else F.left(F.concat(zeros, a), n)


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """+ - * / % << >> (also <<< >>>) on unsigned values of any width, cut to the wider operand; null where a bit is unknown and for a division by zero. Up to 62 bits
    they are longs, above that limbs."""

    def told(x: Column, y: Column) -> Column:
        n = F.greatest(F.length(x), F.length(y))
        if op[0] in "<>":
            return let(lambda v, w, m: _shifted(v, op, w, m), wide(x, n), y, n)
        p, q = F.conv(x, 2, 10).cast("bigint"), F.conv(y, 2, 10).cast("bigint")
        near = {"+": lambda: p + q, "-": lambda: p - q + F.call_function("shiftleft", F.lit(1).cast("bigint"), n), "*": lambda: F.when(n <= 31, p * q).otherwise(_by_halves(p, q)), "/": lambda: F.call_function("div", p, q), "%": lambda: p % q}[op]()
        far = {"+": _plus, "-": _minus, "*": _times, "/": lambda v, w, m: _divided(v, w, m, "/"), "%": lambda v, w, m: _divided(v, w, m, "%")}[op]
        value = F.when(n <= 62, F.right(_bits(near, 63), n)).otherwise(let(far, wide(x, n), wide(y, n), n))
        return F.when(F.instr(y, "1") > 0, value) if op in "/%" else value

    return let(lambda x, y: F.when(known(x) & known(y), told(x, y)), a, b)


def compare(a: Column, op: str, b: Column) -> Column:
    """< > <= >= on unsigned values of any width; null where a bit is unknown."""

    def told(x: Column, y: Column) -> Column:
        n = F.greatest(F.length(x), F.length(y))
        v, w = wide(x, n), wide(y, n)  # bits of equal length compare as text
        holds = {"<": v < w, ">": v > w, "<=": v <= w, ">=": v >= w}[op]
        return F.when(known(x) & known(y), F.when(holds, "1").otherwise("0"))

    return let(told, a, b)


def reduce_and(v: Column) -> Column:
    return F.when(v.rlike("^1+$"), "1").otherwise("0")


def reduce_or(v: Column) -> Column:
    return F.when(F.instr(v, "1") > 0, "1").otherwise("0")


def reduce_xor(v: Column) -> Column:
    ones = F.length(v) - F.length(F.regexp_replace(v, "1", ""))
    return (ones % 2).cast("string")


def logical_not(v: Column) -> Column:
    return F.when(truthy(v), "0").otherwise("1")


def negate(v: Column) -> Column:
    """Two's complement at any width; null where a bit is unknown."""
    return let(lambda x: F.when(known(x), _minus(F.lit("0"), x, F.length(x))), v)
