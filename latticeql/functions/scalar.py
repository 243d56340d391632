"""Scalar, vector and tensor functions as column expressions. Each stays in generated code."""

from __future__ import annotations

from itertools import permutations
from math import factorial as _factorial

from pyspark.sql import Column
from pyspark.sql import functions as F


def propagate(a: Column, b: Column, out: Column) -> Column:
    """Not a number if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(out)


def max1(a: Column, b: Column) -> Column:
    return propagate(a, b, F.greatest(a, b))


def min1(a: Column, b: Column) -> Column:
    return propagate(a, b, F.least(a, b))


def bitsign(x: Column) -> Column:
    """1 if the sign bit is set, that of -0.0 too, else 0. A zero's sign shows in its text alone: comparisons don't tell it."""
    x = x.cast("double")
    return F.when(x < 0, 1).when((x == 0) & x.cast("string").startswith("-"), 1).otherwise(0)


def flipsign(x: Column, y: Column) -> Column:
    return F.when(bitsign(y) == 1, -x).otherwise(x)


def pown(x: Column, n: int) -> Column:
    """A power by products; the inverse for a negative exponent."""
    out, base, m = F.lit(1.0), x, abs(n)
    while m:
        out, base, m = (out * base if m & 1 else out), base * base, m >> 1
    return F.lit(1.0) / out if n < 0 else out


def factorial(n: int) -> int:
    return _factorial(n)


def linterp(i0: Column, x0: Column, i1: Column, x1: Column, i: Column) -> Column:
    return x0 + (x1 - x0) * (i - i0) / (i1 - i0)


def _quotient(x: Column, y: Column) -> tuple:
    """(quotient towards zero, remainder, divisor, whether the quotient has a rest) of whole numbers; null for a divisor of 0."""
    x, y = x.cast("long"), F.nullif(y.cast("long"), F.lit(0).cast("long"))
    rest = x % y
    return F.call_function("div", x, y), rest, y, rest != 0


def div_floor(x: Column, y: Column) -> Column:
    q, r, y, some = _quotient(x, y)
    return F.when(some & ((r < 0) != (y < 0)), q - 1).otherwise(q)


def mod_floor(x: Column, y: Column) -> Column:
    _, r, y, some = _quotient(x, y)
    return F.when(some & ((r < 0) != (y < 0)), r + y).otherwise(r)


def div_ceil(x: Column, y: Column) -> Column:
    q, r, y, some = _quotient(x, y)
    return F.when(some & ((r < 0) == (y < 0)), q + 1).otherwise(q)


def mod_ceil(x: Column, y: Column) -> Column:
    _, r, y, some = _quotient(x, y)
    return F.when(some & ((r < 0) == (y < 0)), r - y).otherwise(r)


def align_floor(x: Column, y: Column) -> Column:
    return x.cast("long") - mod_floor(x, y)


def align_ceil(x: Column, y: Column) -> Column:
    return x.cast("long") - mod_ceil(x, y)


# -- vectors and matrices: Python lists of columns ---------------------------------------------------------------------


def dot(a: list, b: list) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def det(m: list) -> Column:
    """Of a small matrix, by permutations."""
    out = F.lit(0.0)
    for p in permutations(range(len(m))):
        odd = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        term = F.lit(-1.0 if odd else 1.0)
        for r, c in enumerate(p):
            term = term * m[r][c]
        out = out + term
    return out


def inverse(m: list) -> list:
    """By cofactors; null where the determinant is 0."""
    n, d = len(m), det(m)
    safe = F.when(d != 0, d)
    minor = lambda r, c: [[m[i][j] for j in range(n) if j != c] for i in range(n) if i != r]
    return [[(F.lit(float((-1) ** (r + c))) * det(minor(c, r))) / safe for c in range(n)] for r in range(n)]


def trace(m: list, inverse_metric: list) -> Column:
    return sum((inverse_metric[i][j] * m[j][i] for i in range(len(m)) for j in range(len(m))), F.lit(0.0))


# -- pairs: complex (re, im), dual (val, eps) and rational (num, den) numbers as tuples of columns ----------------------


def c_mul(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def c_div(a: tuple, b: tuple) -> tuple:
    n = F.nullif(b[0] * b[0] + b[1] * b[1], F.lit(0.0))
    re, im = c_mul(a, (b[0], -b[1]))
    return re / n, im / n


def c_exp(a: tuple) -> tuple:
    return F.exp(a[0]) * F.cos(a[1]), F.exp(a[0]) * F.sin(a[1])


def d_mul(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0], a[0] * b[1] + a[1] * b[0]


def d_div(a: tuple, b: tuple) -> tuple:
    v = F.nullif(b[0], F.lit(0.0))
    return a[0] / v, (a[1] - a[0] / v * b[1]) / v


def d_sqrt(a: tuple) -> tuple:
    r = F.sqrt(a[0])
    return r, a[1] / F.nullif(2 * r, F.lit(0.0))


def d_min(a: tuple, b: tuple) -> tuple:
    return F.when(a[0] <= b[0], a[0]).otherwise(b[0]), F.when(a[0] <= b[0], a[1]).otherwise(b[1])


def gcd(a: Column, b: Column, rounds: int = 92) -> Column:
    """Euclid's algorithm as a fold. 92 rounds suffice for any two 63-bit numbers."""
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    turn = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: s["x"])


def r_normal(num: Column, den: Column) -> tuple:
    g = F.greatest(gcd(num, den), F.lit(1).cast("long"))
    s = F.when(den < 0, -1).otherwise(1)
    return s * F.call_function("div", num.cast("long"), g), s * F.call_function("div", den.cast("long"), g)


def bisect(f, low: Column, high: Column, steps: int) -> Column:
    """A root between low and high of an increasing function of a column, by a fold."""
    start = F.struct(low.alias("a"), high.alias("b"))

    def turn(s: Column, _: Column) -> Column:
        m = (s["a"] + s["b"]) / F.lit(2.0)
        return F.when(f(m) <= 0, F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn, lambda s: (s["a"] + s["b"]) / F.lit(2.0))


def newton(f, df, x: Column, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda s, _: s - f(s) / df(s))


def halley(f, df, ddf, x: Column, steps: int) -> Column:
    turn = lambda s, _: s - 2 * f(s) * df(s) / (2 * df(s) * df(s) - f(s) * ddf(s))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, turn)


def schroder(f, df, ddf, x: Column, steps: int) -> Column:
    turn = lambda s, _: s - f(s) / df(s) - f(s) * f(s) * ddf(s) / (2 * df(s) * df(s) * df(s))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, turn)


def newton2(f, jacobian, x: Column, y: Column, steps: int) -> tuple:
    """Newton's method for two equations: f(x, y) gives two columns, jacobian(x, y) their four derivatives by rows."""

    def turn(s: Column, _: Column) -> Column:
        (u, v), (a, b, c, d) = f(s["x"], s["y"]), jacobian(s["x"], s["y"])
        n = a * d - b * c
        return F.struct((s["x"] - (d * u - b * v) / n).alias("x"), (s["y"] - (a * v - c * u) / n).alias("y"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("x"), y.alias("y")), turn)
    return out["x"], out["y"]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def bracket(f, guess: Column, factor: float, steps: int) -> tuple:
    """Ends with a root of an increasing function between them, from a positive guess: multiplied or divided by the factor until the
    sign changes."""

    def turn(s: Column, _: Column) -> Column:
        up, down = F.struct(s["b"].alias("a"), (s["b"] * F.lit(factor)).alias("b")), F.struct((s["a"] / F.lit(factor)).alias("a"), s["a"].alias("b"))
        return F.when(f(s["b"]) < 0, up).when(f(s["a"]) > 0, down).otherwise(s)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(guess.alias("a"), guess.alias("b")), turn)
    return out["a"], out["b"]


def brent(f, low: Column, high: Column, steps: int) -> Column:
    """A root between two places of opposite sign: secant or inverse quadratic steps that fall back to halving."""

    def state(a, fa, b, fb, c, fc) -> Column:
        """b is the better end."""
        names = ("a", "fa", "b", "fb", "c", "fc")
        straight = F.struct(*[x.alias(n) for x, n in zip((a, fa, b, fb, c, fc), names, strict=True)])
        turned = F.struct(*[x.alias(n) for x, n in zip((b, fb, a, fa, c, fc), names, strict=True)])
        return F.when(F.abs(fa) >= F.abs(fb), straight).otherwise(turned)

    def turn(s: Column, _: Column) -> Column:
        a, fa, b, fb, c, fc = (s[n] for n in ("a", "fa", "b", "fb", "c", "fc"))
        ratio = F.try_divide
        quadratic = a * ratio(fb * fc, (fa - fb) * (fa - fc)) + b * ratio(fa * fc, (fb - fa) * (fb - fc)) + c * ratio(fa * fb, (fc - fa) * (fc - fb))
        step = F.coalesce(quadratic, b - ratio(fb * (b - a), fb - fa), b)
        edge, half = (F.lit(3.0) * a + b) / F.lit(4.0), (a + b) / F.lit(2.0)
        good = step.between(F.least(edge, b), F.greatest(edge, b)) & (F.abs(step - b) < F.abs(b - c))
        moved = lambda x: let(f(x["x"]), lambda y: F.when(fa * y < 0, state(a, fa, x["x"], y, b, fb)).otherwise(state(x["x"], y, b, fb, b, fb)))
        return F.when((fb == 0) | (a == b), s).otherwise(let(F.when(good, step).otherwise(half), lambda x: let(F.struct(x.alias("x")), moved)))

    start = state(low, f(low), high, f(high), low, f(low))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn, lambda s: s["b"])


def c_sqrt(a: tuple) -> tuple:
    """The root with a real part of at least 0."""
    r = F.sqrt(a[0] * a[0] + a[1] * a[1])
    im = F.sqrt(F.greatest((r - a[0]) / F.lit(2.0), F.lit(0.0)))
    return F.sqrt(F.greatest((r + a[0]) / F.lit(2.0), F.lit(0.0))), F.when(a[1] < 0, -im).otherwise(im)


def c_pow(a: tuple, n: int) -> tuple:
    out = (F.lit(1.0), F.lit(0.0))
    for _ in range(abs(n)):
        out = c_mul(out, a)
    return c_div((F.lit(1.0), F.lit(0.0)), out) if n < 0 else out


def c_sin(a: tuple) -> tuple:
    return F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])


def c_cos(a: tuple) -> tuple:
    return F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])


def d_exp(a: tuple) -> tuple:
    return F.exp(a[0]), a[1] * F.exp(a[0])


def d_sin(a: tuple) -> tuple:
    return F.sin(a[0]), a[1] * F.cos(a[0])


def d_cos(a: tuple) -> tuple:
    return F.cos(a[0]), -a[1] * F.sin(a[0])


def d_pow(a: tuple, n: int) -> tuple:
    return pown(a[0], n), F.lit(float(n)) * pown(a[0], n - 1) * a[1]


def d_abs(a: tuple) -> tuple:
    return F.abs(a[0]), flipsign(a[1], a[0])


def r_add(a: tuple, b: tuple) -> tuple:
    return r_normal(a[0] * b[1] + b[0] * a[1], a[1] * b[1])


def r_mul(a: tuple, b: tuple) -> tuple:
    return r_normal(a[0] * b[0], a[1] * b[1])


def r_div(a: tuple, b: tuple) -> tuple:
    return r_normal(a[0] * b[1], a[1] * b[0])


def _crossed(a: tuple, b: tuple) -> tuple:
    """Products that compare as the numbers do, for positive denominators, in 38 digits: two longs fit."""
    wide = [[x.cast("long").cast("decimal(19,0)") for x in p] for p in (a, b)]
    return wide[0][0] * wide[1][1], wide[1][0] * wide[0][1]


def r_less(a: tuple, b: tuple) -> Column:
    """For positive denominators."""
    x, y = _crossed(a, b)
    return x < y


def r_equal(a: tuple, b: tuple) -> Column:
    x, y = _crossed(a, b)
    return x == y


def r_abs(a: tuple) -> tuple:
    return F.abs(a[0]), F.abs(a[1])


def r_max(a: tuple, b: tuple) -> tuple:
    less = r_less(a, b)
    return F.when(less, b[0]).otherwise(a[0]), F.when(less, b[1]).otherwise(a[1])


def r_min(a: tuple, b: tuple) -> tuple:
    less = r_less(b, a)
    return F.when(less, b[0]).otherwise(a[0]), F.when(less, b[1]).otherwise(a[1])


def r_pow(a: tuple, n: int) -> tuple:
    """A power by products of whole numbers; the inverse's for a negative exponent."""
    num, den = (a[1], a[0]) if n < 0 else a
    x, y = F.lit(1).cast("long"), F.lit(1).cast("long")
    for _ in range(abs(n)):
        x, y = x * num, y * den
    return r_normal(x, y)


def c_norm(a: tuple) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def c_cbrt(a: tuple) -> tuple:
    """The principal cube root."""
    r, t = F.cbrt(F.sqrt(c_norm(a))), F.atan2(a[1], a[0]) / F.lit(3.0)
    return r * F.cos(t), r * F.sin(t)


def d_cbrt(a: tuple) -> tuple:
    r = F.cbrt(a[0])
    return r, a[1] / F.nullif(F.lit(3.0) * r * r, F.lit(0.0))


def d_max(a: tuple, b: tuple) -> tuple:
    return F.when(a[0] >= b[0], a[0]).otherwise(b[0]), F.when(a[0] >= b[0], a[1]).otherwise(b[1])


def sum_symm(n: int, term) -> Column:
    """The sum of term(a, b), symmetric in both, over all pairs of n indices, from those with a <= b."""
    return sum((F.lit(1.0 if a == b else 2.0) * term(a, b) for a in range(n) for b in range(a, n)), F.lit(0.0))


def checked(a: Column, b: Column) -> dict:
    """Sum, difference, product, quotient, remainder and negative of whole numbers; null where they overflow. Operands are bound first: the optimizer
    would else fold the constants of nested products, and an overflow of its own would look like one of theirs."""
    bound = F.struct(a.alias("a"), b.alias("b"))
    rules = {"added": F.try_add, "subtracted": F.try_subtract, "multiplied": F.try_multiply}

    def of(rule) -> Column:
        return let(bound, lambda x: rule(x["a"], x["b"]))

    def whole(rule) -> Column:
        """Null by zero, and where the least number is divided by -1, as its quotient doesn't fit."""

        def checked_(x: Column) -> Column:
            bad = (x["b"] == 0) | ((x["b"] == -1) & (x["a"] == F.lit(-(2**63)).cast("long")))
            return F.when(~bad, rule(x["a"], F.when(~bad, x["b"])))

        return let(bound, checked_)

    more = {"divided": whole(lambda x, y: F.call_function("div", x, y)), "remainder": whole(lambda x, y: x % y)}
    return {n: of(rule) for n, rule in rules.items()} | more | {"negated": let(a, lambda x: F.try_subtract(F.lit(0).cast("long"), x))}


def einsum(spec: str, *tensors: list) -> list | Column:
    """An Einstein sum over nested lists of columns, as "ij,jk->ik": indices that the result lacks are summed over."""
    from itertools import product

    inputs, _, out = spec.replace(" ", "").partition("->")
    names = inputs.split(",")
    sizes: dict = {}
    for letters, t in zip(names, tensors, strict=True):
        for x in letters:
            sizes[x], t = len(t), t[0]
    summed = sorted(set(sizes) - set(out))

    def at(t, letters: str, where: dict) -> Column:
        for x in letters:
            t = t[where[x]]
        return t

    def total(where: dict) -> Column:
        terms = []
        for values in product(*(range(sizes[x]) for x in summed)):
            place, term = where | dict(zip(summed, values, strict=True)), None
            for letters, t in zip(names, tensors, strict=True):
                factor = at(t, letters, place)
                term = factor if term is None else term * factor
            terms.append(term)
        return sum(terms[1:], terms[0])

    def nested(left: str, where: dict):
        return [nested(left[1:], where | {left[0]: n}) for n in range(sizes[left[0]])] if left else total(where)

    return nested(out, {})


def newton_n(f, jacobian, start: list, steps: int) -> list:
    """Newton's method for n equations: f(x) gives n columns from n, jacobian(x) their derivatives by rows."""
    n = len(start)

    def turn(s: Column, _: Column) -> Column:
        def moved(x: Column) -> Column:
            here = [x[k] for k in range(n)]
            values = F.array(*f(here), *[c for row in inverse(jacobian(here)) for c in row])
            return let(values, lambda v: F.array(*[here[r] - sum((v[n + n * r + c] * v[c] for c in range(n)), F.lit(0.0)) for r in range(n)]))

        return let(s, moved)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*[x.cast("double") for x in start]), turn)
    return [out[k] for k in range(n)]
