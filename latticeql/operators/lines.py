"""Prolongation along one axis: high linear orders, essentially non-oscillatory stencils, and a linear fallback. Three of them in
turn, one for each axis, make a tensor product at the cost of three rows of weights rather than their product."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeql.functions.weights import average_left, mirrored, whole
from latticeql.operators.grid import AXES
from latticeql.operators.stencil import neighbours

#: The square root of the spacing of doubles at 1.
ROOT_EPSILON = 2.0**-26


def prolongate_along(df: DataFrame, value: str, axis: str, left: dict, right: dict) -> DataFrame:
    """i, j, k and value, with twice the points along the axis: child 0 by the row left, child 1 by the row right. A child
    counts if all of its stencil arrived. One shuffle, added up before it."""
    rows = [whole(row) for row in (left, right)]
    moves = [F.struct(F.lit(off - 2 * k).alias("d"), F.lit(float(w)).alias("w")) for off, (row, _) in enumerate(rows) for k, w in row.items()]
    sent = df.select(*AXES, F.col(value).alias("v_"), F.explode(F.array(*moves)).alias("m"))
    target = (2 * F.col(axis) + F.col("m.d")).cast("int")
    out = sent.select(*[target.alias(a) if a == axis else F.col(a) for a in AXES], (F.col("m.w") * F.col("v_")).alias("p_")).groupBy(*AXES).agg(F.sum("p_").alias("s_"), F.count("*").alias("n_"))
    first = F.pmod(F.col(axis), F.lit(2)) == 0
    pick = lambda a, b: F.when(first, F.lit(a)).otherwise(F.lit(b))
    return out.filter(F.col("n_") == pick(*[len(row) for row, _ in rows])).select(*AXES, (F.col("s_") / pick(*[float(den) for _, den in rows])).alias(value))


def _near(df: DataFrame, value: str, axis: str, reach: int) -> tuple[DataFrame, dict]:
    """Points that have reach neighbours on both sides, and the columns of those by offset."""
    names = {o: f"v_{o}".replace("-", "m") for o in range(-reach, reach + 1)}
    near = neighbours(df.select(*AXES, F.col(value).alias("u_")), "u_", axis, list(names))
    return near.filter(F.col(names[-reach]).isNotNull() & F.col(names[reach]).isNotNull()), {o: F.col(n) for o, n in names.items()}


def _total(row: dict, at: dict) -> Column:
    weights, den = whole(row)
    return sum((F.lit(float(w)) * at[o] for o, w in sorted(weights.items())), F.lit(0.0)) / F.lit(float(den))


def _children(df: DataFrame, axis: str, left: Column, right: Column, name: str) -> DataFrame:
    both = df.select(*AXES, F.posexplode(F.array(left, right)).alias("o_", name))
    return both.select(*[(2 * F.col(axis) + F.col("o_")).cast("int").alias(a) if a == axis else F.col(a) for a in AXES], name)


def eno_along(df: DataFrame, value: str, axis: str, order: int) -> DataFrame:
    """Conservative prolongation of an even order by the smoothest of the order + 1 stencils that hold the cell: the one with the
    least undivided difference, where a shift off the centre counts a little against it. Ties go to the smaller shift."""
    near, at = _near(df, value, axis, order)
    candidates = []
    for first in range(-order, 1):
        shift = first + order // 2
        rough = F.abs(sum((F.lit(float((-1) ** (order - m) * comb(order, m))) * at[first + m] for m in range(order + 1)), F.lit(0.0)))
        left, right = average_left(order, first), mirrored(average_left(order, -first - order))
        candidates.append(F.struct((rough * F.lit(1 + ROOT_EPSILON * abs(shift))).alias("rough"), F.lit(abs(shift)).alias("far"), F.lit(shift).alias("shift"), _total(left, at).alias("left"), _total(right, at).alias("right")))
    best = near.select(*AXES, F.array_min(F.array(*candidates)).alias("b"))
    return _children(best, axis, F.col("b.left"), F.col("b.right"), value)


def fallback_along(df: DataFrame, value: str, axis: str, order: int) -> DataFrame:
    """Conservative prolongation of an order, or linear where the value would be a new extremum among the stencil's, or where the
    slope changes its sign within the stencil."""
    rows = [average_left(order), mirrored(average_left(order))]
    linear = [average_left(1), mirrored(average_left(1))]
    near, at = _near(df, value, axis, max(abs(o) for row in rows for o in row))

    def child(off: int) -> Column:
        places = range(min(rows[off]), max(rows[off]) + 1)
        stencil, high = F.array(*[at[o] for o in places]), _total(rows[off], at)
        slopes = F.array(*[at[o + 1] - at[o] for o in places[:-1]])
        bent = (F.array_min(slopes) < 0) & (F.array_max(slopes) > 0)
        return F.when((high < F.array_min(stencil)) | (high > F.array_max(stencil)) | bent, _total(linear[off], at)).otherwise(high)

    return _children(near, axis, child(0), child(1), value)
