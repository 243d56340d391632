"""Interpolation of grid functions at points: the stencil's anchor is computed, so the join is by equality of indices."""

from __future__ import annotations

from fractions import Fraction
from itertools import product as cartesian

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeql.functions.weights import solve
from latticeql.operators.grid import AXES


def basis(order: int, derivative: int) -> list:
    """For each stencil point 0..order the coefficients, by power, of its Lagrange polynomial's derivative in the offset from the
    anchor."""
    n = order + 1
    columns = [solve([[Fraction(p) ** m for m in range(n)] for p in range(n)], [int(p == q) for p in range(n)]) for q in range(n)]
    for _ in range(derivative):
        columns = [[m * c for m, c in enumerate(col)][1:] or [Fraction(0)] for col in columns]
    return columns


def interpolate(points: DataFrame, grid: DataFrame, value: str, n: int, order: int, derivatives: tuple = (0, 0, 0), lower: float = 0.0, h: float | None = None, cell: bool = True, key: str = "id") -> DataFrame:
    """key and the interpolated value (or a derivative of it) at points (key, x, y, z) from grid values; points whose stencil
    leaves the grid are left out. The anchor is the index next to q - order / 2, ties to even."""
    h = 1.0 / n if h is None else h
    q = [(F.col(c) - F.lit(lower)) / F.lit(h) - F.lit(0.5 if cell else 0.0) for c in "xyz"]
    at = points.select(key, *[x.alias(f"q{a}") for a, x in zip(AXES, q, strict=True)])
    at = at.select(key, *[F.col(f"q{a}") for a in AXES], *[F.rint(F.col(f"q{a}") - F.lit(order / 2)).cast("int").alias(f"a{a}") for a in AXES])
    inside = [F.col(f"a{a}").between(0, n - 1 - order) for a in AXES]
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in cartesian(range(order + 1), repeat=3)])
    spread = at.filter(inside[0] & inside[1] & inside[2]).withColumn("m", F.explode(moves))

    def weight(a: str, d: int) -> Column:
        x = F.col(f"q{a}") - F.col(f"a{a}")
        out = F.lit(0.0)
        for p, coefficients in enumerate(basis(order, d)):
            poly = F.lit(0.0)
            for c in reversed(coefficients):
                poly = poly * x + F.lit(float(c))
            out = F.when(F.col(f"m.d{a}") == p, poly).otherwise(out)
        return out * F.lit(h**-d)

    w = weight("i", derivatives[0]) * weight("j", derivatives[1]) * weight("k", derivatives[2])
    spread = spread.select(key, w.alias("w_"), *[(F.col(f"a{a}") + F.col(f"m.d{a}")).alias(a) for a in AXES])
    return spread.join(grid.select(*AXES, F.col(value).alias("v_")), list(AXES)).groupBy(key).agg(F.sum(F.col("w_") * F.col("v_")).alias("value"))
