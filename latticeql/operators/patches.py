"""Between boxes, levels and patches: ghost rows, the finest cell at a point, and interpolation across patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.operators.grid import AXES
from latticeql.operators.interp import interpolate


def with_ghosts(df: DataFrame, n: int, block: int, ghosts: int) -> DataFrame:
    """The rows of each block of a grid with those of its halo: block's keys bi, bj, bk, then the columns and isghost. A row
    is sent to the blocks whose halo it lies in, without a shuffle. ghosts: at most block."""
    if not 0 <= ghosts <= block:
        raise ValueError("a halo reaches the next block only")
    out = df
    for a in AXES:
        near = F.array_distinct(F.array(*[F.floor((F.col(a) + F.lit(d)) / block).cast("int") for d in (-ghosts, 0, ghosts)]))
        out = out.withColumn(f"b{a}", F.explode(F.filter(near, lambda b: b.between(0, (n - 1) // block))))
    away = [F.col(f"b{a}") != F.floor(F.col(a) / block) for a in AXES]
    return out.select(*[f"b{a}" for a in AXES], *df.columns, (away[0] | away[1] | away[2]).alias("isghost"))


def locate(points: DataFrame, cells: DataFrame, sizes: list, key: str = "id") -> DataFrame:
    """key, level, i, j, k of the finest cell that holds each point (x, y, z of the unit cube). cells: level, i, j, k; sizes: points
    along an axis by level. Indices are computed, so the join is by equality."""
    levels = F.array(*[F.struct(F.lit(l).alias("level"), *[F.floor(F.col(c) * n).cast("int").alias(a) for a, c in zip(AXES, "xyz", strict=True)]) for l, n in enumerate(sizes)])
    asked = points.select(key, F.explode(levels).alias("at")).select(key, "at.*")
    found = asked.join(cells.select("level", *AXES), ["level", *AXES], "left_semi")
    return found.groupBy(key).agg(F.max(F.struct("level", *AXES)).alias("at")).select(key, "at.*")


def across(ghosts: DataFrame, other: DataFrame, value: str, n: int, mapping: dict, order: int = 1, key: str = "id") -> DataFrame:
    """Values of a patch's ghost points from another patch. mapping: for x, y, z of the other patch's unit cube a column over the
    ghosts."""
    places = ghosts.select(key, *[mapping[c].alias(c) for c in "xyz"])
    return interpolate(places, other, value, n, order, key=key)
