"""Between levels of refinement: restriction, prolongation, refluxing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeql.functions.weights import mirrored, whole
from latticeql.operators.grid import AXES
from latticeql.operators.lines import prolongate_along


def restrict(df: DataFrame, value: str, centring: str = "ccc") -> DataFrame:
    """Fine to coarse: along cell axes (c) pairs are averaged, along vertex axes (v) even points are taken. Coarse points that don't
    have all of their 1, 2, 4 or 8 fine ones are left out."""
    for a, c in zip(AXES, centring, strict=True):
        if c == "v":
            df = df.filter(F.col(a) % 2 == 0)
    out = df.groupBy(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]).agg(F.avg(value).alias(value), F.count("*").alias("n_"))
    return out.filter(F.col("n_") == 2 ** centring.count("c")).drop("n_")


def prolongate(df: DataFrame, value: Column, left: dict, right: dict, name: str = "value") -> DataFrame:
    """Coarse to fine: each fine point 2 * i + off is the weighted sum of a row for its child, left or right, along each axis.
    Coarse points scatter to the fine ones; those with a whole stencil stay."""
    return prolongate_axes(df, value, [(left, right)] * 3, name)


def prolongate_axes(df: DataFrame, value: Column, rows: list, name: str = "value") -> DataFrame:
    """As prolongate, with a pair of rows for each axis: mixed centrings. The axes are done in turn, so that a point is sent as
    often as the rows' lengths add up to, not multiply to."""
    out = df.select(*AXES, value.alias(name))
    for axis, (left, right) in zip(AXES, rows, strict=True):
        out = prolongate_along(out, name, axis, left, right)
    return out


def children(row: dict) -> tuple[dict, dict]:
    """(left, right) rows of a cell-centred operator from its left one."""
    return row, mirrored(row)


def minmod(df: DataFrame, value: str, axis: str) -> DataFrame:
    """Slope-limited conservative prolongation along an axis."""
    w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    v = F.col(value)
    both = df.select("*", (v - F.lag(value).over(w)).alias("a_"), (F.lead(value).over(w) - v).alias("b_")).filter("a_ is not null and b_ is not null")
    sign = lambda c: F.when(F.col(c) < 0, F.lit(-0.125)).otherwise(F.lit(0.125))
    slope = (sign("a_") + sign("b_")) * F.least(F.abs("a_"), F.abs("b_"))
    out = both.withColumn("d_", slope).withColumn("o_", F.explode(F.array(F.lit(0), F.lit(1))))
    fine = (2 * F.col(axis) + F.col("o_")).cast("int")
    return out.select(*[fine.alias(a) if a == axis else F.col(a) for a in AXES], (v + F.when(F.col("o_") == 0, -F.col("d_")).otherwise(F.col("d_"))).alias("value"))


def eno(df: DataFrame, value: str, axis: str, rows: dict) -> DataFrame:
    """Essentially non-oscillatory prolongation of order 2 along an axis: of the stencils that begin 2, 1 or 0 cells to the
    left (rows: by first cell, the left child's weights) the one with the smallest second difference."""
    w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    near = df.select("*", *[F.lead(value, o).over(w).alias(f"n{o + 2}") for o in range(-2, 3)]).filter("n0 is not null and n4 is not null")
    n = lambda o: F.col(f"n{o + 2}")
    rough = {f: F.abs(n(f) - 2 * n(f + 1) + n(f + 2)) for f in rows}
    # Ties prefer the centred stencil, then the left one.
    order = sorted(rows, key=lambda f: (abs(f + 1), f))

    def child(mirror: bool) -> Column:
        def total(first: int) -> Column:
            row = mirrored(rows[-first - 2]) if mirror else rows[first]
            weights, den = whole(row)
            return sum((F.lit(float(x)) * n(o) for o, x in sorted(weights.items())), F.lit(0.0)) / F.lit(float(den))

        out = total(order[-1])
        for f in reversed(order[:-1]):
            others = [rough[g] for g in order if g != f]
            out = F.when(rough[f] <= F.least(*others), total(f)).otherwise(out)
        return out

    both = near.withColumn("o_", F.explode(F.array(F.lit(0), F.lit(1))))
    fine = (2 * F.col(axis) + F.col("o_")).cast("int")
    return both.select(*[fine.alias(a) if a == axis else F.col(a) for a in AXES], F.when(F.col("o_") == 0, child(False)).otherwise(child(True)).alias("value"))


def reflux(coarse: DataFrame, fine: DataFrame, axis: str) -> DataFrame:
    """Corrections of coarse faces normal to an axis: the mean of the four fine fluxes less the coarse flux."""
    rest = [a for a in AXES if a != axis]
    faces = fine.filter(F.col(axis) % 2 == 0).groupBy(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]).agg((F.sum("flux") / F.lit(4.0)).alias("fine"), F.count("*").alias("n"))
    return coarse.join(faces.filter("n = 4"), [axis, *rest]).select(*AXES, (F.col("fine") - F.col("flux")).alias("correction"))


def new_level(coarse: DataFrame, blocks: DataFrame, value: str, left: dict, right: dict, block: int) -> DataFrame:
    """A fine level on blocks (bi, bj, bk, of block fine cells an edge) from the coarse one alone."""
    fine = prolongate(coarse, F.col(value), left, right, value)
    return fine.join(blocks, [F.floor(fine[a] / block) == blocks[f"b{a}"] for a in AXES], "left_semi")


def remake_level(old: DataFrame, coarse: DataFrame, blocks: DataFrame, value: str, left: dict, right: dict, block: int) -> DataFrame:
    """A level on other blocks: what the old one has is copied, and the rest comes from the coarse one."""
    new = new_level(coarse, blocks, value, left, right, block)
    kept = old.select(*AXES, value).join(blocks, [F.floor(old[a] / block) == blocks[f"b{a}"] for a in AXES], "left_semi")
    return kept.unionByName(new.join(kept.select(*AXES), list(AXES), "left_anti"))


def clear_level(levels: DataFrame, level: int) -> DataFrame:
    """Without a level and those above it."""
    return levels.filter(F.col("level") < level)


def refluxed(cells: DataFrame, covered: DataFrame, coarse_flux: DataFrame, fine_flux: DataFrame, axis: str, factor: float, value: str) -> DataFrame:
    """The coarse cells with those beside the fine level corrected: at each face between a covered cell and one that isn't, the mean of
    the fine fluxes less the coarse flux, times the factor, goes into the cell that isn't covered: added behind its lower face,
    taken off before its upper one. Faces are numbered as the cell above them; covered: i, j, k of the covered cells."""
    rest = [a for a in AXES if a != axis]
    side = covered.select(*rest, F.explode(F.array(F.struct(F.col(axis).alias("face"), F.lit(-1).alias("s")), F.struct((F.col(axis) + 1).alias("face"), F.lit(1).alias("s")))).alias("e"))
    edges = side.groupBy(*rest, F.col("e.face").alias(axis)).agg(F.count("*").alias("n"), F.sum("e.s").alias("s")).filter("n = 1")
    change = reflux(coarse_flux, fine_flux, axis).join(edges, list(AXES))
    # Above a covered cell (s = 1) the cell behind the face is the open one, below it the cell before.
    target = F.when(F.col("s") > 0, F.col(axis)).otherwise(F.col(axis) - 1)
    per_cell = change.select(*rest, target.cast("int").alias(axis), (F.col("s") * F.col("correction") * F.lit(float(factor))).alias("d_")).groupBy(*AXES).agg(F.sum("d_").alias("d_"))
    out = cells.join(per_cell, list(AXES), "left")
    return out.select(*[(F.col(c) + F.coalesce("d_", F.lit(0.0))).alias(c) if c == value else F.col(c) for c in cells.columns])
