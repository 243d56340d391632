"""Linear stencils by scatter-add: each point sends its weighted value to the points whose stencil holds it, and one partial
aggregation by target adds up. One shuffle whatever the number of axes; a target counts if all of its stencil arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeql.functions.weights import whole
from latticeql.operators.grid import AXES


def along(row: dict, axis: str) -> dict:
    """A row of weights as a stencil on three axes."""
    return {tuple(o if a == axis else 0 for a in AXES): w for o, w in row.items()}


def summed(*stencils: dict) -> dict:
    out: dict = {}
    for s in stencils:
        for k, w in s.items():
            out[k] = out.get(k, 0) + w
    return {k: w for k, w in out.items() if w}


def scatter(df: DataFrame, value: Column, stencil: dict, scale: float, n: int, periodic: bool = False, name: str = "value") -> DataFrame:
    """i, j, k and scale * sum(weight * value) over each point whose whole stencil lies in the grid. Weights are whole numbers
    until the end, so sums of whole values are exact in any order."""
    weights, den = whole(stencil)
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)], F.lit(float(w)).alias("w")) for o, w in weights.items()])
    target = [F.col(a) - F.col(f"m.d{a}") for a in AXES]
    if periodic:
        target = [F.pmod(t, F.lit(n)) for t in target]
    sent = df.select(*AXES, value.alias("v_")).withColumn("m", F.explode(moves))
    sent = sent.select(*[t.cast("int").alias(a) for t, a in zip(target, AXES, strict=True)], (F.col("m.w") * F.col("v_")).alias("p_"))
    out = sent.groupBy(*AXES).agg(F.sum("p_").alias("s_"), F.count("*").alias("n_")).filter(F.col("n_") == len(weights))
    return out.select(*AXES, (F.col("s_") / F.lit(float(den)) * F.lit(float(scale))).alias(name))


def scatter_several(df: DataFrame, value: Column, stencils: dict, n: int, carry: tuple = (), periodic: bool = False) -> DataFrame:
    """i, j, k, a column for each stencil by name, (row, scale), null where it doesn't fit into the grid, and the point's own carried
    columns: all in one shuffle. A point is sent once to each place that any of the stencils reaches."""
    rows = {name: whole(row) for name, (row, _) in stencils.items()}
    centre = (0,) * len(AXES)
    offsets = sorted({o for weights, _ in rows.values() for o in weights} | {centre})
    zero = lambda o, name: F.lit(float(rows[name][0][o])) if o in rows[name][0] else F.lit(None).cast("double")
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)], *[zero(o, name).alias(f"w_{name}") for name in stencils], F.lit(o == centre).alias("own")) for o in offsets])
    target = [F.col(a) - F.col(f"m.d{a}") for a in AXES]
    target = [F.pmod(t, F.lit(n)) for t in target] if periodic else target
    sent = df.select(*AXES, value.alias("v_"), *carry).withColumn("m", F.explode(moves))
    sent = sent.select(*[t.cast("int").alias(a) for t, a in zip(target, AXES, strict=True)], *[(F.col(f"m.w_{name}") * F.col("v_")).alias(f"p_{name}") for name in stencils], *[F.when(F.col("m.own"), F.col(c)).alias(f"c_{c}") for c in carry], F.col("m.own").alias("own"))
    sums = [x for name in stencils for x in (F.sum(f"p_{name}").alias(f"s_{name}"), F.count(f"p_{name}").alias(f"n_{name}"))]
    out = sent.groupBy(*AXES).agg(*sums, *[F.max(f"c_{c}").alias(c) for c in carry], F.max("own").alias("own")).filter("own")
    done = [F.when(F.col(f"n_{name}") == len(rows[name][0]), F.col(f"s_{name}") / F.lit(float(rows[name][1])) * F.lit(float(scale))).alias(name) for name, (_, scale) in stencils.items()]
    return out.select(*AXES, *done, *carry)


def upwind(df: DataFrame, value: str, velocity: str, axis: str, up: dict, down: dict, scale: float, n: int) -> DataFrame:
    """velocity * derivative along an axis, by the stencil of the velocity's sign, from one shuffle."""
    both = scatter_several(df, F.col(value), {"up": (along(up, axis), scale), "down": (along(down, axis), scale)}, n, (velocity,))
    out = both.filter("up is not null and down is not null")
    return out.select(*AXES, (F.col(velocity) * F.when(F.col(velocity) >= 0, F.col("up")).otherwise(F.col("down"))).alias("value"))


def gradient(df: DataFrame, value: str, row: dict, scale: float, n: int) -> DataFrame:
    """The three first derivatives (d_i, d_j, d_k) at points where all exist, from one shuffle."""
    out = scatter_several(df, F.col(value), {f"d_{a}": (along(row, a), scale) for a in AXES}, n)
    return out.dropna(subset=[f"d_{a}" for a in AXES])


def hessian(df: DataFrame, value: str, first: dict, second: dict, scale: float, n: int) -> DataFrame:
    """The six second derivatives (d_ii, d_ij and so on), from one shuffle. scale: the inverse spacing, not squared."""
    stencils = {f"d_{a}{a}": (along(second, a), scale * scale) for a in AXES}
    for x, a in enumerate(AXES):
        for b in AXES[x + 1 :]:
            mixed = {tuple(p if c == a else q if c == b else 0 for c in AXES): w * v for p, w in first.items() for q, v in first.items()}
            stencils[f"d_{a}{b}"] = (mixed, scale * scale)
    return scatter_several(df, F.col(value), stencils, n).dropna(subset=list(stencils))


def neighbours(df: DataFrame, value: str, axis: str, offsets: list) -> DataFrame:
    """A column v_<offset> for each offset along an axis, by one window: for formulas that aren't linear."""
    w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    return df.select("*", *[F.lead(value, o).over(w).alias(f"v_{o}".replace("-", "m")) for o in offsets])
