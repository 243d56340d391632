"""Grids: points, regions, masks, halos, boundary conditions and slices. A grid is a DataFrame with the integer keys i, j, k
and value columns; n is the number of points along each axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


def points(spark: SparkSession, n: int) -> DataFrame:
    """All points of an n^3 grid, from one range by division and remainder: no join, any number of partitions."""
    r = F.col("id")
    return spark.range(n**3).select((r % n).cast("int").alias("i"), (F.floor(r / n) % n).cast("int").alias("j"), F.floor(r / (n * n)).cast("int").alias("k"))


def coordinates(df: DataFrame, n: int, lower: float = 0.0, upper: float = 1.0, cell: bool = True) -> DataFrame:
    """x, y, z of cell centres or vertices and the volume of a cell."""
    h = (upper - lower) / n
    at = [(F.lit(lower) + (F.col(a) + F.lit(0.5 if cell else 0.0)) * F.lit(h)).alias(c) for a, c in zip(AXES, "xyz", strict=True)]
    return df.select("*", *at, F.lit(h**3).alias("cvol"))


def region(n: int, layers: int = 1) -> Column:
    """'bnd' within some layers of the domain's faces, else 'int'."""
    inside = [F.col(a).between(layers, n - 1 - layers) for a in AXES]
    return F.when(inside[0] & inside[1] & inside[2], "int").otherwise("bnd")


def normal(axis: str, n: int, layers: int = 1) -> Column:
    """The outward normal along an axis: -1, 0 or 1."""
    return F.when(F.col(axis) < layers, -1).when(F.col(axis) > n - 1 - layers, 1).otherwise(0)


def nearest_interior(axis: str, n: int, layers: int = 1) -> Column:
    return F.greatest(F.lit(layers), F.least(F.col(axis), F.lit(n - 1 - layers)))


def outermost_interior(n: int, layers: int = 1) -> Column:
    """The layer of interior points that touches the boundary."""
    edge = [F.col(a).isin(layers, n - 1 - layers) for a in AXES]
    return (region(n, layers) == "int") & (edge[0] | edge[1] | edge[2])


def in_box(lo: tuple, hi: tuple) -> Column:
    tests = [F.col(a).between(x, y) for a, x, y in zip(AXES, lo, hi, strict=True)]
    return tests[0] & tests[1] & tests[2]


def in_sphere(radius: float) -> Column:
    return F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 <= F.lit(radius**2)


def vertex_weight(n: int) -> Column:
    """Of a vertex, half for each face of the domain it lies on."""
    parts = [F.when(F.col(a).isin(0, n - 1), F.lit(0.5)).otherwise(F.lit(1.0)) for a in AXES]
    return parts[0] * parts[1] * parts[2]


def covered_by(coarse: DataFrame, fine: DataFrame, covered: bool = True) -> DataFrame:
    """Coarse cells that a finer level covers, or those it doesn't: a semi or anti join on halved indices."""
    blocks = fine.select(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]).distinct()
    return coarse.join(blocks, list(AXES), "left_semi" if covered else "left_anti")


def shifted(df: DataFrame, value: str, offsets: dict, n: int | None = None) -> DataFrame:
    """The grid with a column for each (name, (di, dj, dk)): the value of that neighbour, by equality of shifted keys;
    periodic if n is given. One shuffle of the grid, and one of what is scattered, with a map-side combine."""
    source = df.select(*AXES, F.col(value).alias("v_"))
    moves = F.array(*[F.struct(F.lit(name).alias("name"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for name, o in offsets.items()])
    target = [F.col(a) - F.col(f"m.d{a}") for a in AXES]
    target = [(F.pmod(t, F.lit(n)) if n else t).cast("int").alias(a) for t, a in zip(target, AXES, strict=True)]
    sent = source.withColumn("m", F.explode(moves)).select(*target, F.col("m.name").alias("name"), "v_")
    near = sent.groupBy(*AXES).agg(*[F.max(F.when(F.col("name") == x, F.col("v_"))).alias(x) for x in offsets])
    return df.join(near, list(AXES), "left")


def shifted_several(df: DataFrame, wanted: dict, n: int | None = None) -> DataFrame:
    """The grid with a column for each (name, (value, (di, dj, dk))): that neighbour's value, from one shuffle of what is scattered, the
    points themselves among it; periodic if n is given."""
    centre = (0,) * len(AXES)
    offsets = sorted({o for _, o in wanted.values()} | {centre})
    moves = F.array(*[F.struct(F.lit(x).alias("x"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for x, o in enumerate(offsets)])
    target = [F.col(a) - F.col(f"m.d{a}") for a in AXES]
    target = [(F.pmod(t, F.lit(n)) if n else t).cast("int").alias(a) for t, a in zip(target, AXES, strict=True)]
    rest = [c for c in df.columns if c not in AXES]
    sent = df.withColumn("m", F.explode(moves)).select(*target, F.col("m.x").alias("x_"), *rest)
    own = F.col("x_") == offsets.index(centre)
    near = [F.max(F.when(F.col("x_") == offsets.index(o), F.col(v))).alias(name) for name, (v, o) in wanted.items()]
    return sent.groupBy(*AXES).agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in rest], *near, F.max(own).alias("own_")).filter("own_").drop("own_")


KINDS = {"none", "dirichlet", "neumann", "linear", "robin", "reflection", "periodic"}


def faces(default: str = "none", **kinds: str) -> dict:
    """The kind of boundary at each face of the domain: a default, and others by face (i_lower, i_upper, j_lower and so on). The same
    face can't have two, so that a symmetry there excludes any other condition."""
    names = [f"{a}_{side}" for a in AXES for side in ("lower", "upper")]
    out = dict.fromkeys(names, default) | kinds
    if unknown := set(out) - set(names) | set(out.values()) - KINDS:
        raise ValueError(f"unknown faces or kinds: {', '.join(sorted(unknown))}")
    for a in AXES:
        if (out[f"{a}_lower"] == "periodic") != (out[f"{a}_upper"] == "periodic"):
            raise ValueError("a periodic axis is periodic at both faces")
    return out


def outer_valid(kinds: dict) -> bool:
    """Whether a synchronisation leaves the whole outer boundary valid: if each face has a symmetry or a condition."""
    return all(k != "none" for k in kinds.values())


def bounded(df: DataFrame, value: str, n: int, layers: int, kinds: dict, constant: float = 0.0, limit: float = 0.0, parity: tuple = (1, 1, 1), centring: str = "ccc", lower: float = 0.0, h: float = 1.0) -> DataFrame:
    """The grid with its boundary layers filled from the interior, by the kinds of faces(). At edges and corners each axis has
    its face's kind: dirichlet (constant) wins; else the value at the source, which each axis sets, with 1/r fall-off to the limit once
    for each robin axis, the slope along the linear axes, and the parities of the reflecting ones. Only boundary points are
    joined, with a shell of points as thick as sources reach."""
    side = {a: normal(a, n, layers) for a in AXES}

    def at(a: str, low, high, inside) -> Column:
        return F.when(side[a] < 0, low).when(side[a] > 0, high).otherwise(inside)

    def has(a: str, *kind: str) -> Column:
        return at(a, F.lit(kinds[f"{a}_lower"] in kind), F.lit(kinds[f"{a}_upper"] in kind), F.lit(False))

    def source(a: str, upper: bool) -> Column:
        kind, c, shift = kinds[f"{a}_{'upper' if upper else 'lower'}"], F.col(a), 1 if centring[AXES.index(a)] == "c" else 0
        if kind in ("neumann", "linear", "robin"):
            return F.lit(n - 1 - layers if upper else layers)
        if kind == "reflection":
            return 2 * (n - 1 - layers) + shift - c if upper else 2 * layers - shift - c
        if kind == "periodic":
            return c - (n - 2 * layers) if upper else c + (n - 2 * layers)
        return c

    touched = has(AXES[0], *(KINDS - {"none"}))
    for a in AXES[1:]:
        touched = touched | has(a, *(KINDS - {"none"}))
    shell = df.filter(~touched & (region(n, 3 * layers + 1) == "bnd")).select(*[F.col(a).alias(f"s{a}") for a in AXES], F.col(value).alias("v_"))
    out = df.filter(touched).select("*", *[at(a, source(a, False), source(a, True), F.col(a)).cast("int").alias(f"s{a}") for a in AXES])
    out = out.join(shell, [f"s{a}" for a in AXES], "left")
    flag = lambda *kind: {a: F.when(has(a, *kind), 1).otherwise(0) for a in AXES}
    new = F.col("v_")
    if "robin" in kinds.values():
        offset = {a: F.lit(0.5 if c == "c" else 0.0) for a, c in zip(AXES, centring, strict=True)}
        r = lambda p: F.sqrt(sum((F.pow(F.lit(lower) + (F.col(f"{p}{a}") + offset[a]) * F.lit(h), F.lit(2.0)) for a in AXES), F.lit(0.0)))
        times = sum(flag("robin").values(), F.lit(0))
        new = F.lit(float(limit)) + F.pow(r("s") / r(""), times) * (new - F.lit(float(limit)))
    if "linear" in kinds.values():
        second = shell.select(*[F.col(f"s{a}").alias(f"t{a}") for a in AXES], F.col("v_").alias("w_"))
        linear = flag("linear")
        out = out.select("*", *[(F.col(f"s{a}") - linear[a] * side[a]).cast("int").alias(f"t{a}") for a in AXES]).join(second, [f"t{a}" for a in AXES], "left")
        far = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in AXES), F.lit(0))
        axes = sum(linear.values(), F.lit(0))
        new = F.when(axes > 0, new + F.sqrt(far / F.greatest(axes, F.lit(1))) * (new - F.col("w_"))).otherwise(new)
    for a, sign in zip(AXES, parity, strict=True):
        if sign < 0:
            new = F.when(has(a, "reflection"), -new).otherwise(new)
    given = flag("dirichlet")
    new = F.when(sum(given.values(), F.lit(0)) > 0, F.lit(float(constant))).otherwise(new)
    done = out.select(*[new.alias(c) if c == value else F.col(c) for c in df.columns])
    return df.filter(~touched).select(df.columns).unionByName(done)


def filled(df: DataFrame, value: str, n: int, layers: int, kind: str, constant: float = 0.0, parity: int = 1) -> DataFrame:
    """The same kind at all faces, with one parity for all axes."""
    return bounded(df, value, n, layers, faces(kind), constant, constant, (parity,) * 3)


def loop(df: DataFrame, where: str, n: int, layers: int = 1, ghost: str | None = None) -> DataFrame:
    """The points of a part of the grid: everywhere, interior, boundary or ghosts (rows that the column ghost marks)."""
    if where == "everywhere":
        return df
    if where == "ghosts":
        return df.filter(F.col(ghost)) if ghost else df.limit(0)
    if where not in ("interior", "boundary"):
        raise ValueError(f"unknown part of a grid: {where}")
    return df.filter(region(n, layers) == ("int" if where == "interior" else "bnd"))


def active(df: DataFrame, levels: tuple, patches: tuple | None = None) -> DataFrame:
    """The rows of a window of levels, and of patches: the first to the last but one."""
    out = df.filter((F.col("level") >= levels[0]) & (F.col("level") < levels[1]))
    return out if patches is None else out.filter((F.col("patch") >= patches[0]) & (F.col("patch") < patches[1]))


def octant_weight(cells: DataFrame) -> DataFrame:
    """i, j, k (vertices) and weight: an eighth for each of the cells (i, j, k) around a vertex. Of cells that lie in the domain and
    that no finer level covers, it is a vertex's share of the volume. One aggregation, combined before the shuffle."""
    corners = F.array(*[F.struct(*[F.lit(o >> n & 1).alias(f"d{a}") for n, a in enumerate(AXES)]) for o in range(8)])
    sent = cells.select(*AXES, F.explode(corners).alias("o")).select(*[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES])
    return sent.groupBy(*AXES).agg((F.count("*") / F.lit(8.0)).alias("weight"))


def buffer(coarse: DataFrame, fine: DataFrame, width: int) -> DataFrame:
    """The coarse cells that a prolongation to the fine cells reads: those that hold one, and as many around as the stencil is wide.
    An equality join on computed keys."""
    reach = F.array(*map(F.lit, range(-width, width + 1)))
    blocks = fine.select(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]).distinct()
    for a in AXES:
        blocks = blocks.withColumn("o", F.explode(reach)).select(*[(F.col(a) + F.col("o")).alias(b) if b == a else F.col(b) for b in AXES]).distinct()
    return coarse.join(blocks, list(AXES), "left_semi")


def point_type(n: int, layers: int, covered: Column | None = None) -> Column:
    """int, bdry, or rest for points whose values a finer level gives."""
    kind = F.when(region(n, layers) == "bnd", "bdry").otherwise("int")
    return kind if covered is None else F.when(covered, "rest").otherwise(kind)


def line(df: DataFrame, axis: str, at: int | dict) -> DataFrame:
    """The points on a line along an axis through an index of the other two, or one for each by name."""
    rest = [a for a in AXES if a != axis]
    where = at if isinstance(at, dict) else dict.fromkeys(rest, at)
    return df.filter((F.col(rest[0]) == where[rest[0]]) & (F.col(rest[1]) == where[rest[1]]))


def nearest_index(coordinate: float, lower: float, h: float) -> int:
    """Ties to even."""
    return round((coordinate - lower) / h)


def refined_blocks(df: DataFrame, error: str, threshold: float, block: int) -> DataFrame:
    """Blocks that hold a point of at least the threshold: regridding at the granularity of blocks."""
    keys = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in AXES]
    return df.filter(F.col(error) >= threshold).select(*keys).distinct()


def boxes(df: DataFrame, error: str, threshold: float, block: int, most: int) -> DataFrame:
    """Boxes of a finer level: blocks that hold a tagged point, joined along i to boxes of at most so many blocks; lo and hi are their
    first and last points, tagged and efficiency what of them asked for it."""
    from pyspark.sql import Window

    keys = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in AXES]
    tags = df.filter(F.col(error) >= threshold).groupBy(*keys).agg(F.count("*").alias("tagged"))
    row = Window.partitionBy("bj", "bk").orderBy("bi")
    # Blocks of one run have the same difference of place and number.
    run = tags.withColumn("run", F.col("bi") - F.row_number().over(row))
    first = F.min("bi").over(Window.partitionBy("bj", "bk", "run"))
    cut = run.withColumn("part", F.floor((F.col("bi") - first) / most))
    out = cut.groupBy("bj", "bk", "run", "part").agg(F.min("bi").alias("first"), F.max("bi").alias("last"), F.sum("tagged").alias("tagged"))
    size = (F.col("last") - F.col("first") + 1) * block**3
    return out.select((F.col("first") * block).alias("lo_i"), ((F.col("last") + 1) * block - 1).alias("hi_i"), *[x for a in ("j", "k") for x in ((F.col(f"b{a}") * block).alias(f"lo_{a}"), ((F.col(f"b{a}") + 1) * block - 1).alias(f"hi_{a}"))], "tagged", (F.col("tagged") / size).alias("efficiency"))
