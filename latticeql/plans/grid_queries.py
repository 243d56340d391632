"""Queries of the grid operators over the grid views, each with SQL of its own making for DuckDB."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from latticeql.functions import scalar as S
from latticeql.functions import weights as W
from latticeql.operators import agg, grid, interp, ode, quality, resample, sparse, stencil
from latticeql.operators.grid import AXES
from latticeql.plans.views import HOURS_SQL, cube, cube_sql, hours, particles
from latticeql.sources import tsv

QUERIES: dict = {}
SQL: dict = {}
N, H = 16, 1 / 16
U = F.col


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def region_sql(n: int = N, layers: int = 1) -> str:
    return " and ".join(f"{a} between {layers} and {n - 1 - layers}" for a in AXES)


def stencil_sql(table: str, value: str, rows: dict, scale: float, name: str = "value") -> str:
    weights, den = W.whole(rows)
    values = ", ".join(f"({', '.join(map(str, o))}, {w}e0)" for o, w in weights.items())
    return f"""w(di, dj, dk, w) as (values {values}),
s as (select c.i, c.j, c.k, sum(w.w * o.{value}) as s, count(*) as n from {table} c, w join {table} o on o.i = c.i + w.di and o.j = c.j + w.dj and o.k = c.k + w.dk group by c.i, c.j, c.k)
select i, j, k, s / {den}e0 * {scale!r} as {name} from s where n = {len(weights)}"""


def linear(name: str, rows: dict, scale: float, known: dict | None = None) -> None:
    """known: the same row as published, for the SQL, so that a wrong row of the operator's shows."""
    add(name, lambda s, d: stencil.scatter(cube(s, d), U("u"), rows, scale, N), f"with {cube_sql()}, {stencil_sql('c', 'u', known or rows, scale)}")


# Published finite-difference rows by order of accuracy, as denominator, first offset and whole numbers: first and second
# derivatives, the first derivative leaning forward, and Kreiss-Oliger dissipation.
FIRST = {2: (2, -1, [-1, 0, 1]), 4: (12, -2, [1, -8, 0, 8, -1]), 6: (60, -3, [-1, 9, -45, 0, 45, -9, 1]), 8: (840, -4, [3, -32, 168, -672, 0, 672, -168, 32, -3])}
SECOND = {2: (1, -1, [1, -2, 1]), 4: (12, -2, [-1, 16, -30, 16, -1]), 6: (180, -3, [2, -27, 270, -490, 270, -27, 2]), 8: (5040, -4, [-9, 128, -1008, 8064, -14350, 8064, -1008, 128, -9])}
FORWARD = {2: (2, 0, [-3, 4, -1]), 4: (12, -1, [-3, -10, 18, -6, 1]), 6: (60, -2, [2, -24, -35, 80, -30, 8, -1]), 8: (840, -3, [-5, 60, -420, -378, 1050, -420, 140, -30, 3])}
DISSIPATION = {2: (16, -2, [-1, 4, -6, 4, -1]), 4: (64, -3, [1, -6, 15, -20, 15, -6, 1]), 6: (256, -4, [-1, 8, -28, 56, -70, 56, -28, 8, -1]), 8: (1024, -5, [1, -10, 45, -120, 210, -252, 210, -120, 45, -10, 1])}
# Published rows of prolongation, to the middle of vertices and to a cell's left child: by point values and by averages.
PROLONG = {
    "vertex_poly": {1: (2, 0, [1, 1]), 3: (16, -1, [-1, 9, 9, -1]), 5: (256, -2, [3, -25, 150, 150, -25, 3])},
    "cell_poly": {0: (1, 0, [1]), 1: (4, -1, [1, 3]), 2: (32, -1, [5, 30, -3]), 3: (128, -2, [-5, 35, 105, -7])},
    "cell_cons": {0: (1, 0, [1]), 1: (4, -1, [1, 3]), 2: (8, -1, [1, 8, -1]), 4: (128, -2, [-3, 22, 128, -22, 3])},
}


def published(row: tuple) -> dict:
    den, first, numbers = row
    return {first + k: Fraction(w, den) for k, w in enumerate(numbers) if w}


# -- aggregates ---------------------------------------------------------------------------------------------------------

NORMS = "{v}_min, {v}_max, {v}_sum, {v}_avg, {v}_stddev, {v}_l1norm, {v}_l2norm, {v}_maxabs"


def norms_sql(source: str, values: list, weight: str, keys: str = "") -> str:
    parts = [f"min({v}) as {v}_min, max({v}) as {v}_max, sum({weight} * {v}) as {v}_sum, sum({weight} * {v} * {v}) as {v}_q, sum({weight} * abs({v})) as {v}_a, max(abs({v})) as {v}_maxabs" for v in values]
    out = [f"{v}_min, {v}_max, {v}_sum, {v}_sum / volume as {v}_avg, sqrt(greatest(0e0, {v}_q / volume - ({v}_sum / volume) * ({v}_sum / volume))) as {v}_stddev, {v}_a / volume as {v}_l1norm, sqrt({v}_q / volume) as {v}_l2norm, {v}_maxabs" for v in values]
    by = f"group by {keys}" if keys else ""
    return f"m as (select {keys + ',' if keys else ''} sum({weight}) as volume, {', '.join(parts)} from {source} {by}) select {keys + ',' if keys else ''} volume, {', '.join(out)} from m"


add("norms_cube", lambda s, d: agg.norms(cube(s, d), ["u"], F.lit(H**3)), f"with {cube_sql()}, {norms_sql('c', ['u'], f'{H**3!r}')}")
add("norms_wide_multi_var", lambda s, d: agg.norms(cube(s, d), ["u", "v"], F.lit(H**3)), f"with {cube_sql()}, {norms_sql('c', ['u', 'v'], f'{H**3!r}')}")
add("norms_vertex_weights", lambda s, d: agg.norms(cube(s, d), ["u"], grid.vertex_weight(N)), f"with {cube_sql()}, {norms_sql('c', ['u'], '(' + ' * '.join(f'case when {a} in (0, 15) then 0.5e0 else 1e0 end' for a in AXES) + ')')}")
add("minloc_maxloc", lambda s, d: agg.extrema(cube(s, d), "u", list(AXES)), f"""with {cube_sql()}, lo as (select * from c order by u, i, j, k limit 1), hi as (select * from c order by u desc, i, j, k limit 1)
select lo.u as min, lo.i as min_i, lo.j as min_j, lo.k as min_k, hi.u as max, hi.i as max_i, hi.j as max_j, hi.k as max_k from lo, hi""")
add("region_counts", lambda s, d: cube(s, d).groupBy(grid.region(N).alias("region")).agg(F.count("*").alias("n"), F.sum("u").alias("u")), f"with {cube_sql()} select case when {region_sql()} then 'int' else 'bnd' end as region, count(*) as n, sum(u) as u from c group by 1")


def two_levels(s, d):
    """Coarse 8^3 cells that no fine cell covers, and the fine 16^3 cells of the box 4..11."""
    fine = cube(s, d, 16).filter(grid.in_box((4, 4, 4), (11, 11, 11)))
    return grid.covered_by(cube(s, d, 8), fine, False), fine


def amr_norms(s, d):
    coarse, fine = two_levels(s, d)
    both = coarse.withColumn("w", F.lit(8.0 / 4096)).withColumn("level", F.lit(0)).unionByName(fine.withColumn("w", F.lit(1.0 / 4096)).withColumn("level", F.lit(1)))
    return agg.norms(both, ["u"], U("w"))


TWO = f"{cube_sql(8, 'b')}, {cube_sql(16, 'c')}, f as (select * from c where i between 4 and 11 and j between 4 and 11 and k between 4 and 11), x as (select b.* from b where not (i between 2 and 5 and j between 2 and 5 and k between 2 and 5))"
add("norms_amr_masked", amr_norms, f"with {TWO}, l as (select u, {8 / 4096!r} as w from x union all select u, {1 / 4096!r} from f), {norms_sql('l', ['u'], 'w')}")
add("fine_mask", lambda s, d: grid.covered_by(cube(s, d, 8), two_levels(s, d)[1]).select(*AXES, "u"), f"with {cube_sql(8, 'b')} select i, j, k, u from b where i between 2 and 5 and j between 2 and 5 and k between 2 and 5")
add("grid_stats", lambda s, d: (lambda c, f: c.select(F.lit(0).alias("level"), *AXES).unionByName(f.select(F.lit(1).alias("level"), *AXES)).groupBy("level").agg(F.count("*").alias("cells"), F.countDistinct(*[F.floor(U(a) / 4) for a in AXES]).alias("boxes")))(*two_levels(s, d)), f"with {TWO}, l as (select 0 as level, i, j, k from x union all select 1, i, j, k from f) select level, count(*) as cells, count(distinct (i // 4, j // 4, k // 4)) as boxes from l group by level")
add("checksum_blocks", lambda s, d: agg.checksum(cube(s, d).select((F.floor(U("k") / 4)).cast("int").alias("block"), *[U(a).cast("string") for a in AXES], U("u").cast("long").cast("string").alias("u")), ["block"], [*AXES, "u"]), f"""with {cube_sql()}, t as (select (k // 4)::int as block, concat_ws('|', i, j, k, u::bigint) as t from c),
o as (select block, flatten(list_transform(string_split(t, ''), lambda c: list_concat([ord(c)::bigint], [-1::bigint for z in range(8)]))) as o from t),
q as (select block, xor(list_reduce(list_concat([4294967295::bigint], o), lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) as crc from o)
select block, count(*) as n, sum(crc)::bigint as checksum from q group by block""")
add("residual_by_plane", lambda s, d: cube(s, d).groupBy("k").agg(F.max(F.abs(U("u") - U("v"))).alias("residual")), f"with {cube_sql()} select k, max(abs(u - v)) as residual from c group by k")
add("any_by_plane", lambda s, d: cube(s, d).groupBy("i").agg(F.bool_or(U("v") > 0).alias("up"), F.bool_and(U("u") > 0).alias("filled")), f"with {cube_sql()} select i, bool_or(v > 0) as up, bool_and(u > 0) as filled from c group by i")


def patches_of(s, d):
    """A patch for each region: its extent is 2 along each axis, and its cells are counted by its nations."""
    k = U("n_nationkey")
    cells = s.read.parquet(f"{d}/nation.parquet").groupBy(U("n_regionkey").alias("patch")).agg((F.min(k) + 8).alias("ci"), (F.max(k) + 8).alias("cj"), (F.count("*") * 3).alias("ck"))
    return cells.select("patch", *[(F.lit(2.0) / U(f"c{a}")).alias(f"d{a}") for a in AXES])


add("timestep", lambda s, d: agg.timestep(patches_of(s, d), 0.5, ["di", "dj", "dk"]), "select 0.5e0 * min(least(2e0 / a, 2e0 / b, 2e0 / c)) as dt from (select n_regionkey, min(n_nationkey) + 8 as a, max(n_nationkey) + 8 as b, count(*) * 3 as c from nation group by 1)")

# -- points, regions, slices, predicates -------------------------------------------------------------------------------

for _a in AXES:
    _rest = [x for x in AXES if x != _a]
    add(f"line_slice_{'xyz'[AXES.index(_a)]}", lambda s, d, a=_a: grid.line(cube(s, d), a, grid.nearest_index(0.4, 0.0, H)).select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where {_rest[0]} = 6 and {_rest[1]} = 6")
add("region_int", lambda s, d: cube(s, d).filter(grid.region(N) == "int").select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where {region_sql()}")
add("region_bnd", lambda s, d: cube(s, d).filter(grid.region(N, 2) == "bnd").select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where not ({region_sql(layers=2)})")
add("region_outermost_int", lambda s, d: cube(s, d).filter(grid.outermost_interior(N)).select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where {region_sql()} and (i in (1, 14) or j in (1, 14) or k in (1, 14))")
add("region_faces", lambda s, d: cube(s, d).filter(sum((F.abs(grid.normal(a, N)) for a in AXES), F.lit(0)) == 1).select(*AXES, *[grid.normal(a, N).alias(f"n{a}") for a in AXES]), f"with {cube_sql()} select i, j, k, {', '.join(f'case when {a} = 0 then -1 when {a} = 15 then 1 else 0 end as n{a}' for a in AXES)} from c where {' + '.join(f'({a} in (0, 15))::int' for a in AXES)} = 1")
add("nearest_interior", lambda s, d: cube(s, d).filter(grid.region(N) == "bnd").select(*AXES, *[grid.nearest_interior(a, N).alias(f"s{a}") for a in AXES]), f"with {cube_sql()} select i, j, k, {', '.join(f'greatest(1, least({a}, 14)) as s{a}' for a in AXES)} from c where not ({region_sql()})")
add("loop_box", lambda s, d: cube(s, d).filter(grid.in_box((2, 3, 4), (9, 8, 7))).select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where i between 2 and 9 and j between 3 and 8 and k between 4 and 7")
for _c, _o in (("cell", 0.5), ("vertex", 0.0)):
    add(f"coords_{_c}", lambda s, d, c=_c: grid.coordinates(grid.points(s, 8), 8, -1.0, 1.0, c == "cell"), f"select (r % 8)::int as i, ((r // 8) % 8)::int as j, (r // 64)::int as k, -1e0 + ((r % 8) + {_o}e0) * 0.25e0 as x, -1e0 + (((r // 8) % 8) + {_o}e0) * 0.25e0 as y, -1e0 + ((r // 64) + {_o}e0) * 0.25e0 as z, 0.015625::double as cvol from range(512) t(r)")
add("sphere_tags", lambda s, d: grid.coordinates(cube(s, d), N, -1.0, 1.0).withColumn("tag", grid.in_sphere(0.5).cast("int")).groupBy("tag").agg(F.count("*").alias("n"), F.sum("u").alias("u")), f"with {cube_sql()} select (pow((i + 0.5e0) * 0.125e0 - 1, 2) + pow((j + 0.5e0) * 0.125e0 - 1, 2) + pow((k + 0.5e0) * 0.125e0 - 1, 2) <= 0.25e0)::int as tag, count(*) as n, sum(u) as u from c group by 1")


def box_in_box(s, d):
    """The level each cell wants: the number of nested cubes about the middle that hold it."""
    x = [F.abs((U(a) + F.lit(0.5)) * F.lit(0.125) - F.lit(1.0)) for a in AXES]
    level = sum((F.when(F.greatest(*x) <= F.lit(r), 1).otherwise(0) for r in (0.75, 0.5, 0.25)), F.lit(0))
    return cube(s, d).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("u").alias("u"))


add("box_in_box_tags", box_in_box, f"with {cube_sql()}, q as (select u, greatest({', '.join(f'abs(({a} + 0.5e0) * 0.125e0 - 1)' for a in AXES)}) as r from c) select ((r <= 0.75)::int + (r <= 0.5)::int + (r <= 0.25)::int) as level, count(*) as n, sum(u) as u from q group by 1")
add("regrid_blocks", lambda s, d: grid.refined_blocks(cube(s, d), "u", 30.0, 4), f"with {cube_sql()} select distinct (i // 4)::int as bi, (j // 4)::int as bj, (k // 4)::int as bk from c where u >= 30")
add("error_est_counts", lambda s, d: cube(s, d).agg(F.sum((U("u") >= 30).cast("bigint")).alias("set"), F.sum((U("u") < 30).cast("bigint")).alias("clear"), F.count("*").alias("total")), f'with {cube_sql()} select count(*) filter (u >= 30) as "set", count(*) filter (u < 30) as clear, count(*) as total from c')
add("point_histogram", lambda s, d: cube(s, d).groupBy(sum((F.abs(grid.normal(a, N)) for a in AXES), F.lit(0)).alias("faces")).count().withColumnRenamed("count", "n"), f"with {cube_sql()} select {' + '.join(f'({a} in (0, 15))::int' for a in AXES)} as faces, count(*) as n from c group by 1")


def wave(s, d):
    x = [(U("id") % 16) / F.lit(16.0), F.floor(U("id") / 16) / F.lit(16.0)]
    two_pi = F.lit(6.283185307179586)
    return s.range(256).select("id", F.round(F.cos(two_pi * x[0]) * F.cos(two_pi * x[1]), 9).alias("standing"), F.round(F.exp(-(x[0] - F.lit(0.5)) ** 2 / F.lit(0.02)), 9).alias("gaussian"))


add("wave_initial", wave, "select r as id, round(cos(6.283185307179586 * ((r % 16) / 16e0)) * cos(6.283185307179586 * ((r // 16) / 16e0)), 9) as standing, round(exp(-pow((r % 16) / 16e0 - 0.5e0, 2) / 0.02e0), 9) as gaussian from range(256) t(r)")

# -- stencils ----------------------------------------------------------------------------------------------------------

for _p in (2, 4, 6, 8):
    _first, _second = published(FIRST[_p]), published(SECOND[_p])
    linear(f"deriv1_o{_p}", stencil.along(W.centred(_p, 1), "i"), 1 / H, stencil.along(_first, "i"))
    linear(f"deriv2_o{_p}", stencil.along(W.centred(_p, 2), "j"), 1 / H**2, stencil.along(_second, "j"))
    linear(f"dissipation_o{_p}", stencil.summed(*[stencil.along(W.dissipation(_p), a) for a in AXES]), 1 / H, stencil.summed(*[stencil.along(published(DISSIPATION[_p]), a) for a in AXES]))
    linear(f"laplacian_o{_p}", stencil.summed(*[stencil.along(W.centred(_p, 2), a) for a in AXES]), 1 / H**2, stencil.summed(*[stencil.along(_second, a) for a in AXES]))
    linear(f"mixed_deriv_o{_p}", {(a, b, 0): x * y for a, x in W.centred(_p, 1).items() for b, y in W.centred(_p, 1).items()}, 1 / H**2, {(a, b, 0): x * y for a, x in _first.items() for b, y in _first.items()})

    def _upwind(s, d, p=_p):
        return stencil.upwind(cube(s, d), "u", "v", "i", W.upwind(p), W.mirrored(W.upwind(p), -1), 1 / H, N)

    def _upwind_sql(p=_p):
        one, two = (", ".join(f"({k}, {w}e0)" for k, w in W.whole(r)[0].items()) for r in (published(FORWARD[p]), W.mirrored(published(FORWARD[p]), -1)))
        den, n = W.whole(published(FORWARD[p]))[1], len(published(FORWARD[p]))
        side = lambda t, v: f"{t} as (select c.i, c.j, c.k, sum(w.w * o.u) / {den}e0 * 16.0 as d, count(*) as n from c, (values {v}) w(di, w) join c o on o.i = c.i + w.di and o.j = c.j and o.k = c.k group by all having count(*) = {n})"
        return f"with {cube_sql()}, {side('up', one)}, {side('down', two)} select c.i, c.j, c.k, c.v * case when c.v >= 0 then up.d else down.d end as value from c join up using (i, j, k) join down using (i, j, k)"

    add(f"upwind_o{_p}", _upwind, _upwind_sql())

linear("error_indicator", stencil.summed(*[stencil.along({-1: Fraction(1), 0: Fraction(-2), 1: Fraction(1)}, a) for a in AXES]), 1.0)
linear("flux_divergence", stencil.summed(*[stencil.along({0: Fraction(-1), 1: Fraction(1)}, a) for a in AXES]), 1 / H)
linear("face_average", stencil.along({-1: Fraction(1, 2), 0: Fraction(1, 2)}, "i"), 1.0)
linear("staggered_gradient", stencil.along({0: Fraction(-1), 1: Fraction(1)}, "i"), 1 / H)
linear("staggered_divergence", stencil.along({-1: Fraction(-1), 0: Fraction(1)}, "i"), 1 / H)
add("laplacian_periodic", lambda s, d: stencil.scatter(cube(s, d), U("u"), stencil.summed(*[stencil.along(W.centred(2, 2), a) for a in AXES]), 256.0, N, True), f"with {cube_sql()} select c.i, c.j, c.k, sum(w.w * o.u) * 256.0 as value from c, (values (0, 0, 0, -6e0), (1, 0, 0, 1e0), (-1, 0, 0, 1e0), (0, 1, 0, 1e0), (0, -1, 0, 1e0), (0, 0, 1, 1e0), (0, 0, -1, 1e0)) w(di, dj, dk, w) join c o on o.i = (c.i + w.di + 16) % 16 and o.j = (c.j + w.dj + 16) % 16 and o.k = (c.k + w.dk + 16) % 16 group by all")
NEAR = {f"{s}{a}": tuple((1 if s == "p" else -1) if x == a else 0 for x in AXES) for a in AXES for s in "pm"}


def energy(s, d):
    near = grid.shifted(cube(s, d), "u", NEAR).filter(" and ".join(f"{n} is not null" for n in NEAR))
    squares = sum(((U(f"p{a}") - U(f"m{a}")) * F.lit(8.0) * (U(f"p{a}") - U(f"m{a}")) * F.lit(8.0) for a in AXES), U("v") * U("v"))
    return near.select(*AXES, (squares / F.lit(2.0)).alias("energy"))


_BESIDE = ", ".join(f"{f}(u) over (partition by {', '.join(b for b in AXES if b != a)} order by {a}) as {n}{a}" for a in AXES for f, n in (("lead", "p"), ("lag", "m")))
add("energy_density", energy, f"with {cube_sql()}, q as (select *, {_BESIDE} from c) select i, j, k, (v * v + {' + '.join(f'pow((p{a} - m{a}) * 8e0, 2)' for a in AXES)}) / 2e0 as energy from q where {' and '.join(f'{n}{a} is not null' for a in AXES for n in 'pm')}")


def curl(s, d):
    """The curl of (u, v, u + v) on staggered places: forward differences, all three components, from one shuffle."""
    c = cube(s, d)
    near = grid.shifted_several(c, {f"{f}{a}": (f, tuple(int(x == a) for x in AXES)) for f, a in (("u", "j"), ("u", "k"), ("v", "i"), ("v", "k"), ("u", "i"), ("v", "j"))})
    near = near.filter("ui is not null and vj is not null and uk is not null")
    w = {a: U(f"u{a}") + U(f"v{a}") for a in ("i", "j")}
    here = U("u") + U("v")
    parts = {"curl_i": (w["j"] - here) - (U("vk") - U("v")), "curl_j": (U("uk") - U("u")) - (w["i"] - here), "curl_k": (U("vi") - U("v")) - (U("uj") - U("u"))}
    return near.select(*AXES, *[(x * F.lit(16.0)).alias(n) for n, x in parts.items()])


add("curl", curl, f"with {cube_sql()} select c.i, c.j, c.k, ((y.u + y.v - c.u - c.v) - (z.v - c.v)) * 16e0 as curl_i, ((z.u - c.u) - (x.u + x.v - c.u - c.v)) * 16e0 as curl_j, ((x.v - c.v) - (y.u - c.u)) * 16e0 as curl_k from c join c x on x.i = c.i + 1 and x.j = c.j and x.k = c.k join c y on y.i = c.i and y.j = c.j + 1 and y.k = c.k join c z on z.i = c.i and z.j = c.j and z.k = c.k + 1")


def characteristic(s, d):
    """Fluxes at faces normal to i: the mean inside; outgoing characteristics alone at the two outer faces."""
    near = grid.shifted(cube(s, d), "u", {"l": (-1, 0, 0)})
    return near.select(*AXES, F.when(U("i") == 0, (U("u") - U("v")) / F.lit(2.0)).when(U("i") == N - 1, (U("l") + U("v")) / F.lit(2.0)).otherwise((U("l") + U("u")) / F.lit(2.0)).alias("flux"))


add("characteristic_flux", characteristic, f"with {cube_sql()} select i, j, k, case when i = 0 then (u - v) / 2e0 when i = 15 then (l + v) / 2e0 else (l + u) / 2e0 end as flux from (select *, lag(u) over (partition by j, k order by i) as l from c)")
for _n in (2, 3, 4):
    def _element(s, d, n=_n):
        """Derivatives in elements of n equidistant nodes, by the nodes' Lagrange polynomial: a join on the element."""
        rows = [(p, q, float(W.derivative(list(range(n)), 1, Fraction(p)).get(q, 0) * 60)) for p in range(n) for q in range(n)]
        m = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(w).alias("w")) for p, q, w in rows])
        sent = cube(s, d, N // n * n).withColumn("m", F.explode(F.filter(m, lambda x: x["q"] == U("i") % n)))
        return sent.groupBy((F.floor(U("i") / n) * n + U("m.p")).cast("int").alias("i"), "j", "k").agg((F.sum(U("m.w") * U("u")) / F.lit(60.0)).alias("value"))

    _vals = ", ".join(f"({p}, {q}, {float(W.derivative(list(range(_n)), 1, Fraction(p)).get(q, 0) * 60)!r}::double)" for p in range(_n) for q in range(_n))
    add(f"element_derivative_n{_n}", _element, f"with {cube_sql(N // _n * _n)} select c.i, c.j, c.k, sum(w.w * o.u) / 60e0 as value from c join (values {_vals}) w(p, q, w) on w.p = c.i % {_n} join c o on o.i = (c.i // {_n}) * {_n} + w.q and o.j = c.j and o.k = c.k group by all")

# -- levels ------------------------------------------------------------------------------------------------------------

for _name, _cen in (("nodal", "vvv"), ("edge", "cvv"), ("face", "ccv"), ("cell", "ccc")):
    _even = " and ".join([f"{a} % 2 = 0" for a, c in zip(AXES, _cen, strict=True) if c == "v"] or ["true"])
    add(f"restrict_{_name}", lambda s, d, c=_cen: resample.restrict(cube(s, d), "u", c), f"with {cube_sql()} select (i // 2)::int as i, (j // 2)::int as j, (k // 2)::int as k, avg(u) as u from c where {_even} group by 1, 2, 3")


def prolong_sql(left: dict, right: dict) -> str:
    parts = []
    for off in range(8):
        o = (off >> 2 & 1, off >> 1 & 1, off & 1)
        weights, den = W.whole(W.product(*[(left, right)[x] for x in o]))
        vals = ", ".join(f"({a}, {b}, {c}, {w}e0)" for (a, b, c), w in weights.items())
        parts.append(f"select (2 * b.i + {o[0]})::int as i, (2 * b.j + {o[1]})::int as j, (2 * b.k + {o[2]})::int as k, sum(w.w * o.u) / {den}e0 as value from b, (values {vals}) w(di, dj, dk, w) join b o on o.i = b.i + w.di and o.j = b.j + w.dj and o.k = b.k + w.dk group by b.i, b.j, b.k having count(*) = {len(weights)}")
    return f"with {cube_sql(8, 'b')} " + " union all ".join(parts)


ONE = {0: Fraction(1)}
OPERATORS = {f"prolong_vertex_poly_o{p}": (ONE, W.between(p + 1)) for p in (1, 3, 5)}
OPERATORS |= {f"prolong_cell_poly_o{p}": resample.children(W.cell_left(p)) for p in (0, 1, 2, 3, 4)}
OPERATORS |= {f"prolong_cell_cons_o{p}": resample.children(W.average_left(p)) for p in (0, 1, 2, 3, 4)}
# Cubic Hermite with central slopes: the middle's weights, a fixed formula.
OPERATORS |= {"prolong_vertex_hermite_o3": (ONE, {-1: Fraction(-1, 16), 0: Fraction(9, 16), 1: Fraction(9, 16), 2: Fraction(-1, 16)}), "prolong_vertex_hermite_o1": (ONE, {0: Fraction(1, 2), 1: Fraction(1, 2)})}
for _name, (_l, _r) in OPERATORS.items():
    _row = PROLONG.get(_name[8:-3], {}).get(int(_name[-1]))
    _known = (_l, _r) if _row is None else (ONE, published(_row)) if "vertex" in _name else resample.children(published(_row))
    add(_name, lambda s, d, l=_l, r=_r: resample.prolongate(cube(s, d, 8), U("u"), l, r), prolong_sql(*_known))
# Conservative along cell axes and interpolating along vertex axes, by centring: staggered (ddf) and natural families share the rows above.
add("prolong_minmod", lambda s, d: resample.minmod(cube(s, d, 8), "u", "i"), f"""with {cube_sql(8, 'b')}, q as (select *, u - lag(u) over w as a, lead(u) over w - u as z from b window w as (partition by j, k order by i)),
m as (select i, j, k, u, (case when a < 0 then -0.125e0 else 0.125e0 end + case when z < 0 then -0.125e0 else 0.125e0 end) * least(abs(a), abs(z)) as d from q where a is not null and z is not null)
select (2 * i + o)::int as i, j, k, case when o = 0 then u - d else u + d end as value from m, (values (0), (1)) t(o)""")
ENO = {f: W.average_left(2, f) for f in (-2, -1, 0)}


def eno_sql() -> str:
    def total(first: int, mirror: bool) -> str:
        w, den = W.whole(W.mirrored(ENO[-first - 2]) if mirror else ENO[first])
        return "(" + " + ".join(f"({x}e0 * n{o + 2})" for o, x in sorted(w.items())) + f") / {den}e0"

    case = lambda m: f"case when r1 <= least(r0, r2) then {total(-1, m)} when r0 <= least(r1, r2) then {total(-2, m)} else {total(0, m)} end"
    return f"""with {cube_sql(8, 'b')}, q as (select *, {', '.join(f'lead(u, {o}) over w as n{o + 2}' if o >= 0 else f'lag(u, {-o}) over w as n{o + 2}' for o in range(-2, 3))} from b window w as (partition by j, k order by i)),
r as (select *, abs(n0 - 2 * n1 + n2) as r0, abs(n1 - 2 * n2 + n3) as r1, abs(n2 - 2 * n3 + n4) as r2 from q where n0 is not null and n4 is not null)
select (2 * i + o)::int as i, j, k, case when o = 0 then {case(False)} else {case(True)} end as value from r, (values (0), (1)) t(o)"""


add("prolong_eno_o2", lambda s, d: resample.eno(cube(s, d, 8), "u", "i", ENO), eno_sql())


def fallback(s, d):
    """Conservative prolongation of order 2, or of order 0 where it makes a new extremum among the coarse neighbours."""
    c = cube(s, d, 8)
    high = resample.prolongate(c, U("u"), *resample.children(W.average_left(2)), "high")
    near = stencil.neighbours(c, "u", "i", [-1, 1]).select(*[U(a).alias(f"c{a}") for a in AXES], "u", F.least("u", "v_m1", "v_1").alias("lo"), F.greatest("u", "v_m1", "v_1").alias("hi"))
    at = high.select("*", *[F.floor(U(a) / 2).cast("int").alias(f"c{a}") for a in AXES])
    return at.join(near, [f"c{a}" for a in AXES]).select(*AXES, F.when((U("high") < U("lo")) | (U("high") > U("hi")), U("u")).otherwise(U("high")).alias("value"))


add("prolong_fallback", fallback, f"with hp as ({prolong_sql(*resample.children(W.average_left(2)))}), {cube_sql(8, 'e')}, q as (select *, lag(u) over w as a, lead(u) over w as z from e window w as (partition by j, k order by i)) select hp.i, hp.j, hp.k, case when value < least(u, a, z) or value > greatest(u, a, z) then u else value end as value from hp join q on q.i = hp.i // 2 and q.j = hp.j // 2 and q.k = hp.k // 2")
add("reflux", lambda s, d: resample.reflux(cube(s, d, 8).select(*AXES, U("u").alias("flux")), cube(s, d, 16).select(*AXES, U("u").alias("flux")), "i"), f"with {cube_sql(8, 'b')}, {cube_sql(16, 'c')}, f as (select (i // 2)::int as i, (j // 2)::int as j, (k // 2)::int as k, sum(u) / 4e0 as fine from c where i % 2 = 0 group by 1, 2, 3) select b.i, b.j, b.k, fine - u as correction from b join f using (i, j, k)")
add("remake_level", lambda s, d: (lambda old, new: old.select(*AXES, U("u").alias("value")).unionByName(new.join(old.select(*AXES), list(AXES), "left_anti")))(two_levels(s, d)[1], resample.prolongate(cube(s, d, 8), U("u"), *resample.children(W.average_left(0)))), f"with {TWO} select i, j, k, u as value from f union all select (2 * b.i + x.o)::int, (2 * b.j + y.o)::int, (2 * b.k + z.o)::int, b.u from b, (values (0), (1)) x(o), (values (0), (1)) y(o), (values (0), (1)) z(o) where not (2 * b.i + x.o between 4 and 11 and 2 * b.j + y.o between 4 and 11 and 2 * b.k + z.o between 4 and 11)")

# -- halos and boundaries ----------------------------------------------------------------------------------------------

add("halo_periodic", lambda s, d: grid.shifted(cube(s, d), "u", {"west": (-1, 0, 0), "up": (0, 0, 1)}, N).select(*AXES, "west", "up"), f'with {cube_sql()} select c.i, c.j, c.k, l.u as west, u.u as up from c join c l on l.i = (c.i + 15) % 16 and l.j = c.j and l.k = c.k join c u on u.i = c.i and u.j = c.j and u.k = (c.k + 1) % 16')
_SRC = ", ".join(f"greatest(2, least({a}, 13)) as s{a}" for a in AXES)
_REF = ", ".join(f"case when {a} < 2 then 3 - {a} when {a} > 13 then 27 - {a} else {a} end as s{a}" for a in AXES)
_ON = " and ".join(f"o.{a} = q.s{a}" for a in AXES)
_ODD = " + ".join(f"(q.{a} <> q.s{a})::int" for a in AXES)
add("bc_dirichlet", lambda s, d: grid.filled(cube(s, d), "u", N, 2, "dirichlet", 5.0).select(*AXES, "u"), f"with {cube_sql()} select i, j, k, case when {region_sql(layers=2)} then u else 5e0 end as u from c")
add("bc_neumann", lambda s, d: grid.filled(cube(s, d), "u", N, 2, "neumann").select(*AXES, "u"), f"with {cube_sql()}, q as (select i, j, k, {_SRC} from c) select q.i, q.j, q.k, o.u from q join c o on {_ON}")
add("bc_reflection", lambda s, d: grid.filled(cube(s, d), "u", N, 2, "reflection", parity=-1).select(*AXES, "u"), f"with {cube_sql()}, q as (select i, j, k, {_REF} from c) select q.i, q.j, q.k, o.u * case when ({_ODD}) % 2 = 1 then -1e0 else 1e0 end as u from q join c o on {_ON}")
_FAR = " + ".join(f"(q.{a} - q.s{a}) * (q.{a} - q.s{a})" for a in AXES)
_OUT = " + ".join(f"(q.{a} not between 2 and 13)::int" for a in AXES)
add("bc_robin", lambda s, d: grid.filled(cube(s, d), "u", N, 2, "robin", 1.0).select(*AXES, F.round("u", 6).alias("u")), f"with {cube_sql()}, q as (select c.*, {_SRC} from c) select q.i, q.j, q.k, round(case when {' and '.join(f'q.{a} between 2 and 13' for a in AXES)} then q.u else 1e0 + pow(sqrt({' + '.join(f'pow(q.s{a} + 0.5e0, 2)' for a in AXES)}) / sqrt({' + '.join(f'pow(q.{a} + 0.5e0, 2)' for a in AXES)}), {_OUT}) * (o.u - 1e0) end, 6) as u from q join c o on {_ON}")
add("bc_linear", lambda s, d: grid.filled(cube(s, d), "u", N, 2, "linear").select(*AXES, F.round("u", 6).alias("u")), f"with {cube_sql()}, q as (select c.*, {_SRC}, {', '.join(f'greatest(2, least({a}, 13)) + case when {a} < 2 then 1 when {a} > 13 then -1 else 0 end as t{a}' for a in AXES)} from c) select q.i, q.j, q.k, round(o.u + sqrt(({_FAR})::double / greatest({_OUT}, 1)) * (o.u - p.u), 6) as u from q join c o on {_ON} join c p on {' and '.join(f'p.{a} = q.t{a}' for a in AXES)}")

# -- interpolation -----------------------------------------------------------------------------------------------------


def sites(s):
    """Points on dyadic places of the unit cube, so that weights are exact."""
    x = lambda m: ((U("id") * m) % 61 + 2) / F.lit(64.0)
    return s.range(40).select("id", x(7).alias("x"), x(11).alias("y"), x(13).alias("z"))


def linear_grid(s):
    return grid.coordinates(grid.points(s, N), N).withColumn("f", U("x") + F.lit(2.0) * U("y") - F.lit(4.0) * U("z") * U("x"))


_SITES = ", ".join(f"(((r * {m}) % 61) + 2) / 64e0 as {c}" for m, c in ((7, "x"), (11, "y"), (13, "z")))
_ANCHOR = lambda o: " and ".join(f"round_even(({c} * 16e0 - 0.5e0) - {o / 2!r}::double, 0) between 0 and {15 - o}" for c in "xyz")
for _o in (1, 2, 3, 4):
    add(f"interp_o{_o}", lambda s, d, o=_o: interp.interpolate(sites(s), linear_grid(s), "f", N, o).select("id", F.round("value", 9).alias("value")), f"with p as (select r as id, {_SITES} from range(40) t(r)) select id, round(x + 2 * y - 4 * z * x, 9) as value from p where {_ANCHOR(_o)}" if _o > 0 else None)
add("interp_o0", lambda s, d: interp.interpolate(sites(s), cube(s, d), "u", N, 0), f"with {cube_sql()}, p as (select r as id, {_SITES} from range(40) t(r)) select id, u as value from p join c on {' and '.join(f'{a} = round_even({q} * 16e0 - 0.5e0, 0)::int' for a, q in zip(AXES, 'xyz', strict=True))}")
for _d, _expr in (((1, 0, 0), "1 - 4 * z"), ((0, 1, 0), "2e0"), ((0, 0, 1), "-4 * x"), ((1, 0, 1), "-4e0"), ((2, 0, 0), "0e0")):
    add("interp_d" + "".join(map(str, _d)), lambda s, d, k=_d: interp.interpolate(sites(s), linear_grid(s), "f", N, 2, k).select("id", (F.round("value", 6) + F.lit(0.0)).alias("value")), f"with p as (select r as id, {_SITES} from range(40) t(r)) select id, round({_expr}, 6) + 0e0 as value from p where {_ANCHOR(2)}")

# -- algebra -----------------------------------------------------------------------------------------------------------

def E():
    return [U("e")[n] for n in range(9)]


def M3():
    return [[E()[3 * r + c] + F.lit(4.0 if r == c else 0.0) for c in range(3)] for r in range(3)]



_e = lambda n: f"embedding[{n + 1}]::double"
_m = lambda r, c: f"({_e(3 * r + c)}{' + 4' if r == c else ''})"
_det = f"({_m(0, 0)} * ({_m(1, 1)} * {_m(2, 2)} - {_m(1, 2)} * {_m(2, 1)}) - {_m(0, 1)} * ({_m(1, 0)} * {_m(2, 2)} - {_m(1, 2)} * {_m(2, 0)}) + {_m(0, 2)} * ({_m(1, 0)} * {_m(2, 1)} - {_m(1, 1)} * {_m(2, 0)}))"
add("tensor_det_inv_trace", lambda s, d: particles(s, d).select("id", F.round(S.det(M3()), 6).alias("det"), F.round(S.inverse(M3())[0][0], 6).alias("inv00"), F.round(S.inverse(M3())[0][1], 6).alias("inv01"), F.round(S.trace(M3(), [[F.lit(1.0 if r == c else 0.0) for c in range(3)] for r in range(3)]), 6).alias("trace")), f"select vec_id as id, round({_det}, 6) as det, round(({_m(1, 1)} * {_m(2, 2)} - {_m(1, 2)} * {_m(2, 1)}) / {_det}, 6) as inv00, round(-({_m(0, 1)} * {_m(2, 2)} - {_m(0, 2)} * {_m(2, 1)}) / {_det}, 6) as inv01, round({_m(0, 0)} + {_m(1, 1)} + {_m(2, 2)}, 6) as trace from embeddings")
add("vect_ops", lambda s, d: particles(s, d).select("id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("sum"), F.array_max("e").alias("maximum"), F.array_min("e").alias("minimum"), F.round(S.dot(E()[:3], E()[3:6]), 6).alias("dot"), F.array_max(F.transform("e", F.abs)).alias("maxabs"), F.exists("e", lambda x: x > 1).alias("some_large"), F.forall("e", lambda x: x > -3).alias("none_small")), f"with p as (select vec_id as id, [{', '.join(map(_e, range(9)))}] as e from embeddings) select id, round(list_sum(e), 6) as sum, list_max(e) as maximum, list_min(e) as minimum, round(e[1] * e[4] + e[2] * e[5] + e[3] * e[6], 6) as dot, list_max(list_transform(e, lambda x: abs(x))) as maxabs, list_max(e) > 1 as some_large, list_min(e) > -3 as none_small from p")
_I = lambda s: s.range(400).select("id", (U("id") % 20 - 10).alias("a"), (F.floor(U("id") / 20) - 10).cast("long").alias("b"))
_IS = "p as (select r as id, r % 20 - 10 as a, r // 20 - 10 as b from range(400) t(r))"
add("floor_ceil_div", lambda s, d: _I(s).filter("b <> 0").select("id", *[getattr(S, n)(U("a"), U("b")).alias(n) for n in ("div_floor", "mod_floor", "div_ceil", "mod_ceil", "align_floor", "align_ceil")]), f"with {_IS}, q as (select id, a, b, floor(a::double / b)::bigint as f, ceil(a::double / b)::bigint as c from p where b <> 0) select id, f as div_floor, a - b * f as mod_floor, c as div_ceil, a - b * c as mod_ceil, b * f as align_floor, b * c as align_ceil from q")
_pair = lambda c, f: [x.alias(n) for x, n in zip(f, c, strict=True)]


def _ab():
    return (U("a").cast("double"), U("b").cast("double")), (U("b").cast("double"), F.lit(2.0))



add("complex_ops", lambda s, d: _I(s).select("id", *_pair(("mul_re", "mul_im"), S.c_mul(*_ab())), *_pair(("div_re", "div_im"), S.c_div(*_ab())), F.sqrt(_ab()[0][0] * _ab()[0][0] + _ab()[0][1] * _ab()[0][1]).alias("abs"), F.round(S.c_exp((_ab()[0][0] / 4, _ab()[0][1]))[0], 6).alias("exp_re")), f"with {_IS} select id, (a * b - b * 2)::double as mul_re, (a * 2 + b * b)::double as mul_im, (a * b + b * 2)::double / (b * b + 4) as div_re, (b * b - a * 2)::double / (b * b + 4) as div_im, sqrt((a * a + b * b)::double) as abs, round(exp(a / 4e0) * cos(b::double), 6) as exp_re from p")
add("dual_ops", lambda s, d: _I(s).filter("b > 0").select("id", *_pair(("mul_val", "mul_eps"), S.d_mul(*_ab())), *_pair(("div_val", "div_eps"), S.d_div(*_ab())), *_pair(("sqrt_val", "sqrt_eps"), S.d_sqrt(_ab()[1])), *_pair(("min_val", "min_eps"), S.d_min(*_ab()))), f"with {_IS} select id, (a * b)::double as mul_val, (a * 2 + b * b)::double as mul_eps, a::double / b as div_val, (b - a::double / b * 2) / b as div_eps, sqrt(b::double) as sqrt_val, 2e0 / (2 * sqrt(b::double)) as sqrt_eps, least(a, b)::double as min_val, case when a <= b then b else 2 end::double as min_eps from p where b > 0")
add("rational_ops", lambda s, d: _I(s).filter("b <> 0").select("id", *_pair(("num", "den"), S.r_normal(U("a") * 6, U("b") * 4))), f"with {_IS} select id, (case when b < 0 then -1 else 1 end * (a * 6) // greatest(gcd(a * 6, b * 4), 1))::bigint as num, (case when b < 0 then -1 else 1 end * (b * 4) // greatest(gcd(a * 6, b * 4), 1))::bigint as den from p where b <> 0")
add("scalar_ops", lambda s, d: _I(s).select("id", S.pown(_ab()[0][0], 3).alias("cubed"), (S.flipsign(_ab()[0][0], _ab()[0][1]) + F.lit(0.0)).alias("flipped"), S.max1(_ab()[0][0], _ab()[0][1]).alias("larger"), S.min1(_ab()[0][0], _ab()[0][1]).alias("smaller"), S.linterp(F.lit(-10.0), F.lit(0.0), F.lit(10.0), F.lit(1.0), _ab()[0][0]).alias("part"), F.lit(float(S.factorial(6))).alias("six")), f"with {_IS} select id, (a * a * a)::double as cubed, case when b < 0 then -a else a end::double as flipped, greatest(a, b)::double as larger, least(a, b)::double as smaller, (a + 10) / 20e0 as part, 720e0 as six from p")
add("nan_propagation", lambda s, d: s.range(4).select("id", F.isnan(S.min1(F.when(U("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)), U("id").cast("double"))).alias("is_nan")), "select r as id, r % 2 = 0 as is_nan from range(4) t(r)")
add("root_bisect", lambda s, d: s.range(1, 41).select("id", F.round(S.bisect(lambda x: x * x - U("id").cast("double"), F.lit(0.0), F.lit(8.0), 50), 9).alias("root")), "select r as id, round(sqrt(r::double), 9) as root from range(1, 41) t(r)")
add("root_newton", lambda s, d: s.range(1, 41).select("id", F.round(S.newton(lambda x: x * x - U("id").cast("double"), lambda x: F.lit(2.0) * x, F.lit(4.0), 12), 9).alias("root")), "select r as id, round(sqrt(r::double), 9) as root from range(1, 41) t(r)")

# -- sparse, iteration -------------------------------------------------------------------------------------------------


def coo(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((U("l_suppkey") % 40).alias("row"), (U("l_partkey") % 40).alias("col"), U("l_quantity").alias("v"))
    return rows.groupBy("row", "col").agg(F.sum("v").alias("v"))


_COO = "m as (select l_suppkey % 40 as row, l_partkey % 40 as col, sum(l_quantity) as v from lineitem group by all)"
add("spmv_coo", lambda s, d: sparse.times_vector(coo(s, d), s.range(40).select(U("id").alias("idx"), (U("id") + 1).cast("double").alias("v"))), f"with {_COO} select row as idx, sum(v * (col + 1)) as v from m group by row")
add("jacobian_product", lambda s, d: sparse.times_matrix(coo(s, d), coo(s, d)), f"with {_COO} select a.row, b.col, sum(a.v * b.v) as v from m a join m b on a.col = b.row group by a.row, b.col")
add("sparse_vector_add", lambda s, d: sparse.add(*[s.read.parquet(f"{d}/{t}.parquet").groupBy(U(k).cast("long").alias("idx")).agg(F.count("*").cast("double").alias("v")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]), "select k::bigint as idx, sum(n)::double as v from (select c_nationkey as k, count(*) as n from customer group by 1 union all select s_nationkey, count(*) from supplier group by 1) group by 1")


def poisson(s, d):
    """Three sweeps for the 1-D Laplacian with zero ends, on planes of the cube."""
    rows = s.range(N).withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select(U("id").alias("row"), (U("id") + U("o")).alias("col"), F.when(U("o") == 0, F.lit(2.0)).otherwise(F.lit(-1.0)).alias("v"))
    return sparse.jacobi(rows.filter(U("col").between(0, N - 1)), cube(s, d).groupBy(U("i").cast("long").alias("idx")).agg(F.sum("u").alias("v")), 3)


add("jacobi_poisson", poisson, f"with {cube_sql()}, b as (select i::bigint as idx, sum(u) as f from c group by 1), x1 as (select idx, f, f / 2 as x from b), x2 as (select idx, f, (f + coalesce(lag(x) over (order by idx), 0) + coalesce(lead(x) over (order by idx), 0)) / 2 as x from x1) select idx, (f + coalesce(lag(x) over (order by idx), 0) + coalesce(lead(x) over (order by idx), 0)) / 2 as v from x2")
add("lincomb", lambda s, d: ode.lincomb([(2, cube(s, d)), (0, cube(s, d)), (-0.5, cube(s, d).select(*AXES, U("v").alias("u"), U("u").alias("v")))], list(AXES), ["u", "v"]), f"with {cube_sql()} select i, j, k, 2 * u - 0.5e0 * v as u, 2 * v - 0.5e0 * u as v from c")
DECAY = lambda t, y: y.select(*AXES, (-U("u")).alias("u"))
# One step of y' = -y with h = 1/4 multiplies by the method's polynomial; times 6144 the result is a whole number.
for _m_, _g in (("euler", Fraction(3, 4)), ("rk2", Fraction(25, 32)), ("rk3", Fraction(299, 384)), ("ssprk3", Fraction(299, 384)), ("rk4", 1 - Fraction(1, 4) + Fraction(1, 32) - Fraction(1, 384) + Fraction(1, 6144))):
    add(f"ode_{_m_}", lambda s, d, m=_m_: ode.step(cube(s, d, 8).select(*AXES, "u"), DECAY, 0.25, m, list(AXES), ["u"]).select(*AXES, F.round(U("u") * 6144).alias("u")), f"with {cube_sql(8, 'b')} select i, j, k, round(u * {_g.numerator * 6144 // _g.denominator}e0) as u from b")
add("ode_imex", lambda s, d: ode.implicit_explicit(cube(s, d, 8).select(*AXES, "u"), DECAY, lambda y, h: y.select(*AXES, (U("u") / F.lit(1 + h)).alias("u")), 0.25, list(AXES), ["u"]).select(*AXES, F.round("u", 8).alias("u")), f"with {cube_sql(8, 'b')} select i, j, k, round(u - 0.25e0 * y + 2 * (y - u) + 0.25e0 * u, 8) as u from (select *, u * 0.875e0 / 1.125e0 as y from b)")
add("ode_wave_step", lambda s, d: ode.step(cube(s, d, 8).select(*AXES, "u", "v"), lambda t, y: stencil.scatter(y, U("u"), stencil.summed(*[stencil.along(W.centred(2, 2), a) for a in AXES]), 64.0, 8, True, "l").join(y, list(AXES)).select(*AXES, U("v").alias("u"), U("l").alias("v")), 0.0625, "euler", list(AXES), ["u", "v"]), f"with {cube_sql(8, 'b')} select b.i, b.j, b.k, b.u + 0.0625e0 * b.v as u, b.v + 0.0625e0 * (64e0 * sum(w.w * o.u)) as v from b, (values (0, 0, 0, -6e0), (1, 0, 0, 1e0), (7, 0, 0, 1e0), (0, 1, 0, 1e0), (0, 7, 0, 1e0), (0, 0, 1, 1e0), (0, 0, 7, 1e0)) w(di, dj, dk, w) join b o on o.i = (b.i + w.di) % 8 and o.j = (b.j + w.dj) % 8 and o.k = (b.k + w.dk) % 8 group by b.i, b.j, b.k, b.u, b.v")
add("leapfrog", lambda s, d: cube(s, d).withColumn("v", U("v") - F.lit(0.25) * U("u")).withColumn("u", U("u") + F.lit(0.25) * U("v")), f"with {cube_sql()} select i, j, k, u + 0.25e0 * (v - 0.25e0 * u) as u, v - 0.25e0 * u as v from c")


def order(s, d):
    """Orders of methods from one step with h and two with h / 2 of y' = -y against the exact solution."""
    one = s.range(1).select(F.lit(1.0).alias("u"), F.lit(0).alias("i"))
    f = lambda t, y: y.select("i", (-U("u")).alias("u"))
    out = None
    for m in ("euler", "rk2", "rk4"):
        a = ode.step(one, f, 0.25, m, ["i"], ["u"]).select(U("u").alias("a"))
        b = ode.step(ode.step(one, f, 0.125, m, ["i"], ["u"]), f, 0.125, m, ["i"], ["u"]).select(U("u").alias("b"))
        exact = F.exp(F.lit(-0.25))
        r = a.withColumn("x", F.lit(1)).join(b.withColumn("x", F.lit(1)), "x").select(F.lit(m).alias("method"), F.round(F.log2(F.abs((U("a") - exact) / (U("b") - exact)))).cast("int").alias("rate"))
        out = r if out is None else out.unionByName(r)
    return out


add("convergence_order", order, "select * from (values ('euler', 1), ('rk2', 2), ('rk4', 4)) t(method, rate)")

# -- time, quality, output ---------------------------------------------------------------------------------------------

add("restrict_hours", lambda s, d: hours(s, d).groupBy("event_type", F.floor(U("i") / 4).cast("int").alias("i")).agg(F.sum("u").alias("u")), f"with {HOURS_SQL} select event_type, (i // 4)::int as i, sum(u)::bigint as u from h group by 1, 2")
add("output_every", lambda s, d: tsv.output_every(hours(s, d).withColumnRenamed("i", "iteration"), 24), f"with {HOURS_SQL} select event_type, i as iteration, u from h where i % 24 = 0")


def levels(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("i")
    return hours(s, d).select("event_type", "i", "u", F.lag("u").over(w).alias("u_p"), F.lag("u", 2).over(w).alias("u_p_p"))


add("time_levels", levels, f"with {HOURS_SQL} select event_type, i, u, lag(u) over w as u_p, lag(u, 2) over w as u_p_p from h window w as (partition by event_type order by i)")
add("streaming_restrict_analogue", lambda s, d: __import__("latticeql.streaming.restriction", fromlist=["hourly"]).hourly(s.read.parquet(f"{d}/events.parquet").withColumn("ts", U("ts").cast("timestamp")), 4).select("event_type", "cents", "n", ((F.unix_timestamp("start") - 1704067200) / 14400).cast("int").alias("slot")), "select event_type, sum(round(value * 100)::bigint)::bigint as cents, count(*) as n, floor((epoch(ts) - 1704067200) / 14400)::int as slot from events group by event_type, slot")
add("validity_check", lambda s, d: quality.invalid(quality.poison(cube(s, d), "u", N), ["u", "v"], N), f"with {cube_sql()}, q as (select case when {region_sql()} then 'int' else 'bnd' end as region from c) select variable, region, count(*) as points, sum(case when variable = 'u' and region = 'bnd' then 1 else 0 end)::bigint as undefined from q, (values ('u'), ('v')) t(variable) group by 1, 2")
add("dedup_ghost_rows", lambda s, d: tsv.keep_first(cube(s, d).select(*AXES, "u", F.lit(0).alias("isghost")).unionByName(cube(s, d).filter(U("i") < 3).select(*AXES, (U("u") + 1).alias("u"), F.lit(1).alias("isghost"))), list(AXES)), f"with {cube_sql()} select i, j, k, u from c")
add("particles_stats", lambda s, d: particles(s, d).groupBy("label").agg(F.count("*").alias("n"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.round(F.avg("z"), 6).alias("z_avg")), f"select label, count(*) as n, max({_e(0)}) as x_max, min({_e(1)}) as y_min, round(avg({_e(2)}), 6) as z_avg from embeddings group by label")


def exact_error(s, d):
    """A standing wave on 8^3 periodic vertices, a step of rk2 for its two first-order equations, less the exact solution at that time."""
    two_pi, dt = F.lit(6.283185307179586), 1 / 64
    x = [U(a) / F.lit(8.0) for a in AXES]
    start = F.cos(two_pi * x[0]) * F.cos(two_pi * x[1]) * F.cos(two_pi * x[2])
    first = grid.points(s, 8).select(*AXES, start.alias("u"), F.lit(0.0).alias("v"))
    box = stencil.summed(*[stencil.along(W.centred(2, 2), a) for a in AXES])
    rhs = lambda t, y: stencil.scatter_several(y, U("u"), {"l": (box, 64.0)}, 8, ("v",), True).select(*AXES, U("v").alias("u"), U("l").alias("v"))
    after = ode.step(first, rhs, dt, "rk2", list(AXES), ["u", "v"])
    exact = start * F.cos(two_pi * F.sqrt(F.lit(3.0)) * F.lit(dt))
    norms = agg.norms(after.withColumn("e", U("u") - exact), ["e"], F.lit(1 / 512))
    return norms.select(F.round("e_maxabs", 10).alias("e_maxabs"), F.round("e_l2norm", 10).alias("e_l2norm"))


# The wave is an eigenfunction of the difference operator, so a step multiplies it; the mean of its square is 1/8.
add("exact_error", exact_error, "select round(abs(f), 10) as e_maxabs, round(abs(f) / sqrt(8e0), 10) as e_l2norm from (select 1e0 + 3 * 64e0 * (2 * cos(6.283185307179586 / 8) - 2) / (2 * 64e0 * 64e0) - cos(6.283185307179586 * sqrt(3e0) / 64) as f)")
add("geo_patches", lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/nation.parquet"), U("c_nationkey") == U("n_nationkey")).groupBy(U("n_regionkey").alias("patch"), U("n_nationkey").alias("component")).agg(F.count("*").alias("points")), "select n_regionkey as patch, n_nationkey as component, count(*) as points from customer join nation on c_nationkey = n_nationkey group by 1, 2")


def manifest(s, d):
    """What a run's output holds: a weekly output of the hours is written in the shared folder, and its files are read back."""
    from latticeql.operators.lineage import shared
    from latticeql.sources import records

    at = shared(s, "output")
    records.write_output(tsv.output_every(hours(s, d).withColumnRenamed("i", "iteration"), 168), at, "hours")
    return records.manifest(s, at, "hours")


add("manifest", manifest, f"with {HOURS_SQL} select 'hours' as name, i as iteration, count(*) as n_rows, 'event_type,u' as variables from h where i % 168 = 0 group by i")

