"""Queries between levels, boxes and patches: high-order and adaptive stencils along an axis, ghost rows, point location."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from latticeql.functions import scalar as S
from latticeql.functions import weights as W
from latticeql.operators import grid, lines, patches, quality, resample
from latticeql.operators.grid import AXES
from latticeql.plans.grid_queries import TWO, sites, two_levels
from latticeql.plans.views import cube, cube_sql, particles

QUERIES: dict = {}
SQL: dict = {}
N = 16
U = F.col


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# -- linear rows of high order ------------------------------------------------------------------------------------------

ROWS = {f"vertex_poly_o{p}": ({0: Fraction(1)}, W.between(p + 1)) for p in (7, 9, 11)}
ROWS |= {f"cell_poly_o{p}": resample.children(W.cell_left(p)) for p in range(5, 12)}
ROWS |= {f"cell_cons_o{p}": resample.children(W.average_left(p)) for p in range(5, 12)}
# Hermite interpolation of order 5 at the middle.
HERMITE5 = {-2: Fraction(121, 8192), -1: Fraction(-875, 8192), 0: Fraction(2425, 4096), 1: Fraction(2425, 4096), 2: Fraction(-875, 8192), 3: Fraction(121, 8192)}
ROWS["vertex_hermite_o5"] = ({0: Fraction(1)}, HERMITE5)


def along_sql(rows: tuple) -> str:
    parts = []
    for off, row in enumerate(rows):
        weights, den = W.whole(row)
        values = ", ".join(f"({o}, {w}e0)" for o, w in weights.items())
        parts.append(f"select (2 * c.i + {off})::int as i, c.j, c.k, round(sum(w.w * o.u) / {den}e0, 6) as u from c, (values {values}) w(d, w) join c o on o.i = c.i + w.d and o.j = c.j and o.k = c.k group by c.i, c.j, c.k having count(*) = {len(weights)}")
    return f"with {cube_sql()} " + " union all ".join(parts)


for _name, _rows in ROWS.items():
    add(f"prolong_line_{_name}", lambda s, d, r=_rows: lines.prolongate_along(cube(s, d), "u", "i", *r).select(*AXES, F.round("u", 6).alias("u")), along_sql(_rows))

# -- adaptive stencils --------------------------------------------------------------------------------------------------


def near_sql(reach: int) -> str:
    columns = ", ".join(f"lag(u, {reach - n}) over w as n{n}" if n < reach else f"lead(u, {n - reach}) over w as n{n}" for n in range(2 * reach + 1))
    return f"{cube_sql()}, q as (select i, j, k, {columns} from c window w as (partition by j, k order by i) qualify n0 is not null and n{2 * reach} is not null)"


def total_sql(row: dict, reach: int) -> str:
    weights, den = W.whole(row)
    return "(" + " + ".join(f"{w}e0 * n{o + reach}" for o, w in sorted(weights.items())) + f") / {den}e0"


def eno_sql(order: int) -> str:
    options = []
    for first in range(-order, 1):
        shift = abs(first + order // 2)
        rough = " + ".join(f"({(-1) ** (order - m) * comb(order, m)}) * n{first + m + order}" for m in range(order + 1))
        options.append(f"{{'r': abs({rough}) * {1 + 2.0**-26 * shift!r}::double, 'a': {shift}, 's': {first}, 'x': {total_sql(W.average_left(order, first), order)}, 'y': {total_sql(W.mirrored(W.average_left(order, -first - order)), order)}}}")
    return f"with {near_sql(order)}, p as (select i, j, k, unnest([{', '.join(options)}]) as p from q), b as (select distinct on (i, j, k) i, j, k, p.x as x, p.y as y from p order by i, j, k, p.r, p.a, p.s) select (2 * i)::int as i, j, k, x as u from b union all select (2 * i + 1)::int as i, j, k, y as u from b"


def fallback_sql(order: int) -> str:
    rows = [W.average_left(order), W.mirrored(W.average_left(order))]
    linear = [W.average_left(1), W.mirrored(W.average_left(1))]
    reach, parts = max(abs(o) for row in rows for o in row), []
    for off, row in enumerate(rows):
        names = [f"n{o + reach}" for o in range(min(row), max(row) + 1)]
        slopes = ", ".join(f"{b} - {a}" for a, b in zip(names, names[1:], strict=False))
        high = total_sql(row, reach)
        parts.append(f"select (2 * i + {off})::int as i, j, k, case when {high} < least({', '.join(names)}) or {high} > greatest({', '.join(names)}) or (least({slopes}) < 0 and greatest({slopes}) > 0) then {total_sql(linear[off], reach)} else {high} end as u from q")
    return f"with {near_sql(reach)} " + " union all ".join(parts)


for _p in (2, 4):
    add(f"prolong_line_eno_o{_p}", lambda s, d, p=_p: lines.eno_along(cube(s, d), "u", "i", p), eno_sql(_p))
for _p in (2, 3, 5):
    add(f"prolong_line_fallback_o{_p}", lambda s, d, p=_p: lines.fallback_along(cube(s, d), "u", "i", p), fallback_sql(_p))

# -- boxes, levels, patches ---------------------------------------------------------------------------------------------

_HALO = " and ".join(f"c.{a} between 8 * b.b{a} - 2 and 8 * b.b{a} + 9" for a in AXES)
add("ghost_rows", lambda s, d: patches.with_ghosts(cube(s, d).select(*AXES, "u"), N, 8, 2), f"with {cube_sql()}, b as (select (r % 2)::int as bi, ((r // 2) % 2)::int as bj, (r // 4)::int as bk from range(8) t(r)) select b.*, c.i, c.j, c.k, c.u, ({' or '.join(f'c.{a} // 8 <> b.b{a}' for a in AXES)}) as isghost from c join b on {_HALO}")


def located(s, d):
    coarse, fine = two_levels(s, d)
    cells = coarse.select(F.lit(0).alias("level"), *AXES).unionByName(fine.select(F.lit(1).alias("level"), *AXES))
    return patches.locate(sites(s), cells, [8, N])


_PLACES = ", ".join(f"(((r * {m}) % 61) + 2) / 64e0 as {c}" for m, c in ((7, "x"), (11, "y"), (13, "z")))
_IN = " and ".join(f"floor({c} * 16) between 4 and 11" for c in "xyz")
add("locate_points", located, f"with {TWO}, p as (select r as id, {_PLACES} from range(40) t(r)), q as (select *, ({_IN})::int as level from p) select id, level, {', '.join(f'floor({c} * 8 * (1 + level))::int as {a}' for a, c in zip(AXES, 'xyz', strict=True))} from q")


def neighbour_patch(s, d):
    """Two layers of ghosts behind a patch's last cell along i, from a patch whose first axis is this one's second."""
    ghosts = s.range(2 * N * N).select("id", (N + U("id") % 2).cast("int").alias("i"), (F.floor(U("id") / 2) % N).cast("int").alias("j"), F.floor(U("id") / (2 * N)).cast("int").alias("k"))
    centre = lambda a, less=0: (U(a) - F.lit(less) + F.lit(0.5)) / F.lit(float(N))
    values = patches.across(ghosts, cube(s, d), "v", N, {"x": centre("j"), "y": centre("i", N), "z": centre("k")})
    return ghosts.join(values, "id").select(*AXES, "value")


add("interpatch_ghosts", neighbour_patch, f"with {cube_sql()} select (16 + j)::int as i, i as j, k, v as value from c where j < 2")


def orbit(s, d):
    """A cube that moves in a quarter of a circle a step: the cells whose error, one over the distance from it, asks for refinement."""
    cells = grid.coordinates(cube(s, d), N, -1.0, 1.0).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x0 = F.element_at(F.array(*map(F.lit, (0.5, 0.0, -0.5, 0.0))), U("step") + 1)
    y0 = F.element_at(F.array(*map(F.lit, (0.0, 0.5, 0.0, -0.5))), U("step") + 1)
    error = F.lit(1.0) / F.greatest(F.abs(U("x") - x0), F.abs(U("y") - y0), F.abs("z"), F.lit(1e-9))
    return cells.filter(error >= 4).groupBy("step").agg(F.count("*").alias("n"), F.sum("u").alias("u"))


add("moving_box_tags", orbit, f"with {cube_sql()}, o as (select * from (values (0, 0.5e0, 0e0), (1, 0e0, 0.5e0), (2, -0.5e0, 0e0), (3, 0e0, -0.5e0)) t(step, x0, y0)) select step, count(*) as n, sum(u) as u from c, o where greatest(abs((i + 0.5e0) * 0.125e0 - 1 - x0), abs((j + 0.5e0) * 0.125e0 - 1 - y0), abs((k + 0.5e0) * 0.125e0 - 1)) <= 0.25 group by step")

# -- checks and numbers -------------------------------------------------------------------------------------------------


def written_outside(s, d):
    """A kernel that declares the interior and writes a plane of the boundary as well."""
    before = cube(s, d)
    wrote = (grid.region(N) == "int") | (U("i") == 0)
    return quality.changed(before, before.withColumn("u", F.when(wrote, U("u") + 1).otherwise(U("u"))), ["u", "v"], N)


add("undeclared_writes", written_outside, f"with {cube_sql()}, q as (select i, case when {' and '.join(f'{a} between 1 and 14' for a in AXES)} then 'int' else 'bnd' end as region from c) select region, count(*) filter (region = 'int' or i = 0) as changed from q group by region")


def overflows(s, d):
    a, b = (U("id") - 200) * F.lit(2**55), (U("id") % 7 - 3) * F.lit(2**61)
    return s.range(400).select("id", *[c.alias(n) for n, c in S.checked(a, b).items()])


_BIG = {"added": "a + b", "subtracted": "a - b", "multiplied": "x * y", "negated": "-a", "divided": "case when b <> 0 then sign(a) * sign(b) * (abs(a) // abs(b)) end", "remainder": "case when b <> 0 then a - b * (sign(a) * sign(b) * (abs(a) // abs(b))) end"}
_CHECKED = ", ".join(f"case when {e} between -9223372036854775808::hugeint and 9223372036854775807::hugeint then ({e})::bigint end as {n}" for n, e in _BIG.items() if n != "multiplied")
# Of the product, 2^116 times a small whole number, only zero fits.
add("checked_integers", overflows, f"with q as (select r as id, (r - 200)::hugeint * 36028797018963968 as a, (r % 7 - 3)::hugeint * 2305843009213693952 as b from range(400) t(r)) select id, {_CHECKED}, case when a = 0 or b = 0 then 0::bigint end as multiplied from q")


def packed(s, d):
    """The square of a symmetric tensor whose six components are packed by rows, and its product with the unit tensor."""
    at = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}
    e = lambda a, b: U("e")[at[a, b]]
    return particles(s, d).select("id", F.round(S.sum_symm(3, lambda a, b: e(a, b) * e(a, b)), 6).alias("square"), F.round(S.sum_symm(3, lambda a, b: e(a, b) if a == b else F.lit(0.0)), 6).alias("trace"))


_P = [f"embedding[{n}]::double" for n in range(1, 7)]
add("symmetric_sums", packed, f"select vec_id as id, round({' + '.join(f'{_P[n]} * {_P[n]}' for n in (0, 3, 5))} + 2 * ({' + '.join(f'{_P[n]} * {_P[n]}' for n in (1, 2, 4))}), 6) as square, round({_P[0]} + {_P[3]} + {_P[5]}, 6) as trace from embeddings")
add("linear_and_factorial", lambda s, d: s.range(20).select("id", S.linterp(F.lit(0.0), F.lit(1.0), F.lit(4.0), F.lit(9.0), U("id").cast("double")).alias("line"), F.factorial("id").alias("factorial")), "select r as id, 1 + 2e0 * r as line, factorial(r::int)::bigint as factorial from range(20) t(r)")
