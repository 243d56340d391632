"""Queries of boundaries by face, vector stencils, weights at refinement edges, whole-number algebra near its limits and parts of grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeql.functions import scalar as S
from latticeql.functions import weights as W
from latticeql.operators import agg, grid, ode, stencil
from latticeql.operators.grid import AXES
from latticeql.plans.grid_queries import FIRST, SECOND, TWO, published, two_levels
from latticeql.plans.views import cube, cube_sql

QUERIES: dict = {}
SQL: dict = {}
N = 16
U = F.col


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# -- boundaries by face -------------------------------------------------------------------------------------------------


def source_sql(a: str, kind: str, upper: bool, cell: bool) -> str:
    if kind in ("neumann", "linear", "robin"):
        return "13" if upper else "2"
    if kind == "reflection":
        return f"{27 if cell else 26} - {a}" if upper else f"{3 if cell else 4} - {a}"
    if kind == "periodic":
        return f"{a} - 12" if upper else f"{a} + 12"
    return a


def boundary_sql(kinds: dict, constant: float, limit: float, parity: tuple, centring: str) -> str:
    """Two layers on 16 points, each case spelled out by the rule of every face, edge and corner."""
    at = lambda a, f: f"case when {a} < 2 then {f(kinds[a + '_lower'], False)} when {a} > 13 then {f(kinds[a + '_upper'], True)} else {f(None, False)} end"
    cell = {a: c == "c" for a, c in zip(AXES, centring, strict=True)}
    count = lambda *wanted: " + ".join(f"({at(a, lambda k, _: str(int(k in wanted)))})" for a in AXES)
    columns = [f"{at(a, lambda k, up, a=a: source_sql(a, k, up, cell[a]))} as s{a}, {at(a, lambda k, up: '0' if k != 'linear' else '-1' if up else '1')} as d{a}" for a in AXES]
    flips = " + ".join(f"({at(a, lambda k, _, p=p: str(int(k == 'reflection' and p < 0)))})" for a, p in zip(AXES, parity, strict=True))
    marks = f"{count(*(grid.KINDS - {'none'}))} as touched, {count('dirichlet')} as fixed, {count('robin')} as robin, {count('linear')} as linear, {flips} as flips"
    r = lambda p: "sqrt(" + " + ".join(f"pow(-1e0 + (q.{p}{a} + {0.5 if cell[a] else 0.0}) * 0.125e0, 2)" for a in AXES) + ")"
    first = f"case when q.robin > 0 then {limit!r} + pow({r('s')} / {r('')}, q.robin) * (o.u - {limit!r}) else o.u end"
    far = " + ".join(f"pow(q.{a} - q.s{a}, 2)" for a in AXES)
    on = lambda t, d: " and ".join(f"{t}.{a} = q.s{a}{d and f' + q.d{a}'}" for a in AXES)
    value = f"{first} + case when q.linear > 0 then sqrt(({far}) / greatest(q.linear, 1)) * ({first} - p.u) else 0 end"
    return f"with {cube_sql()}, q as (select c.*, {', '.join(columns)}, {marks} from c) select q.i, q.j, q.k, round(case when q.touched = 0 then q.u when q.fixed > 0 then {constant!r} else ({value}) * case when q.flips % 2 = 1 then -1 else 1 end end, 6) + 0e0 as u from q left join c o on {on('o', '')} left join c p on {on('p', 'd')}"


def boundary(name: str, kinds: dict, constant: float = 5.0, limit: float = 1.0, parity: tuple = (1, 1, 1), centring: str = "ccc") -> None:
    query = lambda s, d: grid.bounded(cube(s, d).select(*AXES, "u"), "u", N, 2, kinds, constant, limit, parity, centring, -1.0, 0.125).select(*AXES, (F.round("u", 6) + F.lit(0.0)).alias("u"))
    add(name, query, boundary_sql(kinds, constant, limit, parity, centring))


boundary("bc_by_face", grid.faces(i_lower="dirichlet", i_upper="neumann", j_lower="linear", j_upper="reflection", k_lower="robin"), parity=(1, -1, 1))
boundary("bc_reflecting_corner", grid.faces("neumann", i_lower="reflection", j_lower="reflection", k_lower="reflection"), parity=(-1, 1, -1))
boundary("bc_vertex_reflection", grid.faces("linear", i_lower="reflection", k_upper="reflection"), parity=(-1, 1, -1), centring="vcv")
boundary("bc_periodic_and_robin", grid.faces("robin", i_lower="periodic", i_upper="periodic", k_upper="dirichlet"))
boundary("bc_none_and_linear", grid.faces("none", j_upper="linear", k_lower="linear", k_upper="neumann"))


def by_variable(s, d):
    """Defaults at all faces, and another condition for one of two variables."""
    default, own = grid.faces("neumann"), grid.faces("reflection", k_upper="dirichlet")
    one = grid.bounded(cube(s, d), "u", N, 2, default)
    both = grid.bounded(one, "v", N, 2, own, 7.0, parity=(-1, -1, -1))
    return both.groupBy("k").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))


_NEAR = " and ".join(f"o.{a} = greatest(2, least(q.{a}, 13))" for a in AXES)
_BACK = {a: f"case when q.{a} < 2 then 3 - q.{a} when q.{a} > 13 then 27 - q.{a} else q.{a} end" for a in AXES}
_MIRROR = " and ".join(f"m.{a} = {_BACK[a]}" for a in AXES)
_FLIP = " * ".join(f"case when q.{a} < 2 or q.{a} > 13 then -1 else 1 end" for a in AXES)
add("bc_by_variable", by_variable, f"with {cube_sql()} select q.k, sum(o.u) as u, sum(case when q.k > 13 then 7e0 else m.v * {_FLIP} end) as v from c q join c o on {_NEAR} join c m on {_MIRROR} group by q.k")
add("outer_valid", lambda s, d: s.createDataFrame([(n, grid.outer_valid(k)) for n, k in (("whole", grid.faces("neumann", i_lower="reflection")), ("open", grid.faces("neumann", k_upper="none")))], "name string, valid boolean"), "select * from (values ('whole', true), ('open', false)) t(name, valid)")

# -- vector stencils ----------------------------------------------------------------------------------------------------


def axis_sql(row: dict, a: str, name: str) -> str:
    weights, den = W.whole(row)
    values = ", ".join(f"({o}, {w}e0)" for o, w in weights.items())
    rest = " and ".join(f"o.{b} = c.{b}" for b in AXES if b != a)
    return f"{name} as (select c.i, c.j, c.k, sum(w.w * o.u) / {den}e0 as x from c, (values {values}) w(d, w) join c o on o.{a} = c.{a} + w.d and {rest} group by all having count(*) = {len(weights)})"


def mixed_sql(row: dict, a: str, b: str, name: str) -> str:
    weights, den = W.whole(row)
    values = ", ".join(f"({o}, {p}, {w * v}e0)" for o, w in weights.items() for p, v in weights.items())
    (rest,) = [x for x in AXES if x not in (a, b)]
    return f"{name} as (select c.i, c.j, c.k, sum(w.w * o.u) / {den * den}e0 as x from c, (values {values}) w(d, e, w) join c o on o.{a} = c.{a} + w.d and o.{b} = c.{b} + w.e and o.{rest} = c.{rest} group by all having count(*) = {len(weights) ** 2})"


for _p in (2, 4, 6, 8):
    _parts = ", ".join(axis_sql(published(FIRST[_p]), a, f"g{a}") for a in AXES)
    add(f"gradient_o{_p}", lambda s, d, p=_p: stencil.gradient(cube(s, d), "u", W.centred(p, 1), 16.0, N), f"with {cube_sql()}, {_parts} select gi.i, gi.j, gi.k, gi.x * 16e0 as d_i, gj.x * 16e0 as d_j, gk.x * 16e0 as d_k from gi join gj using (i, j, k) join gk using (i, j, k)")
for _p in (2, 4):
    _names = [(a, b) for x, a in enumerate(AXES) for b in AXES[x:]]
    _parts = ", ".join(axis_sql(published(SECOND[_p]), a, f"h{a}{b}") if a == b else mixed_sql(published(FIRST[_p]), a, b, f"h{a}{b}") for a, b in _names)
    add(f"hessian_o{_p}", lambda s, d, p=_p: stencil.hessian(cube(s, d), "u", W.centred(p, 1), W.centred(p, 2), 16.0, N), f"with {cube_sql()}, {_parts} select hii.i, hii.j, hii.k, {', '.join(f'h{a}{b}.x * 256e0 as d_{a}{b}' for a, b in _names)} from hii {' '.join(f'join h{a}{b} using (i, j, k)' for a, b in _names[1:])}")

# -- weights, places, parts of grids ------------------------------------------------------------------------------------


def refined_norms(s, d):
    """Norms of a coarse vertex grid, 17^3 vertices of 16^3 cells, of which an L-shaped region is refined."""
    cells = grid.points(s, N).filter(~((U("i") < 8) & (U("j") < 8) | (U("i") < 8) & (U("k") < 4)))
    vertices = grid.points(s, N + 1).select(*AXES, (U("i") + 2 * U("j") - U("k")).cast("double").alias("u"))
    return agg.norms(vertices.join(grid.octant_weight(cells), list(AXES)), ["u"], U("weight"))


_VERTICES = "x as (select (r % 17)::int as i, ((r // 17) % 17)::int as j, (r // 289)::int as k from range(4913) t(r))"
_EIGHT = " + ".join(f"(i - {a} between 0 and 15 and j - {b} between 0 and 15 and k - {c} between 0 and 15 and not (i - {a} < 8 and j - {b} < 8 or i - {a} < 8 and k - {c} < 4))::int" for a in (0, 1) for b in (0, 1) for c in (0, 1))
add("norms_octant_weights", refined_norms, f"with {_VERTICES}, w as (select (i + 2 * j - k)::double as u, ({_EIGHT}) / 8e0 as w from x), l as (select * from w where w > 0), m as (select sum(w) as volume, min(u) as u_min, max(u) as u_max, sum(w * u) as s, sum(w * u * u) as q, sum(w * abs(u)) as a, max(abs(u)) as u_maxabs from l) select volume, u_min, u_max, s as u_sum, s / volume as u_avg, sqrt(greatest(0e0, q / volume - (s / volume) * (s / volume))) as u_stddev, a / volume as u_l1norm, sqrt(q / volume) as u_l2norm, u_maxabs from m")
add("min_max_sumloc", lambda s, d: agg.places(cube(s, d), "u", list(AXES)), f"with {cube_sql()}, lo as (select * from c order by u, i, j, k limit 1), hi as (select * from c order by u desc, i, j, k limit 1), z as (select sum(u * i) as a, sum(u * j) as b, sum(u * k) as c from c) select lo.u as min, lo.i as minloc_i, lo.j as minloc_j, lo.k as minloc_k, hi.u as max, hi.i as maxloc_i, hi.j as maxloc_j, hi.k as maxloc_k, z.a as sumloc_i, z.b as sumloc_j, z.c as sumloc_k from lo, hi, z")
add("places_of_odd_values", lambda s, d: agg.places(s.range(6).select(F.element_at(F.array(*map(F.lit, (float("nan"), 0.0, -0.0, 2.0, float("nan"), 2.0))), (U("id") + 1).cast("int")).alias("u"), U("id").alias("i")), "u", ["i"]), "select 0e0 as min, 1::bigint as minloc_i, 2e0 as max, 3::bigint as maxloc_i, 16e0 as sumloc_i")
for _a, _at in (("i", {"j": 3, "k": 11}), ("j", {"i": 2, "k": 9}), ("k", {"i": 13, "j": 1})):
    add(f"line_own_coordinates_{_a}", lambda s, d, a=_a, at=_at: grid.line(cube(s, d), a, at).select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where {' and '.join(f'{x} = {y}' for x, y in _at.items())}")
for _where, _test in (("everywhere", "true"), ("interior", " and ".join(f"{a} between 2 and 13" for a in AXES)), ("boundary", "not (" + " and ".join(f"{a} between 2 and 13" for a in AXES) + ")"), ("ghosts", "i = 15")):
    add(f"loop_{_where}", lambda s, d, w=_where: grid.loop(cube(s, d).withColumn("ghost", U("i") == 15), w, N, 2, "ghost").select(*AXES, "u"), f"with {cube_sql()} select i, j, k, u from c where {_test}")


def levels(s, d):
    coarse, fine = two_levels(s, d)
    rows = coarse.select(F.lit(0).alias("level"), *AXES, "u").unionByName(fine.select(F.lit(1).alias("level"), *AXES, "u"))
    return rows.withColumn("patch", (U("i") % 3).cast("int"))


add("active_levels", lambda s, d: grid.active(levels(s, d), (1, 2), (0, 2)).select("level", "patch", *AXES, "u"), f"with {TWO} select 1 as level, i % 3 as patch, i, j, k, u from f where i % 3 < 2")
add("coarse_buffer", lambda s, d: grid.buffer(cube(s, d, 8), two_levels(s, d)[1], 1).select(*AXES, "u"), f"with {cube_sql(8, 'b')} select i, j, k, u from b where i between 1 and 6 and j between 1 and 6 and k between 1 and 6")


def types(s, d):
    covered = U("i").between(4, 11) & U("j").between(4, 11) & U("k").between(4, 11)
    return cube(s, d).groupBy(grid.point_type(N, 1, covered).alias("point_type")).agg(F.count("*").alias("n"), F.sum("u").alias("u"))


add("point_types", types, f"with {cube_sql()} select case when i between 4 and 11 and j between 4 and 11 and k between 4 and 11 then 'rest' when {' and '.join(f'{a} between 1 and 14' for a in AXES)} then 'int' else 'bdry' end as point_type, count(*) as n, sum(u) as u from c group by 1")

# -- whole numbers near their limits ------------------------------------------------------------------------------------

_BIG = lambda s: s.range(400).select("id", ((U("id") - 200) * F.lit(2**54) + U("id")).alias("a"), ((U("id") % 7 - 3) * F.lit(2**59) + U("id") % 5 - 2).alias("b")).filter("b <> 0")
_BIG_SQL = "p as (select r as id, (r - 200)::hugeint * 18014398509481984 + r as a, (r % 7 - 3)::hugeint * 576460752303423488 + r % 5 - 2 as b from range(400) t(r)), q as (select *, ((a % b) + b) % b as m from p where b <> 0), z as (select *, case when m = 0 then 0 else m - b end as c from q)"
add("floor_ceil_div_large", lambda s, d: _BIG(s).select("id", *[getattr(S, n)(U("a"), U("b")).alias(n) for n in ("div_floor", "mod_floor", "div_ceil", "mod_ceil", "align_floor", "align_ceil")]), f"with {_BIG_SQL} select id, ((a - m) // b)::bigint as div_floor, m::bigint as mod_floor, ((a - c) // b)::bigint as div_ceil, c::bigint as mod_ceil, (a - m)::bigint as align_floor, (a - c)::bigint as align_ceil from z")
add("signs", lambda s, d: s.range(5).select("id", F.element_at(F.array(*map(F.lit, (-2.5, -0.0, 0.0, 3.0, float("inf")))), (U("id") + 1).cast("int")).alias("y")).select("id", S.bitsign(U("y")).alias("bit"), S.flipsign(F.lit(4.0), U("y")).alias("flipped")), "select * from (values (0::bigint, 1, -4e0), (1, 1, -4e0), (2, 0, 4e0), (3, 0, 4e0), (4, 0, 4e0)) t(id, bit, flipped)")


def rationals(s, d):
    a = S.r_normal((U("id") - 100) * F.lit(2**54) + 1, F.lit(7).cast("long"))
    b = S.r_normal((U("id") % 11 - 5) * F.lit(2**58), (U("id") % 3 + 1).cast("long"))
    rows = s.range(200).select("id", F.struct(a[0].alias("n"), a[1].alias("d")).alias("a"), F.struct(b[0].alias("n"), b[1].alias("d")).alias("b"))
    a, b = ((U(f"{x}.n"), U(f"{x}.d")) for x in "ab")
    small = ((U("id") % 9 - 4).cast("long"), (U("id") % 4 + 2).cast("long"))
    pairs = {"a": a, "larger": S.r_max(a, b), "smaller": S.r_min(a, b), "size": S.r_abs(a), "cube": S.r_pow(small, 3)}
    return rows.select("id", *[x.alias(f"{n}_{p}") for n, two in pairs.items() for p, x in zip(("num", "den"), two, strict=True)], S.r_less(a, b).alias("less"), S.r_equal(a, a).alias("same"))


_A = "(r - 100)::hugeint * 18014398509481984 + 1"
_B = "(r % 11 - 5)::hugeint * 288230376151711744"
add("rational_large", rationals, f"""with p as (select r as id, {_A} as x, {_B} as y, (r % 3 + 1)::hugeint as z, r % 9 - 4 as s, r % 4 + 2 as t from range(200) t(r)),
n as (select *, case when x % 7 = 0 then 7 else 1 end as g, gcd(z, abs(y))::hugeint as h, gcd(abs(s * s * s), t * t * t) as e from p),
q as (select *, x // g as an, 7 // g as ad, case when y < 0 then -(abs(y) // greatest(h, 1)) else y // greatest(h, 1) end as bn, z // greatest(h, 1) as bd from n),
l as (select *, an * bd < bn * ad as less from q)
select id, an::bigint as a_num, ad::bigint as a_den, case when less then bn else an end::bigint as larger_num, case when less then bd else ad end::bigint as larger_den,
case when bn * ad < an * bd then bn else an end::bigint as smaller_num, case when bn * ad < an * bd then bd else ad end::bigint as smaller_den, abs(an)::bigint as size_num, ad::bigint as size_den,
(sign(s) * (abs(s * s * s) // greatest(e, 1)))::bigint as cube_num, (t * t * t // greatest(e, 1))::bigint as cube_den, less, true as same from l""")
_PAIR = lambda s: s.range(1, 60).select("id", (U("id") - 30).cast("double").alias("x"), (U("id") % 7 - 3).cast("double").alias("y"))
_PS = "p as (select r as id, (r - 30)::double as x, (r % 7 - 3)::double as y from range(1, 60) t(r))"
add("cube_roots", lambda s, d: _PAIR(s).select("id", *[(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in zip(("c_re", "c_im", "d_val", "d_eps", "m_val", "m_eps", "norm"), (*S.c_cbrt((U("x"), U("y"))), *S.d_cbrt((U("x"), U("y"))), *S.d_max((U("x"), U("y")), (U("y"), U("x"))), S.c_norm((U("x"), U("y")))), strict=True)]), f"with {_PS} select id, round(pow(x * x + y * y, 1 / 6e0) * cos(atan2(y, x) / 3), 9) + 0e0 as c_re, round(pow(x * x + y * y, 1 / 6e0) * sin(atan2(y, x) / 3), 9) + 0e0 as c_im, round(cbrt(x), 9) + 0e0 as d_val, case when x <> 0 then round(y / (3 * pow(abs(x), 2 / 3e0)), 9) + 0e0 end as d_eps, round(greatest(x, y), 9) + 0e0 as m_val, round(case when x >= y then y else x end, 9) + 0e0 as m_eps, x * x + y * y as norm from p")

# -- integrators --------------------------------------------------------------------------------------------------------

add("ode_constant", lambda s, d: ode.step(cube(s, d, 8).select(*AXES, "u"), lambda t, y: y.select(*AXES, (-U("u")).alias("u")), 0.25, "constant", list(AXES), ["u"]), f"with {cube_sql(8, 'b')} select i, j, k, u from b")
add("ode_implicit_euler", lambda s, d: ode.implicit_euler(cube(s, d, 8).select(*AXES, "u"), lambda y, h: y.select(*AXES, F.round(U("u") / F.lit(1 + h), 9).alias("u")), 0.25), f"with {cube_sql(8, 'b')} select i, j, k, round(u / 1.25e0, 9) as u from b")
