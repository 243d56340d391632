"""Queries of initial data, refluxing, levels and boxes, checkpoints and output, and of tensors and vectors."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from latticeql.functions import scalar as S
from latticeql.operators import control, grid, resample
from latticeql.operators.grid import AXES
from latticeql.operators.lineage import shared
from latticeql.plans.grid_queries import TWO, two_levels
from latticeql.plans.views import cube, cube_sql, particles
from latticeql.sources import tsv

QUERIES: dict = {}
SQL: dict = {}
N = 16
U = F.col
TWO_PI = 6.283185307179586


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# -- initial data -------------------------------------------------------------------------------------------------------


def initial(s, d):
    """At time 1/8 on the vertices of an 8^3 grid: constant, linear, plane, standing, Gaussian and noise of a whole-numbered hash."""
    x, t = [U(a) / F.lit(8.0) for a in AXES], F.lit(0.125)
    phase = x[0] + F.lit(2.0) * x[1] - x[2]
    plane = F.cos(F.lit(TWO_PI) * (phase - F.sqrt(F.lit(6.0)) * t))
    standing = F.cos(F.lit(TWO_PI) * F.sqrt(F.lit(3.0)) * t)
    for c in x:
        standing = standing * F.cos(F.lit(TWO_PI) * c)
    away = sum(((c - F.lit(0.5)) * (c - F.lit(0.5)) for c in x), F.lit(0.0))
    noise = ((U("i") * 7919 + U("j") * 104729 + U("k") * 1299709) % 1009) / F.lit(1009.0) - F.lit(0.5)
    return grid.points(s, 8).select(*AXES, F.lit(1.0).alias("constant"), (phase + t).alias("linear"), F.round(plane, 9).alias("plane"), F.round(standing, 9).alias("standing"), F.round(F.exp(-away / F.lit(0.02)), 9).alias("gaussian"), F.round(noise, 9).alias("noise"))


_P = "p as (select (r % 8)::int as i, ((r // 8) % 8)::int as j, (r // 64)::int as k, (r % 8) / 8e0 as x, ((r // 8) % 8) / 8e0 as y, (r // 64) / 8e0 as z from range(512) t(r))"
add("initial_data", initial, f"with {_P} select i, j, k, 1e0 as constant, x + 2 * y - z + 0.125e0 as linear, round(cos({TWO_PI} * (x + 2 * y - z - sqrt(6e0) * 0.125e0)), 9) as plane, round(cos({TWO_PI} * sqrt(3e0) * 0.125e0) * cos({TWO_PI} * x) * cos({TWO_PI} * y) * cos({TWO_PI} * z), 9) as standing, round(exp(-(pow(x - 0.5, 2) + pow(y - 0.5, 2) + pow(z - 0.5, 2)) / 0.02e0), 9) as gaussian, round(((i * 7919 + j * 104729 + k * 1299709) % 1009) / 1009e0 - 0.5e0, 9) as noise from p")


def divergence(s, d):
    """Of (u, v, u + v) on faces: differences along all three axes, from one shuffle."""
    near = grid.shifted_several(cube(s, d), {"ui": ("u", (1, 0, 0)), "vj": ("v", (0, 1, 0)), "uk": ("u", (0, 0, 1)), "vk": ("v", (0, 0, 1))}).filter("ui is not null and vj is not null and uk is not null")
    return near.select(*AXES, (((U("ui") - U("u")) + (U("vj") - U("v")) + (U("uk") + U("vk") - U("u") - U("v"))) * F.lit(16.0)).alias("value"))


add("staggered_divergence_3d", divergence, f"with {cube_sql()} select c.i, c.j, c.k, (x.u - c.u + y.v - c.v + z.u + z.v - c.u - c.v) * 16e0 as value from c join c x on x.i = c.i + 1 and x.j = c.j and x.k = c.k join c y on y.i = c.i and y.j = c.j + 1 and y.k = c.k join c z on z.i = c.i and z.j = c.j and z.k = c.k + 1")

# -- levels -------------------------------------------------------------------------------------------------------------

_INSIDE = "{a} between 2 and 5 and j between 2 and 5 and k between 2 and 5"


def refluxed(s, d, axis):
    flux = lambda n: cube(s, d, n).select(*AXES, U("u").alias("flux"))
    cells = cube(s, d, 8).select(*AXES, "v")
    covered = cells.filter(grid.in_box((2, 2, 2), (5, 5, 5))).select(*AXES)
    return resample.refluxed(cells, covered, flux(8), flux(16), axis, 0.5, "v")


for _a in AXES:
    _rest = [x for x in AXES if x != _a]
    _in = " and ".join(f"b.{x} between 2 and 5" for x in _rest)
    _join = lambda t, o, a=_a: " and ".join(f"{t}.{x} = b.{x}{o if x == a else ''}" for x in AXES)
    add(f"reflux_cells_{_a}", lambda s, d, a=_a: refluxed(s, d, a), f"with {cube_sql(8, 'b')}, {cube_sql(16, 'c')}, f as (select (i // 2)::int as i, (j // 2)::int as j, (k // 2)::int as k, sum(u) / 4e0 as u from c where {_a} % 2 = 0 group by 1, 2, 3), g as (select b.i, b.j, b.k, f.u - b.u as x from b join f using (i, j, k)) select b.i, b.j, b.k, b.v + case when {_in} and b.{_a} = 1 then -0.5e0 * up.x when {_in} and b.{_a} = 6 then 0.5e0 * here.x else 0 end as v from b left join g up on {_join('up', ' + 1')} left join g here on {_join('here', '')}")


def blocks(s, ranges):
    return s.createDataFrame([(i, j, k) for i in range(*ranges[0]) for j in range(*ranges[1]) for k in range(*ranges[2])], "bi int, bj int, bk int")


ONE = {0: Fraction(1)}
add("new_level", lambda s, d: resample.new_level(cube(s, d, 8).select(*AXES, "u"), blocks(s, ((0, 2), (1, 3), (2, 4))), "u", ONE, ONE, 4), f"with {cube_sql(8, 'b')} select (2 * b.i + x.o)::int as i, (2 * b.j + y.o)::int as j, (2 * b.k + z.o)::int as k, b.u from b, (values (0), (1)) x(o), (values (0), (1)) y(o), (values (0), (1)) z(o) where b.i < 4 and b.j between 2 and 5 and b.k between 4 and 7")
add("remake_level_blocks", lambda s, d: resample.remake_level(two_levels(s, d)[1], cube(s, d, 8).select(*AXES, "u"), blocks(s, ((0, 3), (1, 3), (1, 4))), "u", ONE, ONE, 4), f"with {TWO} select coalesce(f.i, n.i) as i, coalesce(f.j, n.j) as j, coalesce(f.k, n.k) as k, coalesce(f.u, n.u) as u from (select (2 * b.i + x.o)::int as i, (2 * b.j + y.o)::int as j, (2 * b.k + z.o)::int as k, b.u from b, (values (0), (1)) x(o), (values (0), (1)) y(o), (values (0), (1)) z(o) where b.i < 6 and b.j between 2 and 5 and b.k between 2 and 7) n left join f using (i, j, k)")
add("clear_level", lambda s, d: resample.clear_level(two_levels(s, d)[0].withColumn("level", F.lit(0)).unionByName(two_levels(s, d)[1].withColumn("level", F.lit(1))), 1).select("level", *AXES, "u"), f"with {TWO} select 0 as level, i, j, k, u from x")
add("regrid_boxes", lambda s, d: grid.boxes(cube(s, d), "u", 200.0, 2, 3), f"""with {cube_sql()}, t as (select i // 2 as a, j // 2 as b, k // 2 as c, count(*) as tagged from c where u >= 200 group by 1, 2, 3),
r as (select *, a - row_number() over (partition by b, c order by a) as run from t), p as (select *, (a - min(a) over (partition by b, c, run)) // 3 as part from r)
select (2 * min(a))::int as lo_i, (2 * max(a) + 1)::int as hi_i, (2 * b)::int as lo_j, (2 * b + 1)::int as hi_j, (2 * c)::int as lo_k, (2 * c + 1)::int as hi_k, sum(tagged)::bigint as tagged, sum(tagged) / ((max(a) - min(a) + 1) * 8e0) as efficiency from p group by b, c, run, part""")


def nested(s, d):
    """Levels of blocks about a corner, each within half the radius of the one before, until none is left."""

    def refine(levels):
        n, radius = 4 * 2 ** len(levels), 0.7 / 2 ** (len(levels) - 1)
        far = sum(((U(f"b{a}") + F.lit(0.5)) * (U(f"b{a}") + F.lit(0.5)) for a in AXES), F.lit(0.0)) / F.lit(float(n * n))
        inside = levels[-1].select(*[F.explode(F.array(2 * U("bi"), 2 * U("bi") + 1)).alias("bi"), "bj", "bk"])
        for a in ("j", "k"):
            inside = inside.select(*[F.explode(F.array(2 * U(f"b{a}"), 2 * U(f"b{a}") + 1)).alias(f"b{x}") if x == a else f"b{x}" for x in AXES])
        return inside.filter(far <= F.lit(radius * radius))

    levels = control.regrid(blocks(s, ((0, 4),) * 3), refine, 3)
    out = levels[0].select(F.lit(0).alias("level"), "bi", "bj", "bk")
    for n, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.select(F.lit(n).alias("level"), "bi", "bj", "bk"))
    return out.groupBy("level").agg(F.count("*").alias("blocks"))


add("regrid_loop", nested, "with b as (select r % 16 as i, (r // 16) % 16 as j, r // 256 as k from range(4096) t(r)) select 0 as level, 64::bigint as blocks union all select 1, count(*) from b where i < 8 and j < 8 and k < 8 and (pow(i + 0.5, 2) + pow(j + 0.5, 2) + pow(k + 0.5, 2)) / 64e0 <= 0.7e0 * 0.7e0 union all select 2, count(*) from b where (pow(i + 0.5, 2) + pow(j + 0.5, 2) + pow(k + 0.5, 2)) / 256e0 <= 0.35e0 * 0.35e0 and (pow(i // 2 + 0.5, 2) + pow(j // 2 + 0.5, 2) + pow(k // 2 + 0.5, 2)) / 64e0 <= 0.7e0 * 0.7e0")

# -- output and recovery ------------------------------------------------------------------------------------------------


def checkpointed(s, d):
    """A grid through two checkpoints, one written twice; the last is recovered with its document."""
    at, c = shared(s, "checkpoints"), cube(s, d).select(*AXES, "u")
    wrote = [tsv.write_checkpoint({"grid": c}, at, 4, {"dtfac": 0.5}, {"levels": 1}), tsv.write_checkpoint({"grid": c}, at, 4)]
    wrote.append(tsv.write_checkpoint({"grid": c.withColumn("u", U("u") + 1)}, at, 8, {"dtfac": 0.25}, {"levels": 2}))
    said = tsv.recovered(s, at)
    return tsv.recover(s, at, None, "grid").groupBy("k").agg(F.sum("u").alias("u")).select("k", "u", F.lit(said["iteration"]).alias("iteration"), F.lit(said["epoch"]).alias("epoch"), F.lit(said["parameters"]["dtfac"]).alias("dtfac"), F.lit(said["structure"]["levels"]).alias("levels"), F.lit(sum(wrote)).alias("written"))


add("checkpoint_recover", checkpointed, f"with {cube_sql()} select k, sum(u + 1) as u, 8 as iteration, 1 as epoch, 0.25e0 as dtfac, 2 as levels, 2 as written from c group by k")


def scalars(s, d):
    """Scalars of three iterations, real, whole and complex, through a file."""
    at = shared(s, "scalars")
    rows = s.range(3).select(U("id").cast("int").alias("iteration"), (U("id") * F.lit(0.5)).alias("time"), (U("id") + F.lit(42.0)).alias("sc"), (U("id") + 17).cast("int").alias("sc_int"), F.struct((U("id") + F.lit(0.25)).alias("real"), (-U("id")).cast("double").alias("imag")).alias("sc_complex"))
    tsv.write_tsv(rows, at)
    return tsv.read_tsv(s, at, {"iteration": "int", "sc_int": "int"}).toDF("iteration", "time", "sc", "sc_int", "sc_complex_real", "sc_complex_imag")


add("scalar_rows", scalars, "select r::int as iteration, r * 0.5e0 as time, r + 42e0 as sc, (r + 17)::int as sc_int, r + 0.25e0 as sc_complex_real, (-r)::double as sc_complex_imag from range(3) t(r)")


def arrays(s, d):
    """The lines of a 7 x 6 x 5 array along each of its axes, the other indices 0, through files."""
    r, out = U("id"), None
    rows = s.range(210).select((r % 7).cast("int").alias("i"), (F.floor(r / 7) % 6).cast("int").alias("j"), F.floor(r / 42).cast("int").alias("k"), (r * F.lit(0.5)).alias("a3"))
    for a in AXES:
        at = shared(s, "array-line")
        tsv.write_tsv(grid.line(rows, a, 0), at)
        line = tsv.read_tsv(s, at, dict.fromkeys(AXES, "int")).select(F.lit(a).alias("axis"), *AXES, "a3")
        out = line if out is None else out.unionByName(line)
    return out


add("array_lines", arrays, "with p as (select (r % 7)::int as i, ((r // 7) % 6)::int as j, (r // 42)::int as k, r * 0.5e0 as a3 from range(210) t(r)) select 'i' as axis, * from p where j = 0 and k = 0 union all select 'j', * from p where i = 0 and k = 0 union all select 'k', * from p where i = 0 and j = 0")

# -- tensors and vectors ------------------------------------------------------------------------------------------------


def tensors(s, d):
    """Sums over a matrix m of the first nine components and the vector x of the first three: m m, x m x, and the rank 3 product."""
    e = [U("e")[n] for n in range(9)]
    m, x = [[e[3 * r + c] for c in range(3)] for r in range(3)], e[:3]
    square = S.einsum("ij,jk->ik", m, m)
    ten = S.einsum("ij,k->ijk", m, x)
    turned = S.einsum("ijk,jk->i", ten, m)
    return particles(s, d).select("id", F.round(square[0][2], 6).alias("mm02"), F.round(square[2][1], 6).alias("mm21"), F.round(S.einsum("i,ij,j->", x, m, x), 6).alias("xmx"), F.round(turned[1], 6).alias("turned1"))


_e = lambda n: f"embedding[{n + 1}]::double"
_m = lambda r, c: _e(3 * r + c)
add("einstein_sums", tensors, f"select vec_id as id, round({' + '.join(f'{_m(0, j)} * {_m(j, 2)}' for j in range(3))}, 6) as mm02, round({' + '.join(f'{_m(2, j)} * {_m(j, 1)}' for j in range(3))}, 6) as mm21, round({' + '.join(f'{_e(i)} * {_m(i, j)} * {_e(j)}' for i in range(3) for j in range(3))}, 6) as xmx, round({' + '.join(f'{_m(1, j)} * {_e(k)} * {_m(j, k)}' for j in range(3) for k in range(3))}, 6) as turned1 from embeddings")


def vectors(s, d):
    a, b = (F.array(*[((U("id") * (n + 2) + m) % 7).cast("int") for n in range(4)]) for m in (1, 3))
    rows = s.range(60).select("id", a.alias("a"), b.alias("b"))
    zipped = lambda f: F.zip_with("a", "b", f)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    maps = {"both": zipped(lambda x, y: x.bitwiseAND(y)), "either": zipped(lambda x, y: x.bitwiseOR(y)), "differ": zipped(lambda x, y: x.bitwiseXOR(y)), "less": zipped(lambda x, y: (x < y).cast("int")), "equal": zipped(lambda x, y: (x == y).cast("int")), "and_": zipped(lambda x, y: ((x > 2) & (y > 2)).cast("int")), "reversed": F.reverse("a"), "pure": F.array_repeat(F.lit(3), 4), "iota": F.sequence(F.lit(0), F.lit(3)), "unit": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: (n == U("id") % 4).cast("int")), "largest": zipped(lambda x, y: F.greatest(x, y))}
    return rows.select("id", *[text(c).alias(n) for n, c in maps.items()])


_Z = lambda e: f"array_to_string(list_transform(range(1, 5), lambda n: {e}), ',')"
add("vect_maps", vectors, "with p as (select r as id, [((r * n + 1) % 7)::int for n in range(2, 6)] as a, [((r * n + 3) % 7)::int for n in range(2, 6)] as b from range(60) t(r)) select id, " + ", ".join(f"{_Z(e)} as {n}" for n, e in {"both": "a[n] & b[n]", "either": "a[n] | b[n]", "differ": "xor(a[n], b[n])", "less": "(a[n] < b[n])::int", "equal": "(a[n] = b[n])::int", "and_": "(a[n] > 2 and b[n] > 2)::int", "reversed": "a[5 - n]", "pure": "3", "iota": "n - 1", "unit": "(n - 1 = id % 4)::int", "largest": "greatest(a[n], b[n])"}.items()) + " from p")


def three_equations(s, d):
    """x + y + z = 6 c, x y = 2 c^2, z^2 = 9 c^2, with the root (c, 2c, 3c) near the start."""
    c = U("id").cast("double")
    f = lambda x: [x[0] + x[1] + x[2] - F.lit(6.0) * c, x[0] * x[1] - F.lit(2.0) * c * c, x[2] * x[2] - F.lit(9.0) * c * c]
    one, zero = F.lit(1.0), F.lit(0.0)
    jacobian = lambda x: [[one, one, one], [x[1], x[0], zero], [zero, zero, F.lit(2.0) * x[2]]]
    found = S.newton_n(f, jacobian, [c * 0.9, c * 2.2, c * 2.9], 12)
    return s.range(1, 31).select("id", *[F.round(x, 8).alias(n) for x, n in zip(found, "xyz", strict=True)])


add("newton_three", three_equations, "select r as id, r::double as x, 2e0 * r as y, 3e0 * r as z from range(1, 31) t(r)")
