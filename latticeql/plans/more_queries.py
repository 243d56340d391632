"""Further queries: high-order integrators, mixed centrings, collocation elements, solvers, root finders and number algebra."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from latticeql.functions import scalar as S
from latticeql.functions import weights as W
from latticeql.operators import ode, resample, sparse
from latticeql.operators.grid import AXES, normal, region
from latticeql.plans.views import cube, cube_sql, particles

QUERIES: dict = {}
SQL: dict = {}
U = F.col


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# -- integrators --------------------------------------------------------------------------------------------------------

RATE, STEPS = 1 / 64, 4


def decayed(s, d, method):
    """Four steps of y' = -y from the particles' x, each without a shuffle."""
    df = particles(s, d).select("id", U("x").alias("value"))
    for n in range(STEPS):
        df = ode.pointwise_step(df, lambda t, y: {"value": -y["value"]}, RATE, method, ["value"], n * RATE)
    return df.select("id", F.round("value", 9).alias("value"))


for _m in ("rkf78", "dp87"):
    add(f"ode_{_m}", lambda s, d, m=_m: decayed(s, d, m), f"select vec_id as id, round(embedding[1]::double * exp({-RATE * STEPS!r}::double), 9) as value from embeddings")
add("ode_oscillator_dp87", lambda s, d: ode.pointwise_step(particles(s, d).select("id", "x", "y"), lambda t, u: {"x": u["y"], "y": -u["x"]}, 0.0625, "dp87", ["x", "y"]).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y")), "select vec_id as id, round(embedding[1]::double * cos(0.0625e0) + embedding[2]::double * sin(0.0625e0), 9) as x, round(embedding[2]::double * cos(0.0625e0) - embedding[1]::double * sin(0.0625e0), 9) as y from embeddings")

# -- mixed centrings ----------------------------------------------------------------------------------------------------

VERTEX = {p: ({0: Fraction(1)}, W.between(p + 1)) for p in (1, 3, 5, 7)}


def family(name: str, p: int, centring: str) -> list:
    """Pairs of rows by axis. Vertex axes (v) interpolate; cell axes (c) are conservative, of the same order (natural) or of one
    less (ddf)."""
    cell = resample.children(W.average_left(p - (name == "ddf")))
    return [VERTEX[p] if c == "v" else cell for c in centring]


def prolong_sql(rows: list, n: int) -> str:
    parts = []
    for off in range(8):
        o = (off >> 2 & 1, off >> 1 & 1, off & 1)
        weights, den = W.whole(W.product(*[pair[x] for pair, x in zip(rows, o, strict=True)]))
        values = ", ".join(f"({a}, {b}, {c}, {w}e0)" for (a, b, c), w in weights.items())
        parts.append(f"select (2 * b.i + {o[0]})::int as i, (2 * b.j + {o[1]})::int as j, (2 * b.k + {o[2]})::int as k, sum(w.w * o.u) / {den}e0 as value from b, (values {values}) w(di, dj, dk, w) join b o on o.i = b.i + w.di and o.j = b.j + w.dj and o.k = b.k + w.dk group by b.i, b.j, b.k having count(*) = {len(weights)}")
    return f"with {cube_sql(n, 'b')} " + " union all ".join(parts)


MIXED = [(f, p, c, 8) for f in ("ddf", "natural") for p in (1, 3) for c in ("cvv", "ccv", "ccc")]
MIXED += [("ddf", 5, "vvc", 8), ("natural", 5, "vcv", 8), ("natural", 7, "vvv", 16), ("ddf", 7, "vvc", 16)]
for _f, _p, _c, _n in MIXED:
    add(f"prolong_{_f}_o{_p}_{_c}", lambda s, d, r=family(_f, _p, _c), n=_n: resample.prolongate_axes(cube(s, d, n), U("u"), r), prolong_sql(family(_f, _p, _c), _n))

# -- collocation elements -----------------------------------------------------------------------------------------------


def element(s, d, n):
    """Derivatives in elements of n Gauss-Lobatto nodes along i."""
    moves = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(w).alias("w")) for p, row in enumerate(W.collocation(n)) for q, w in enumerate(row)])
    sent = cube(s, d, 16 // n * n).withColumn("m", F.explode(F.filter(moves, lambda x: x["q"] == U("i") % n)))
    return sent.groupBy((U("i") - U("i") % n + U("m.p")).cast("int").alias("i"), "j", "k").agg(F.round(F.sum(U("m.w") * U("u")), 6).alias("value"))


for _n in (2, 3, 4, 8):
    _values = ", ".join(f"({p}, {q}, {w!r}::double)" for p, row in enumerate(W.collocation(_n)) for q, w in enumerate(row))
    add(f"dg_derivative_n{_n}", lambda s, d, n=_n: element(s, d, n), f"with {cube_sql(16 // _n * _n)} select c.i, c.j, c.k, round(sum(w.w * o.u), 6) as value from c join (values {_values}) w(p, q, w) on w.p = c.i % {_n} join c o on o.i = c.i - c.i % {_n} + w.q and o.j = c.j and o.k = c.k group by all")
    _nodes = ", ".join(f"({q}, {x!r}::double)" for q, x in enumerate(W.lobatto(_n)))
    add(f"dg_nodes_n{_n}", lambda s, d, n=_n: s.range(4 * n).select("id", F.round((F.floor(U("id") / n) + (F.element_at(F.array(*map(F.lit, W.lobatto(n))), (U("id") % n + 1).cast("int")) + F.lit(1.0)) / F.lit(2.0)) / F.lit(4.0), 9).alias("x")), f"select r as id, round((r // {_n} + (x + 1e0) / 2e0) / 4e0, 9) as x from range({4 * _n}) t(r) join (values {_nodes}) n(q, x) on q = r % {_n}")

# -- solvers ------------------------------------------------------------------------------------------------------------


def laplacian(s, n):
    """The matrix of -u'' on n inner points."""
    rows = s.range(n).select(U("id").alias("row"), F.explode(F.array(*[F.struct((U("id") + o).alias("col"), F.lit(w).alias("v")) for o, w in ((-1, -1.0), (0, 2.0), (1, -1.0))])).alias("e"))
    return rows.select("row", "e.col", "e.v").filter(U("col").between(0, n - 1))


def vector(s, n, value):
    return s.range(n).select(U("id").alias("idx"), value(U("id")).cast("double").alias("v"))


def poisson(s, d):
    a = laplacian(s, 8)
    wanted = vector(s, 8, lambda i: i % 3 + 1)
    return sparse.conjugate_gradient(a, sparse.times_vector(a, wanted), 8).select("idx", F.round("v", 6).alias("v"))


def nonlinear(s, d):
    """A x + x^3 = b for the b that has the solution (1, 2, 1, 2), from 2 everywhere."""
    a, start = laplacian(s, 4), vector(s, 4, lambda i: F.lit(2.0))
    wanted = vector(s, 4, lambda i: i % 2 + 1)
    right = sparse.add(sparse.times_vector(a, wanted), wanted.select("idx", (U("v") * U("v") * U("v")).alias("v")))
    return sparse.newton(a, right, start, lambda x: x * x * x, lambda x: F.lit(3.0) * x * x, 6, 4).select("idx", F.round("v", 6).alias("v"))


add("cg_poisson", poisson, "select r as idx, (r % 3 + 1)::double as v from range(8) t(r)")
add("newton_nonlinear", nonlinear, "select r as idx, (r % 2 + 1)::double as v from range(4) t(r)")

# -- root finders -------------------------------------------------------------------------------------------------------


def square(x):
    return x * x - U("id").cast("double")


def twice(x):
    return F.lit(2.0) * x


ROOTS = "select r as id, round(sqrt(r::double), 9) as root from range(1, 41) t(r)"
add("root_halley", lambda s, d: s.range(1, 41).select("id", F.round(S.halley(square, twice, lambda x: F.lit(2.0), F.lit(4.0), 10), 9).alias("root")), ROOTS)
add("root_schroder", lambda s, d: s.range(1, 41).select("id", F.round(S.schroder(square, twice, lambda x: F.lit(2.0), F.lit(4.0), 20), 9).alias("root")), ROOTS)
add("root_brent", lambda s, d: s.range(1, 41).select("id", F.round(S.brent(square, F.lit(0.0), F.lit(8.0), 60), 9).alias("root")), ROOTS)


def bracketed(s, d):
    ends = s.range(1, 41).select("id", F.array(*S.bracket(square, F.lit(1.0), 2.0, 12)).alias("e"))
    return ends.select("id", F.round(S.bisect(square, U("e")[0], U("e")[1], 60), 9).alias("root"))


add("root_bracket", bracketed, ROOTS)


def two_equations(s, d):
    a = U("id").cast("double")
    x, y = S.newton2(lambda x, y: (x * x - a, x * y - F.lit(2.0)), lambda x, y: (F.lit(2.0) * x, F.lit(0.0), y, x), F.lit(4.0), F.lit(1.0), 12)
    return s.range(1, 41).select("id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


add("root_newton_2d", two_equations, "select r as id, round(sqrt(r::double), 9) as x, round(2e0 / sqrt(r::double), 9) as y from range(1, 41) t(r)")

# -- numbers ------------------------------------------------------------------------------------------------------------


def numbers(s):
    return s.range(1, 201).select("id", ((U("id") % 13 - 6) / F.lit(4.0)).alias("a"), ((U("id") % 7 + 1) / F.lit(4.0)).alias("b"))


_NUMBERS = "p as (select r as id, (r % 13 - 6) / 4e0 as a, (r % 7 + 1) / 4e0 as b from range(1, 201) t(r))"


def rounded(pairs: dict) -> list:
    """Named columns of rounded values, without negative zeros."""
    return [(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in pairs.items()]


def rounded_sql(pairs: dict) -> str:
    return f"with {_NUMBERS} select id, " + ", ".join(f"round({e}, 9) + 0e0 as {n}" for n, e in pairs.items()) + " from p"


def complex_more(s, d):
    z = (U("a"), U("b"))
    (pr, pi), (ir, ii), (sr, si), (cr, ci) = S.c_pow(z, 3), S.c_pow(z, -1), S.c_sin(z), S.c_cos(z)
    qr, qi = S.c_mul(S.c_sqrt(z), S.c_sqrt(z))
    return numbers(s).select("id", *rounded({"pow_re": pr, "pow_im": pi, "inv_re": ir, "inv_im": ii, "sin_re": sr, "sin_im": si, "cos_re": cr, "cos_im": ci, "root2_re": qr, "root2_im": qi, "conj_im": -z[1]}))


add("complex_functions", complex_more, rounded_sql({"pow_re": "a * a * a - 3 * a * b * b", "pow_im": "3 * a * a * b - b * b * b", "inv_re": "a / (a * a + b * b)", "inv_im": "-b / (a * a + b * b)", "sin_re": "sin(a) * (exp(b) + exp(-b)) / 2", "sin_im": "cos(a) * (exp(b) - exp(-b)) / 2", "cos_re": "cos(a) * (exp(b) + exp(-b)) / 2", "cos_im": "-sin(a) * (exp(b) - exp(-b)) / 2", "root2_re": "a", "root2_im": "b", "conj_im": "-b"}))


def dual_more(s, d):
    x = (U("a"), U("b"))
    pairs = {"exp": S.d_exp(x), "sin": S.d_sin(x), "cos": S.d_cos(x), "pow": S.d_pow(x, 3), "abs": S.d_abs(x)}
    return numbers(s).select("id", *rounded({f"{n}_{k}": c for n, p in pairs.items() for k, c in zip(("val", "eps"), p, strict=True)}))


add("dual_functions", dual_more, rounded_sql({"exp_val": "exp(a)", "exp_eps": "b * exp(a)", "sin_val": "sin(a)", "sin_eps": "b * cos(a)", "cos_val": "cos(a)", "cos_eps": "-b * sin(a)", "pow_val": "a * a * a", "pow_eps": "3 * a * a * b", "abs_val": "abs(a)", "abs_eps": "case when a < 0 then -b else b end"}))


def rational_more(s, d):
    n, one = U("id"), F.lit(1).cast("long")
    x, y = (n, n + one), (one, F.lit(6).cast("long"))
    pairs = {"sum": S.r_add(x, y), "product": S.r_mul(x, y), "quotient": S.r_div(x, y)}
    columns = [c.alias(f"{k}_{e}") for k, p in pairs.items() for e, c in zip(("num", "den"), p, strict=True)]
    return s.range(1, 201).select("id", *columns, S.r_less(y, x).alias("more"))


_RATIONAL = {"sum": ("r * 6 + r + 1", "(r + 1) * 6"), "product": ("r", "(r + 1) * 6"), "quotient": ("r * 6", "r + 1")}
add("rational_arithmetic", rational_more, "select r as id, " + ", ".join(f"(({a}) // gcd({a}, {b}))::bigint as {n}_num, (({b}) // gcd({a}, {b}))::bigint as {n}_den" for n, (a, b) in _RATIONAL.items()) + ", r + 1 < 6 * r as more from range(1, 201) t(r)")


def lanes(s, d):
    a, b = U("a"), U("b")
    pi = F.lit(3.141592653589793)
    return numbers(s).select("id", *rounded({"hypot": F.hypot(a, b), "cbrt": F.cbrt(a), "copysign": F.when(a < 0, -F.abs(b)).otherwise(F.abs(b)), "cospi": F.cos(pi * a), "sinpi": F.sin(pi * a), "inv": F.lit(1.0) / b, "muladd": a * b + a, "negmuladd": -(a * b + a), "mulsub": a * b - a, "tan": F.tan(b / F.lit(2.0))}), F.coalesce(F.isnan(a), F.lit(True)).alias("is_nan"), (F.signum(a) < 0).alias("signbit"))


_LANES = rounded_sql({"hypot": "sqrt(a * a + b * b)", "cbrt": "cbrt(a)", "copysign": "case when a < 0 then -abs(b) else abs(b) end", "cospi": "cos(3.141592653589793e0 * a)", "sinpi": "sin(3.141592653589793e0 * a)", "inv": "1e0 / b", "muladd": "a * b + a", "negmuladd": "-(a * b + a)", "mulsub": "a * b - a", "tan": "tan(b / 2e0)"})
add("lane_functions", lanes, _LANES.replace(" from p", ", isnan(a) as is_nan, a < 0 as signbit from p"))


def small_vectors(s, d):
    e = U("e")
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + f(x))
    return particles(s, d).select("id", F.round(total(lambda x: x), 6).alias("total"), F.round(total(F.abs), 6).alias("sumabs"), F.round(F.aggregate(F.slice(e, 1, 3), F.lit(1.0), lambda acc, x: acc * x), 6).alias("prod"), F.reverse(e)[0].alias("last"), F.forall(e, lambda x: ~F.isnan(x)).alias("finite"), (F.slice(e, 1, 3) < F.slice(e, 4, 3)).alias("before"), F.round(F.zip_with(F.slice(e, 1, 3), F.slice(e, 4, 3), lambda x, y: x - y)[2], 6).alias("difference"))


_V = [f"embedding[{n}]::double" for n in range(1, 10)]
add("small_vector_ops", small_vectors, f"select vec_id as id, round({' + '.join(_V)}, 6) as total, round({' + '.join(f'abs({v})' for v in _V)}, 6) as sumabs, round({_V[0]} * {_V[1]} * {_V[2]}, 6) as prod, {_V[8]} as last, true as finite, [{', '.join(_V[:3])}] < [{', '.join(_V[3:6])}] as before, round({_V[2]} - {_V[5]}, 6) as difference from embeddings")


def sparse_folds(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((U("l_suppkey") % 40).alias("idx"), U("l_quantity").alias("v"))
    return rows.agg(F.countDistinct("idx").alias("entries"), F.sum("v").alias("total"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


add("sparse_vector_folds", sparse_folds, "select count(distinct l_suppkey % 40) as entries, sum(l_quantity) as total, min(l_quantity) as minimum, max(l_quantity) as maximum from lineitem")

# -- regions ------------------------------------------------------------------------------------------------------------


def there(s, d):
    """Interior, faces, edges and corners with their numbers of points and sums, for two layers."""
    faces = sum((F.abs(normal(a, 16, 2)) for a in AXES), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("interior", "face", "edge", "corner"))), (faces + 1).cast("int"))
    return cube(s, d).groupBy(kind.alias("kind"), region(16, 2).alias("region")).agg(F.count("*").alias("n"), F.sum("u").alias("u"))


_FACES = " + ".join(f"(not {a} between 2 and 13)::int" for a in AXES)
add("loop_there", there, f"with {cube_sql()}, q as (select u, {_FACES} as f from c) select ['interior', 'face', 'edge', 'corner'][f + 1] as kind, case when f = 0 then 'int' else 'bnd' end as region, count(*) as n, sum(u) as u from q group by f")
