"""Time integrators by the method of lines: a state is a DataFrame, a right-hand side maps a state to a state, and a stage is a linear
combination of states. Explicit methods are given by their tableau alone."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction as Q

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.operators.lineage import cut

#: Rows of coefficients of each stage's earlier stages, and weights of the stages.
TABLEAUS = {
    "constant": ([[]], [Q(0)]),
    "euler": ([[]], [Q(1)]),
    "rk2": ([[], [Q(1, 2)]], [Q(0), Q(1)]),
    "rk3": ([[], [Q(1, 2)], [Q(-1), Q(2)]], [Q(1, 6), Q(2, 3), Q(1, 6)]),
    "ssprk3": ([[], [Q(1)], [Q(1, 4), Q(1, 4)]], [Q(1, 6), Q(1, 6), Q(2, 3)]),
    # The published tableau of Fehlberg's 7(8) method, its order-7 weights.
    "rkf78": (
        [
            [],
            [Q(2, 27)],
            [Q(1, 36), Q(1, 12)],
            [Q(1, 24), 0, Q(1, 8)],
            [Q(5, 12), 0, Q(-25, 16), Q(25, 16)],
            [Q(1, 20), 0, 0, Q(1, 4), Q(1, 5)],
            [Q(-25, 108), 0, 0, Q(125, 108), Q(-65, 27), Q(125, 54)],
            [Q(31, 300), 0, 0, 0, Q(61, 225), Q(-2, 9), Q(13, 900)],
            [Q(2), 0, 0, Q(-53, 6), Q(704, 45), Q(-107, 9), Q(67, 90), Q(3)],
            [Q(-91, 108), 0, 0, Q(23, 108), Q(-976, 135), Q(311, 54), Q(-19, 60), Q(17, 6), Q(-1, 12)],
            [Q(2383, 4100), 0, 0, Q(-341, 164), Q(4496, 1025), Q(-301, 82), Q(2133, 4100), Q(45, 82), Q(45, 164), Q(18, 41)],
        ],
        [Q(41, 840), 0, 0, 0, 0, Q(34, 105), Q(9, 35), Q(9, 35), Q(9, 280), Q(9, 280), Q(41, 840)],
    ),
    # The published tableau of Prince and Dormand's 8(7) method of 13 stages, its order-8 weights.
    "dp87": (
        [
            [],
            [Q(1, 18)],
            [Q(1, 48), Q(1, 16)],
            [Q(1, 32), 0, Q(3, 32)],
            [Q(5, 16), 0, Q(-75, 64), Q(75, 64)],
            [Q(3, 80), 0, 0, Q(3, 16), Q(3, 20)],
            [Q(29443841, 614563906), 0, 0, Q(77736538, 692538347), Q(-28693883, 1125000000), Q(23124283, 1800000000)],
            [Q(16016141, 946692911), 0, 0, Q(61564180, 158732637), Q(22789713, 633445777), Q(545815736, 2771057229), Q(-180193667, 1043307555)],
            [Q(39632708, 573591083), 0, 0, Q(-433636366, 683701615), Q(-421739975, 2616292301), Q(100302831, 723423059), Q(790204164, 839813087), Q(800635310, 3783071287)],
            [Q(246121993, 1340847787), 0, 0, Q(-37695042795, 15268766246), Q(-309121744, 1061227803), Q(-12992083, 490766935), Q(6005943493, 2108947869), Q(393006217, 1396673457), Q(123872331, 1001029789)],
            [Q(-1028468189, 846180014), 0, 0, Q(8478235783, 508512852), Q(1311729495, 1432422823), Q(-10304129995, 1701304382), Q(-48777925059, 3047939560), Q(15336726248, 1032824649), Q(-45442868181, 3398467696), Q(3065993473, 597172653)],
            [Q(185892177, 718116043), 0, 0, Q(-3185094517, 667107341), Q(-477755414, 1098053517), Q(-703635378, 230739211), Q(5731566787, 1027545527), Q(5232866602, 850066563), Q(-4093664535, 808688257), Q(3962137247, 1805957418), Q(65686358, 487910083)],
            [Q(403863854, 491063109), 0, 0, Q(-5068492393, 434740067), Q(-411421997, 543043805), Q(652783627, 914296604), Q(11173962825, 925320556), Q(-13158990841, 6184727034), Q(3936647629, 1978049680), Q(-160528059, 685178525), Q(248638103, 1413531060), 0],
        ],
        [Q(14005451, 335480064), 0, 0, 0, 0, Q(-59238493, 1068277825), Q(181606767, 758867731), Q(561292985, 797845732), Q(-1041891430, 1371343529), Q(760417239, 1151165299), Q(118820643, 751138087), Q(-528747749, 2220607170), Q(1, 4)],
    ),
    "rk4": ([[], [Q(1, 2)], [Q(0), Q(1, 2)], [Q(0), Q(0), Q(1)]], [Q(1, 6), Q(1, 3), Q(1, 3), Q(1, 6)]),
}


def lincomb(terms: list, keys: list, values: list) -> DataFrame:
    """Sum of factor * state over (factor, state); terms with factor 0 are dropped. One union and one aggregation."""
    parts = [s.select(*keys, *[(F.lit(float(c)) * F.col(v)).alias(v) for v in values]) for c, s in terms if c]
    if not parts:
        raise ValueError("no term is left")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def step(state: DataFrame, rhs: Callable, h: float, method: str, keys: list, values: list, t: float = 0.0) -> DataFrame:
    """A step of a method; rhs(t, state) gives the state's derivative. Stages are columns of one wide row a point: a stage costs its
    right-hand side and a join of the slopes, and lineage is cut between stages, so a plan holds one stage whatever the tableau."""
    rows, weights = TABLEAUS[method]
    wide, known = state.select(*keys, *values), []

    def moved(row: list) -> list:
        """The values plus h times the sum of known slopes."""
        return [sum((F.lit(h * float(a)) * F.col(f"k{n}_{v}_") for n, a in enumerate(row) if a), F.col(v)).alias(v) for v in values]

    for n, row in enumerate(rows):
        if not any(weights[n:]) and not any(len(later) > n and later[n] for later in rows):
            continue
        if n:
            wide = cut(wide)
        slope = rhs(t + h * float(sum(row)), wide.select(*keys, *moved(row)))
        slope = slope.select(*keys, *[F.col(v).alias(f"k{n}_{v}_") for v in values])
        wide, known = wide.join(slope, keys), [*known, n]
    return wide.select(*keys, *moved(weights))


def implicit_euler(state: DataFrame, solve: Callable, h: float) -> DataFrame:
    """A step y1 = y0 + h f(y1): solve(y, h) gives it for the implicit part."""
    return solve(state, h)


def pointwise_step(df: DataFrame, rhs: Callable, h: float, method: str, values: list, t: float = 0.0) -> DataFrame:
    """A step for a right-hand side that looks at its own row alone: rhs(t, {value: column}) gives {value: column}. Stages are
    columns of projections, so nothing is shuffled, whatever the number of stages."""
    rows, weights = TABLEAUS[method]
    columns = df.columns

    def moved(v: str, row: list):
        terms = [F.lit(h * float(a)) * F.col(f"k{n}_{v}_") for n, a in enumerate(row) if a]
        return sum(terms, F.col(v))

    for n, row in enumerate(rows):
        slope = rhs(t + h * float(sum(row)), {v: moved(v, row) for v in values})
        df = df.select("*", *[slope[v].alias(f"k{n}_{v}_") for v in values])
    return df.select(*[moved(c, weights).alias(c) if c in values else F.col(c) for c in columns])


def evolve(state: DataFrame, rhs: Callable, h: float, steps: int, method: str, keys: list, values: list, every: int = 1) -> DataFrame:
    """Steps in turn; lineage is cut by a reliable checkpoint every so many steps."""
    for n in range(steps):
        state = step(state, rhs, h, method, keys, values, n * h)
        if (n + 1) % every == 0 and n + 1 < steps:
            state = cut(state)
    return state


def implicit_explicit(state: DataFrame, rhs: Callable, solve: Callable, h: float, keys: list, values: list, t: float = 0.0) -> DataFrame:
    """A step of the implicit-explicit method of two stages: y1 = solve(y0 + h/2 f(y0), h/2), k' = (y1 - y0 - h/2 f(y0)) / (h/2),
    y = y0 + h f(y1) + h k'."""
    k1 = rhs(t, state)
    y1 = solve(lincomb([(1, state), (h / 2, k1)], keys, values), h / 2)
    return lincomb([(1, state), (h, rhs(t + h / 2, y1)), (2, y1), (-2, state), (-h, k1)], keys, values)
