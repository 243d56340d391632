"""Formulas against what they must be exact for, and sources against a round trip."""

from fractions import Fraction as Q

import time

import pytest
from pyspark.sql import functions as F

from latticeql.functions import weights as W
from latticeql.operators import grid, resample
from latticeql.sources import tsv


@pytest.mark.parametrize("p", [2, 4, 6, 8])
def test_derivatives_are_exact_for_polynomials(p):
    for m in range(p + 1):
        assert sum(w * Q(o) ** m for o, w in W.centred(p, 1).items()) == (1 if m == 1 else 0)
        assert sum(w * Q(o) ** m for o, w in W.centred(p, 2).items()) == (2 if m == 2 else 0)
        assert sum(w * Q(o) ** m for o, w in W.upwind(p).items()) == (1 if m == 1 else 0)


def test_known_rows():
    assert W.centred(4, 1) == {-2: Q(1, 12), -1: Q(-2, 3), 1: Q(2, 3), 2: Q(-1, 12)}
    assert W.between(4) == {-1: Q(-1, 16), 0: Q(9, 16), 1: Q(9, 16), 2: Q(-1, 16)}
    assert W.average_left(2) == {-1: Q(1, 8), 0: Q(1), 1: Q(-1, 8)}
    assert W.cell_left(1) == {-1: Q(1, 4), 0: Q(3, 4)}


@pytest.mark.parametrize("p", [0, 1, 2, 3, 4, 5])
def test_conservative_children_average_to_their_parent(p):
    left, right = resample.children(W.average_left(p))
    both = {k: left.get(k, 0) + right.get(k, 0) for k in {*left, *right}}
    if p % 2 == 0:
        assert {k: v for k, v in both.items() if v} == {0: 2}
    assert sum(left.values()) == sum(right.values()) == 1


def test_slice_index_ties_to_even():
    assert [grid.nearest_index(x, 0.0, 1.0) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.5, 1.25), (1, 1.0, -3.5)], "iteration int, time double, u double")
    tsv.write_tsv(df, f"file://{tmp_path}/t.tsv")
    back = tsv.read_tsv(spark, f"file://{tmp_path}/t.tsv", {"iteration": "int"})
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    assert tsv.header(["iteration", "time"]) == "# 1:iteration\t2:time"


def test_a_whole_checkpoint_is_skipped_and_a_lost_one_replaced(spark, tmp_path):
    at, df = f"file://{tmp_path}", spark.range(3)
    assert tsv.write_checkpoint({"g": df}, at, 1, {"p": 1})
    assert not tsv.write_checkpoint({"g": spark.range(5)}, at, 1)
    assert tsv.recover(spark, at, 1, "g").count() == 3
    # What a lost run left has no document: it isn't recovered from, and gives way.
    spark.range(9).write.parquet(f"{at}/iteration=2/g")
    assert tsv.recover(spark, at, None, "g").count() == 3
    assert tsv.write_checkpoint({"g": spark.range(4)}, at, 2)
    assert tsv.recover(spark, at, None, "g").count() == 4
    assert tsv.recovered(spark, at)["epoch"] == 1 and tsv.recovered(spark, at, 1)["parameters"] == {"p": 1}
    assert [tsv.due(6, 3, 0, 0), tsv.due(7, 3, 0, 0), tsv.due(7, 0, 60, 30), tsv.due(7, 0, 1, 30, True, True)] == [True, False, True, True]


def test_restriction_needs_all_children_and_boundaries_their_faces(spark):
    from latticeql.operators import grid, resample

    whole = grid.points(spark, 4).withColumn("u", F.lit(1.0))
    assert resample.restrict(whole.filter("i > 0"), "u").count() == 4
    with pytest.raises(ValueError):
        grid.faces("neumann", i_lower="periodic")
    with pytest.raises(ValueError):
        grid.faces("warm")
    assert grid.loop(whole, "ghosts", 4).count() == 0
    with pytest.raises(ValueError):
        grid.loop(whole, "somewhere", 4)


def test_a_step_of_many_stages_is_planned_in_time(spark):
    from latticeql.operators import ode, stencil
    from latticeql.functions import weights as W

    box = stencil.summed(*[stencil.along(W.centred(2, 2), a) for a in ("i", "j", "k")])
    state = spark.range(64).select(*[(F.floor(F.col("id") / 4**n) % 4).cast("int").alias(a) for n, a in enumerate("ijk")], F.col("id").cast("double").alias("u"))
    began = time.time()
    out = ode.step(state, lambda t, y: stencil.scatter(y, F.col("u"), box, 1.0, 4, True, "u"), 0.01, "dp87", ["i", "j", "k"], ["u"])
    plan = out._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") < 8 and out.count() == 64 and time.time() - began < 120


def test_stream_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from latticeql.streaming.restriction import hourly, run_stream

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = run_stream(spark, f"file://{tmp_path}/in", e.schema, 4, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    batch = {tuple(r) for r in hourly(e, 4).collect()}
    done = {tuple(r) for r in out.collect()}
    assert done <= batch and len(done) >= 0.9 * len(batch)


@pytest.mark.parametrize("method,order", [("rkf78", 7), ("dp87", 8), ("rk4", 4)])
def test_integrators_meet_their_order(method, order):
    from latticeql.operators.ode import TABLEAUS

    rows, weights = TABLEAUS[method]
    # y' = y makes each step a polynomial in h, whose terms up to the order are those of the exponential.
    stages = []
    for row in rows:
        total = [Q(1)] + [Q(0)] * len(rows)
        for a, k in zip(row, stages, strict=False):
            total = [x + a * y for x, y in zip(total, [Q(0), *k], strict=False)]
        stages.append(total)
    step = [Q(1)] + [sum((w * k[m] for w, k in zip(weights, stages, strict=True)), Q(0)) for m in range(len(rows))]
    factorial = 1
    for m in range(1, order + 1):
        factorial *= m
        assert abs(float(step[m] - Q(1, factorial))) < 1e-14


def test_collocation_is_exact_for_polynomials():
    for n in (2, 3, 4, 8):
        x, d = W.lobatto(n), W.collocation(n)
        for m in range(n):
            for p in range(n):
                assert abs(sum(w * y**m for w, y in zip(d[p], x, strict=True)) - (m * x[p] ** (m - 1) if m else 0)) < 1e-11


def test_termination_and_selection():
    from latticeql.operators import control

    at = {"iteration": 10, "time": 0.5, "runtime": 3.0, "last_iteration": 10, "last_time": 1.0}
    assert [k for k in ("never", "iteration", "time", "runtime", "any", "all", "either", "both") if control.ended(k, **at)] == ["iteration", "any", "either"]
    assert control.ended("all", **{**at, "last_time": 0.5, "last_runtime": 1.0}) and not control.ended("runtime", **at)
    assert control.chosen("rho, state", ["x", "u", "rho", "v"], {"state": ["u", "v"]}) == ["u", "rho", "v"]
    with pytest.raises(ValueError):
        control.chosen("w", ["x"])
    assert (control.cadence(-1, 8), control.cadence(0, 8), control.cadence(2, 8)) == (8, 0, 2)
