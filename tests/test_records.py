"""What a run leaves beside its grids, and operators between boxes against what they must keep."""

from itertools import product as cartesian

from pyspark.sql import functions as F

from latticeql.functions import weights as W
from latticeql.operators import agg, grid, lines, patches, quality, resample
from latticeql.sources import records


def line_grid(spark, n=16):
    """A cubic along i."""
    x = F.col("i").cast("double")
    return grid.points(spark, n).withColumn("u", x * x * x - F.lit(40.0) * x)


def test_norms_and_iterations_come_back(spark, tmp_path):
    row = agg.norms(line_grid(spark, 4), ["u"], F.lit(1.0))
    for n in (0, 1):
        records.append_norms(records.norms_row(row, n, n / 2, ["u"]), f"file://{tmp_path}/norms")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"file://{tmp_path}/norms", sep="\t")
    assert back.columns[:3] == ["iteration", "time", "u.min"] and sorted(r[0] for r in back.collect()) == [0, 1]
    df = line_grid(spark, 4).withColumn("patch", F.lit(0)).withColumn("level", F.col("i") % 2)
    records.write_iteration(df, f"file://{tmp_path}/grid", 3, 0.75, {"author": "x"})
    grid_back, attributes = records.read_iteration(spark, f"file://{tmp_path}/grid", 3)
    assert attributes["time"] == 0.75 and attributes["author"] == "x"
    keys = ["patch", "level", "i", "j", "k", "u"]
    assert sorted(grid_back.select(keys).collect()) == sorted(df.select(keys).collect())


def test_particles_and_timers(spark, tmp_path):
    df = spark.range(3).select(*[F.col("id").alias(c) for c in records.PARTICLE])
    records.write_particles(df, f"file://{tmp_path}/p", 7, 1.5)
    back = spark.read.parquet(f"file://{tmp_path}/p")
    assert back.count() == 3 and {r.time for r in back.collect()} == {1.5}
    timers = records.Timers()
    for _ in range(2):
        with timers.interval("step"):
            pass
    assert timers.rates("step", 10)["count"] == 2


def test_lines_in_turn_are_the_tensor_product(spark):
    n, u = 4, lambda i, j, k: float(i * i + 3 * j - k * j)
    df = grid.points(spark, n).withColumn("u", (F.col("i") * F.col("i") + 3 * F.col("j") - F.col("k") * F.col("j")).cast("double"))
    rows, wanted = resample.children(W.average_left(2)), {}
    for point in cartesian(range(2 * n), repeat=3):
        weights = W.product(*[rows[x % 2] for x in point])
        places = [[x // 2 + o for x, o in zip(point, offsets, strict=True)] for offsets in weights]
        if all(0 <= x < n for place in places for x in place):
            wanted[point] = float(sum(w * int(u(*place)) for w, place in zip(weights.values(), places, strict=True)))
    assert {(r.i, r.j, r.k): r.value for r in resample.prolongate(df, F.col("u"), *rows).collect()} == wanted


def test_smooth_lines_keep_their_averages(spark):
    """Whole cells for the non-oscillatory stencils; children that fall back do so one by one, so for them only where none has to."""
    df = line_grid(spark)
    rising = df.withColumn("u", F.col("u") + F.lit(80.0) * F.col("i"))
    for df, out in ((df, lines.eno_along(df, "u", "i", 4)), (rising, lines.fallback_along(rising, "u", "i", 4))):
        halves = out.groupBy(F.floor(F.col("i") / 2).cast("int").alias("i"), "j", "k").agg(F.avg("u").alias("mean"))
        both = halves.join(df, ["i", "j", "k"])
        assert both.count() > 0 and both.filter(F.abs(F.col("mean") - F.col("u")) > 1e-9).count() == 0


def test_ghosts_copy_their_owners(spark):
    df = line_grid(spark, 8)
    out = patches.with_ghosts(df, 8, 4, 1)
    assert out.filter("not isghost").count() == 8**3 and out.count() == 2**3 * 5**3
    assert out.groupBy("i", "j", "k").agg(F.countDistinct("u").alias("n")).filter("n > 1").count() == 0


def test_provenance_and_changes(spark):
    history = spark.createDataFrame([(0, "u", "int", False, "poisoned"), (2, "u", "int", True, "kernel"), (1, "u", "bnd", True, "sync")], "step int, variable string, region string, valid boolean, why string")
    assert {(r.region, r.valid, r.why) for r in quality.provenance(history).collect()} == {("int", True, "kernel"), ("bnd", True, "sync")}
    df = line_grid(spark, 4)
    assert {r.changed for r in quality.changed(df, df, ["u"], 4).collect()} == {0}
