"""What a run leaves beside its grids: norms by iteration, iterations with their attributes, registries, particles and timings."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reductions of a row of norms, and the columns of particles.
REDUCTIONS = ("min", "max", "sum", "avg", "stddev", "volume", "L1norm", "L2norm", "maxabs")
PARTICLE = ("id", "tau", "posx", "posy", "posz", "velx", "vely", "velz", "accx", "accy", "accz")


def norms_row(norms: DataFrame, iteration: int, at: float, values: list) -> DataFrame:
    """iteration, time and <variable>.<reduction> from a row of operators.agg.norms."""
    columns = [F.col("volume" if r == "volume" else f"{v}_{r.lower()}").alias(f"{v}.{r}") for v in values for r in REDUCTIONS]
    return norms.select(F.lit(iteration).alias("iteration"), F.lit(float(at)).alias("time"), *columns)


def append_norms(row: DataFrame, path: str) -> None:
    """Adds a row to the table of norms at path; each part file begins with the names."""
    row.write.mode("append").option("header", True).csv(path, sep="\t")


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """A document of metadata (parameters, the hierarchy of grids, a registry of files, timings) as one line of JSON."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "line string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_output(df: DataFrame, path: str, name: str) -> None:
    """Rows with the column iteration, a folder for each iteration, and an entry in the registry of what is written."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy("iteration").parquet(f"{path}/{name}")
    write_json(df.sparkSession, f"{path}/{name}.registry", {"name": name, "variables": [c for c in df.columns if c != "iteration"]})


def manifest(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name, iteration, n_rows, variables of an output, from its files and its registry."""
    variables = ",".join(read_json(spark, f"{path}/{name}.registry")["variables"])
    rows = spark.read.parquet(f"{path}/{name}").groupBy("iteration").agg(F.count("*").alias("n_rows"))
    return rows.select(F.lit(name).alias("name"), "iteration", "n_rows", F.lit(variables).alias("variables"))


def write_iteration(df: DataFrame, path: str, iteration: int, at: float, attributes: dict | None = None) -> None:
    """A grid (patch, level, i, j, k and values) with its attributes, partitioned so that readers of a level read no other."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy("patch", "level").parquet(f"{path}/iteration={iteration}/data")
    write_json(df.sparkSession, f"{path}/iteration={iteration}/attributes", {"iteration": iteration, "time": at, "columns": df.columns, **(attributes or {})})


def read_iteration(spark: SparkSession, path: str, iteration: int, columns: list | None = None) -> tuple[DataFrame, dict]:
    """(grid, attributes); columns: the values that are wanted."""
    attributes = read_json(spark, f"{path}/iteration={iteration}/attributes")
    df = spark.read.parquet(f"{path}/iteration={iteration}/data")
    keys = [c for c in ("patch", "level", "i", "j", "k") if c in df.columns]
    return df.select(*keys, *(columns or [c for c in attributes["columns"] if c not in keys])), attributes


def write_particles(df: DataFrame, path: str, iteration: int, at: float) -> None:
    """Particles of an iteration, all columns double."""
    rows = df.select(F.lit(iteration).alias("iteration"), F.lit(float(at)).alias("time"), *[F.col(c).cast("double").alias(c) for c in PARTICLE])
    rows.write.mode("append").option("compression", "zstd").partitionBy("iteration").parquet(path)


class Timers:
    """Count and total seconds of named intervals on the driver."""

    def __init__(self):
        self.found: dict = {}

    @contextmanager
    def interval(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            count, total = self.found.get(name, (0, 0.0))
            self.found[name] = (count + 1, total + time.perf_counter() - start)

    def rates(self, name: str, cell_updates: int) -> dict:
        """Intervals, seconds and cell updates a second."""
        count, total = self.found[name]
        return {"count": count, "seconds": total, "cell_updates_per_second": cell_updates / total if total else 0.0}
