"""Data quality: undefined values, validity by region, and checks that kernels keep to what they declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.operators.grid import AXES, region


def poison(df: DataFrame, value: str, n: int, where: str = "bnd") -> DataFrame:
    """Null for values of a region that aren't defined."""
    return df.withColumn(value, F.when(region(n) == where, F.lit(None).cast("double")).otherwise(F.col(value)))


def invalid(df: DataFrame, values: list, n: int) -> DataFrame:
    """A row for each value and region: points, and those that are undefined (null or not a number)."""
    rows = df.select(region(n).alias("region"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), (F.col(v).isNull() | F.isnan(v)).alias("bad")) for v in values])).alias("r"))
    return rows.groupBy("r.variable", "region").agg(F.count("*").alias("points"), F.sum(F.col("r.bad").cast("bigint")).alias("undefined"))


def require(df: DataFrame, values: list) -> DataFrame:
    """The rows, with a failure of the job at the first undefined value."""
    for v in values:
        df = df.filter(F.assert_true(F.col(v).isNotNull() & ~F.isnan(v), F.lit(f"{v} is undefined")).isNull())
    return df


def changed(before: DataFrame, after: DataFrame, values: list, n: int) -> DataFrame:
    """Points by region whose values a kernel changed, by a checksum of each point's values: what it changed outside of the region it
    declares is an error of its own."""
    code = F.xxhash64(*[F.col(v) for v in values])
    both = before.select(*AXES, code.alias("was")).join(after.select(*AXES, code.alias("now")), list(AXES), "full")
    return both.groupBy(region(n).alias("region")).agg(F.sum((~F.col("was").eqNullSafe(F.col("now"))).cast("bigint")).alias("changed"))


def provenance(history: DataFrame) -> DataFrame:
    """variable, region, valid and why, as the last step of a history (step, variable, region, valid, why) left them."""
    last = F.max(F.struct("step", "valid", "why")).alias("last")
    return history.groupBy("variable", "region").agg(last).select("variable", "region", "last.valid", "last.why")
