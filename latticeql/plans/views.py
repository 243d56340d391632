"""Grid views over the supplied tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeql.operators.grid import AXES, points


def cube(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """i, j, k, u (quantity) and v (a whole-numbered velocity, count less 3) on an n^3 grid over lineitem: dense, zero where no row
    falls. Values are whole numbers, so sums are exact in any order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    keys = [(F.col(c) % n).cast("int").alias(a) for c, a in zip(("l_suppkey", "l_partkey", "l_orderkey"), AXES, strict=True)]
    sums = rows.groupBy(*keys).agg(F.sum("l_quantity").alias("u"), F.count("*").alias("c"))
    dense = points(spark, n).join(sums, list(AXES), "left")
    return dense.select(*AXES, F.coalesce("u", F.lit(0.0)).alias("u"), (F.coalesce("c", F.lit(0)) % 7 - 3).cast("double").alias("v"))


def cube_sql(n: int = 16, name: str = "c") -> str:
    return f"""g_{name} as (select (r % {n})::int as i, ((r // {n}) % {n})::int as j, (r // {n * n})::int as k from range({n**3}) t(r)),
a_{name} as (select (l_suppkey % {n})::int as i, (l_partkey % {n})::int as j, (l_orderkey % {n})::int as k, sum(l_quantity) as u, count(*) as c from lineitem group by all),
{name} as materialized (select i, j, k, coalesce(u, 0)::double as u, (coalesce(c, 0) % 7 - 3)::double as v from g_{name} left join a_{name} using (i, j, k))"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, i (hours since 2024-01-01, 0 to 719), u (cents)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    i = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600).cast("int")
    return e.groupBy("event_type", i.alias("i")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("u"))


HOURS_SQL = "h as (select event_type, floor((epoch(ts) - 1704067200) / 3600)::int as i, sum(round(value * 100)::bigint)::bigint as u from events group by all)"


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, x, y, z, e (nine doubles): the first components of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [F.col("embedding")[n].cast("double") for n in range(9)]
    return e.select(F.col("vec_id").alias("id"), "label", at[0].alias("x"), at[1].alias("y"), at[2].alias("z"), F.array(*at).alias("e"))
