"""Aggregates over grids: volume-weighted norms with partial sums, located extrema, statistics and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norms(df: DataFrame, values: list, weight: Column, keys: list = ()) -> DataFrame:
    """One wide row (for each key): minimum, maximum, sum, volume, average, deviation, L1, L2 and maximum norm of each value,
    weighted by volume."""
    aggs = [F.sum(weight).alias("volume")]
    for v in values:
        x = F.col(v)
        aggs += [F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"), F.sum(weight * x).alias(f"{v}_sum"), F.sum(weight * x * x).alias(f"{v}_sum2"), F.sum(weight * F.abs(x)).alias(f"{v}_l1"), F.max(F.abs(x)).alias(f"{v}_maxabs")]
    out = df.groupBy(*keys).agg(*aggs)
    vol, cols = F.col("volume"), []
    for v in values:
        s, s2 = F.col(f"{v}_sum"), F.col(f"{v}_sum2")
        cols += [F.col(f"{v}_min"), F.col(f"{v}_max"), s, (s / vol).alias(f"{v}_avg"), F.sqrt(F.greatest(F.lit(0.0), s2 / vol - (s / vol) * (s / vol))).alias(f"{v}_stddev"), (F.col(f"{v}_l1") / vol).alias(f"{v}_l1norm"), F.sqrt(s2 / vol).alias(f"{v}_l2norm"), F.col(f"{v}_maxabs")]
    return out.select(*keys, "volume", *cols)


def extrema(df: DataFrame, value: str, keys: list) -> DataFrame:
    """The places of the minimum and the maximum; of ties the smallest place."""
    at = F.struct(*[F.col(k) for k in keys])
    low = F.min(F.struct(F.col(value).alias("v"), at.alias("at"))).alias("low")
    high = F.min(F.struct((-F.col(value)).alias("v"), at.alias("at"))).alias("high")
    out = df.agg(low, high)
    return out.select(F.col("low.v").alias("min"), *[F.col(f"low.at.{k}").alias(f"min_{k}") for k in keys], (-F.col("high.v")).alias("max"), *[F.col(f"high.at.{k}").alias(f"max_{k}") for k in keys])


def checksum(df: DataFrame, keys: list, columns: list) -> DataFrame:
    """An order-independent checksum of the columns for each key."""
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.crc32(row.cast("binary"))).alias("checksum"))


def timestep(patches: DataFrame, factor: float, spacings: list) -> DataFrame:
    """dt: the factor times the least spacing over patches and directions."""
    return patches.agg((F.lit(float(factor)) * F.min(F.least(*spacings))).alias("dt"))


def places(df: DataFrame, value: str, at: list) -> DataFrame:
    """The least and the greatest value with their places, the smallest place of ties, and sumloc: the sums of value times place. Values
    that aren't numbers count as neither; -0.0 is 0."""
    v = F.col(value) + F.lit(0.0)
    place = F.struct(*[F.col(a) for a in at])
    real = df.filter(~F.isnan(value) & F.col(value).isNotNull())
    low, high = F.min(F.struct(v.alias("v"), place.alias("at"))), F.min(F.struct((-v).alias("v"), place.alias("at")))
    out = real.agg(low.alias("low"), high.alias("high"), *[F.sum(v * F.col(a)).alias(f"sumloc_{a}") for a in at])
    return out.select(F.col("low.v").alias("min"), *[F.col(f"low.at.{a}").alias(f"minloc_{a}") for a in at], (-F.col("high.v") + F.lit(0.0)).alias("max"), *[F.col(f"high.at.{a}").alias(f"maxloc_{a}") for a in at], *[f"sumloc_{a}" for a in at])
