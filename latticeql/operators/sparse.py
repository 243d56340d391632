"""Sparse matrices as rows (row, col, v) and vectors as (idx, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.operators.lineage import cut


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """The product as (idx, v): a join on the column and a sum by row, combined before the shuffle."""
    x = vector.select(F.col("idx").alias("col"), F.col("v").alias("x_"))
    return matrix.join(x, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("v") * F.col("x_")).alias("v"))


def times_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("row").alias("col"), F.col("col").alias("c_"), F.col("v").alias("w_"))
    return a.join(right, "col").groupBy("row", F.col("c_").alias("col")).agg(F.sum(F.col("v") * F.col("w_")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum over the union of indices."""
    return a.select("idx", "v").unionByName(b.select("idx", "v")).groupBy("idx").agg(F.sum("v").alias("v"))


def jacobi(matrix: DataFrame, right: DataFrame, sweeps: int) -> DataFrame:
    """Sweeps of Jacobi's iteration for matrix * x = right, from zero; lineage is cut after each but the last."""
    diagonal = matrix.filter("row = col").select(F.col("row").alias("idx"), F.col("v").alias("d_"))
    rest = matrix.filter("row <> col")
    b = right.select("idx", F.col("v").alias("b_")).join(diagonal, "idx")
    x = b.select("idx", (F.col("b_") / F.col("d_")).alias("v"))
    for n in range(sweeps - 1):
        r = times_vector(rest, x).withColumnRenamed("v", "r_")
        x = b.join(r, "idx", "left").select("idx", ((F.col("b_") - F.coalesce("r_", F.lit(0.0))) / F.col("d_")).alias("v"))
        if n + 2 < sweeps:
            x = cut(x)
    return x


def joined(a: DataFrame, b: DataFrame, factor: float) -> DataFrame:
    """a + factor * b over the union of indices."""
    return add(a, b.select("idx", (F.lit(factor) * F.col("v")).alias("v")))


def dot(a: DataFrame, b: DataFrame) -> float:
    return a.join(b.select("idx", F.col("v").alias("w_")), "idx").agg(F.sum(F.col("v") * F.col("w_"))).first()[0] or 0.0


def conjugate_gradient(matrix: DataFrame, right: DataFrame, steps: int, tolerance: float = 1e-20) -> DataFrame:
    """The solution of matrix * x = right for a symmetric positive definite matrix, from zero. Each step is one product, and two
    sums that come to the driver as numbers; lineage is cut after each. Ends at a squared residual within the tolerance."""
    r = cut(right.select("idx", F.col("v").cast("double").alias("v")))
    x, p, size = r.select("idx", F.lit(0.0).alias("v")), r, dot(r, r)
    for _ in range(steps):
        if size <= tolerance:
            break
        image = cut(times_vector(matrix, p))
        alpha = size / dot(p, image)
        x, r = cut(joined(x, p, alpha)), cut(joined(r, image, -alpha))
        before, size = size, dot(r, r)
        p = cut(joined(r, p, size / before))
    return x


def newton(matrix: DataFrame, right: DataFrame, start: DataFrame, term, slope, rounds: int, steps: int) -> DataFrame:
    """The solution of matrix * x + term(x) = right, term and its slope pointwise functions of a column, by Newton's method from
    start with conjugate gradients for each correction."""
    x = cut(start.select("idx", "v"))
    for _ in range(rounds):
        left = add(times_vector(matrix, x), x.select("idx", term(F.col("v")).alias("v")))
        residual = cut(joined(right.select("idx", "v"), left, -1.0))
        diagonal = x.select(F.col("idx").alias("row"), F.col("idx").alias("col"), slope(F.col("v")).alias("v"))
        jacobian = cut(matrix.select("row", "col", "v").unionByName(diagonal))
        x = cut(joined(x, conjugate_gradient(jacobian, residual, steps), 1.0))
    return x
