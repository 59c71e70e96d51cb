"""What rows and columns look like: entries, spans, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix, densify

BALANCES = ("uniform", "nnz", "comm")


def axis_profile(matrix: Matrix, axis: str = "row") -> DataFrame:
    """(axis, nnz, lo, hi) of every index: entries, least and largest index across; empty: (0, n, -1)."""
    if axis not in ("row", "col"):
        raise ValueError("axis is row or col")
    across = "col" if axis == "row" else "row"
    n, m = (matrix.shape.n_row, matrix.shape.n_col) if axis == "row" else (matrix.shape.n_col, matrix.shape.n_row)
    found = matrix.df.groupBy(axis).agg(F.count("*").alias("nnz"), F.min(across).alias("lo"), F.max(across).alias("hi"))
    return densify(matrix.spark, found, n, axis, {"nnz": 0, "lo": m, "hi": -1})


def weights(matrix: Matrix, axis: str = "row", balance: str = "uniform") -> DataFrame:
    """(i, w): 1, the entries, or the span (0 if empty) of every index."""
    if balance not in BALANCES:
        raise ValueError(f"balance must be one of {BALANCES}")
    if balance == "uniform":
        n = matrix.shape.n_row if axis == "row" else matrix.shape.n_col
        return matrix.spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("w"))
    p = axis_profile(matrix, axis)
    span = F.when(F.col("nnz") > 0, F.col("hi") - F.col("lo") + 1).otherwise(0)
    return p.select(F.col(axis).alias("i"), (F.col("nnz") if balance == "nnz" else span).cast("double").alias("w"))


def sparse_weights(matrix: Matrix, balance: str, axes: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """(axis, i, w) of all indices that have entries, on one axis or both: one scan, combined before its one shuffle."""
    if balance not in BALANCES[1:]:
        raise ValueError(f"balance must be one of {BALANCES[1:]}")
    seen = [F.struct(F.lit(a).alias("axis"), F.col(a).alias("i"), F.col("col" if a == "row" else "row").alias("across")) for a in axes]
    both = matrix.df.select(F.explode(F.array(*seen)).alias("e")).select("e.*")
    w = F.count("*") if balance == "nnz" else F.max("across") - F.min("across") + 1
    return both.groupBy("axis", "i").agg(w.cast("double").alias("w"))
