"""The data model: a sparse matrix is a table of (row, col, val) with a shape."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the coordinate form; indices are 0-based.
COO = ["row", "col", "val"]


@dataclass(frozen=True)
class Shape:
    n_row: int
    n_col: int

    def __post_init__(self):
        if self.n_row < 0 or self.n_col < 0:
            raise ValueError("a shape has no negative sides")


@dataclass(frozen=True)
class Matrix:
    """Coordinate entries; repeated places add up, explicit zeros are entries."""

    df: DataFrame
    shape: Shape

    @staticmethod
    def of(df: DataFrame, shape: Shape, row: str = "row", col: str = "col", val: str = "val", single: bool = False) -> Matrix:
        """Entries of any table; rows with nulls are left out.  ``single``: values as 32-bit floats."""
        v = F.col(val).cast("float") if single else F.col(val)
        entries = df.select(F.col(row).cast("bigint").alias("row"), F.col(col).cast("bigint").alias("col"), v.cast("double").alias("val"))
        return Matrix(entries.where("row is not null and col is not null and val is not null"), shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def within(self) -> Matrix:
        """Without entries outside the shape."""
        inside = (F.col("row") >= 0) & (F.col("row") < self.shape.n_row) & (F.col("col") >= 0) & (F.col("col") < self.shape.n_col)
        return replace(self, df=self.df.where(inside))

    def transposed(self) -> Matrix:
        return Matrix(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), Shape(self.shape.n_col, self.shape.n_row))

    def nnz(self) -> int:
        return self.df.count()


def ones(spark: SparkSession, n: int, key: str = "col", value: str = "x") -> DataFrame:
    """The dense vector of ones."""
    return spark.range(n).select(F.col("id").alias(key), F.lit(1.0).alias(value))


def densify(spark: SparkSession, df: DataFrame, n: int, key: str, fill: dict[str, object]) -> DataFrame:
    """A row for every index under ``n``; what is missing gets the ``fill`` values."""
    index = spark.range(n).select(F.col("id").alias(key))
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()]
    return index.join(df, key, "left").select(key, *filled)
