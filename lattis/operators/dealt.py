"""Entries dealt out once by the cyclic split of rows, for any number of products without dealing again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Matrix, Shape
from ..sources import scratch
from . import partition, spmv

KEYS = ["part", "local_row"]


@dataclass(frozen=True)
class Dealt:
    df: DataFrame
    shape: Shape
    parts: int
    table: str
    path: str

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def drop(self) -> None:
        """Delete the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        scratch.delete(self.spark, self.path)


def deal(matrix: Matrix, parts: int, buckets: int | None = None) -> Dealt:
    """The entries as a table bucketed by part and row in it: one shuffle, then none.

    A row lies in one bucket; for matrices with hub rows there are block layouts, see ``blocks``.
    """
    spark, table = matrix.spark, f"lattis_rows_{uuid.uuid4().hex}"
    path, n = scratch.folder(spark, "rows"), buckets or max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = partition.cyclic(matrix.df, parts).select(*KEYS, "col", "val")
    # dealt as the buckets are, so that each bucket is one file
    split.repartition(n, *KEYS).write.bucketBy(n, *KEYS).sortBy("local_row").option("path", path).format("parquet").saveAsTable(table)
    return Dealt(spark.table(table), matrix.shape, parts, table, path)


def multiply(dealt: Dealt, x: DataFrame | None = None, exact: int | None = None) -> DataFrame:
    """(row, y) where the entries lie: x goes to all of them up to ``spmv.BROADCAST_ENTRIES``, else entries follow x by column."""
    entries = spmv.product(Matrix(dealt.df, dealt.shape), x, dealt.shape.n_col)
    sums = entries.groupBy(*KEYS).agg(spmv._sum(F.col("p"), exact).cast("double").alias("y"))
    return sums.select(partition.global_row(dealt.parts).cast("bigint").alias("row"), "y")
