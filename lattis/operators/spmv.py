"""Sparse matrix times dense vector: one operator, several physical plans, one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Matrix, densify
from . import blocks, partition

#: Entries of x up to which it may be broadcast (16 bytes each), if its size is given.
BROADCAST_ENTRIES = 500_000
STRATEGIES = ("coo", "chunked", "strided", "csr", "salted", "rows1d", "grid2d")


def _sum(value: Column, exact: int | None) -> Column:
    """A sum in doubles, or in decimals with ``exact`` digits, which no order of rows changes."""
    return F.sum(value) if exact is None else F.sum(value.cast(f"decimal(28,{exact})"))


def product(matrix: Matrix, x: DataFrame | None, x_size: int | None = None) -> DataFrame:
    """Entries with ``p`` = val * x[col].  Without x (ones) there is no join at all."""
    if x is None:
        return matrix.df.withColumn("p", F.col("val"))
    side = F.broadcast(x) if x_size is not None and x_size <= BROADCAST_ENTRIES else x
    return matrix.df.join(side, "col").withColumn("p", F.col("val") * F.col("x"))


def spmv(
    matrix: Matrix, x: DataFrame | None = None, strategy: str = "coo", dense: bool = False, lanes: int = 32,
    parts: int = 4, grid: tuple[int, int] = (2, 2), balance: str = "uniform", exact: int | None = None,
) -> DataFrame:
    """(row, y) with y = sum of val * x[col]; ``x`` is (col, x) or None for ones.

    coo: hash aggregation, combined before the shuffle.  chunked, strided: partial sums of
    contiguous or round-robin partitions, then merged.  csr: compressed rows in pieces, multiplied by slices of x
    as arrays.  salted: ``lanes`` partial sums per row, for hub rows.  rows1d: cyclic row parts.  grid2d: blocks
    of a process grid with cuts by ``balance``, compressed and multiplied by their slices of x, partial sums merged
    along grid rows.  For many products of one matrix see ``blocks.store`` and ``dealt.deal``.
    ``dense``: a row for every index.  Rows or columns outside the shape are not checked
    here; see ``Matrix.within``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if lanes < 1 or parts < 1 or min(grid) < 1:
        raise ValueError("lanes, parts and grid sides start at 1")
    if strategy == "csr" or (strategy == "grid2d" and x is not None):
        layout = blocks.compress(matrix, *(((1, 1), "uniform") if strategy == "csr" else (grid, balance)))
        y = blocks.multiply(layout, x, exact)
    else:
        entries = product(matrix, x, matrix.shape.n_col)
        if strategy == "coo":
            keys: list[Column] = []
        elif strategy == "chunked":
            entries, keys = entries.repartitionByRange(parts, "row", "col"), [F.spark_partition_id().alias("part")]
        elif strategy == "strided":
            entries, keys = entries.repartition(parts), [F.spark_partition_id().alias("part")]
        elif strategy == "salted":
            keys = [F.pmod(F.xxhash64("col"), F.lit(lanes)).alias("lane")]
        elif strategy == "rows1d":
            entries = partition.cyclic(entries, parts).withColumn("row", partition.global_row(parts))
            keys = [F.col("part")]
        else:
            entries, keys = partition.assign_blocks(entries, *partition.both_cuts(matrix, grid, balance)), [F.col("col_blk")]
        if keys:
            entries = entries.groupBy("row", *keys).agg(_sum(F.col("p"), exact).alias("p"))
            y = entries.groupBy("row").agg(F.sum("p").cast("double").alias("y"))
        else:
            y = entries.groupBy("row").agg(_sum(F.col("p"), exact).cast("double").alias("y"))
    return densify(matrix.spark, y, matrix.shape.n_row, "row", {"y": 0.0}) if dense else y


def head(y: DataFrame, n: int = 5) -> DataFrame:
    """The non-zeros among the first n positions."""
    return y.where((F.col("row") < n) & (F.col("y") != 0)).orderBy("row")
