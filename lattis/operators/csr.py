"""Compressed rows: row pointers, positions in a row, rows as arrays, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Matrix, Shape, densify

#: Indices in one bucket of a two-level prefix sum; only bucket totals meet in one task.
BUCKET = 1 << 16
#: Entries in one piece of a compressed row.
PIECE = 1 << 16


def prefix_sum(df: DataFrame, index: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """``out`` = sum of ``value`` over all smaller indices (each index once)."""
    own = df.withColumn("__bucket", F.floor(F.col(index) / bucket))
    totals = own.groupBy("__bucket").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    summed = own.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, "__bucket").withColumn(out, F.col("__offset") + F.col("__inside")).drop("__bucket", "__offset", "__inside")


def row_counts(matrix: Matrix) -> DataFrame:
    """(row, nnz) for every row of the shape."""
    counts = matrix.df.groupBy("row").agg(F.count("*").alias("nnz"))
    return densify(matrix.spark, counts, matrix.shape.n_row, "row", {"nnz": 0})


def row_ptr(matrix: Matrix) -> DataFrame:
    """(row, ptr), n_row + 1 rows: where each row starts, and the number of entries at the end."""
    closed = row_counts(matrix).unionByName(matrix.spark.createDataFrame([(matrix.shape.n_row, 0)], "row bigint, nnz bigint"))
    return prefix_sum(closed, "row", "nnz", "ptr").select("row", "ptr")


def positions(matrix: Matrix, bucket: int = BUCKET) -> DataFrame:
    """Entries with ``pos``, their place in the row by column and value.

    Matrices of more columns than a bucket take two levels: a window never holds more than
    a row's entries in one bucket of columns, so that a hub row is the work of many tasks.
    """
    if matrix.shape.n_col <= bucket:
        order = Window.partitionBy("row").orderBy("col", "val")
        return matrix.df.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
    own = matrix.df.withColumn("__bucket", F.floor(F.col("col") / bucket))
    before = Window.partitionBy("row").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("row", "__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select("row", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("row", "__bucket").orderBy("col", "val")
    placed = own.withColumn("pos", F.row_number().over(inside) - 1).join(offsets, ["row", "__bucket"])
    return placed.select(*matrix.df.columns, (F.col("__offset") + F.col("pos")).cast("bigint").alias("pos"))


def to_arrays(matrix: Matrix, size: int = PIECE, bucket: int = BUCKET) -> DataFrame:
    """(row, piece, cols, vals): compressed rows in pieces of ``size`` entries by place in the row; the last may hold fewer.

    Equal entries are counted before they are placed, and take their places as runs.  Places are
    sums of counts in two levels, so that a window holds one row's different entries in one bucket
    of columns.  Whatever the weight of a row or of one place in it, no array is longer than ``size``.
    """
    minus = F.when(F.col("val") == 0, F.col("val").cast("string") == "-0.0").otherwise(F.lit(False))  # grouping alone would merge the two zeros
    counted = matrix.df.groupBy("row", "col", "val", minus.alias("__minus")).agg(F.count("*").alias("__k"))
    own = counted.withColumn("val", F.when(F.col("__minus"), F.lit(-0.0)).otherwise(F.col("val"))).withColumn("__bucket", F.floor(F.col("col") / bucket))
    inside = Window.partitionBy("row", "__bucket").orderBy("col", "val", F.desc("__minus")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__k").over(inside), F.lit(0))
    if matrix.shape.n_col > bucket:
        before = Window.partitionBy("row").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = own.groupBy("row", "__bucket").agg(F.sum("__k").alias("__n"))
        offsets = totals.select("row", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
        placed = own.withColumn("__start", start).join(offsets, ["row", "__bucket"]).withColumn("__start", F.col("__start") + F.col("__offset"))
    else:
        placed = own.withColumn("__start", start)
    end = F.col("__start") + F.col("__k")
    runs = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("__start") / size), F.floor((end - 1) / size))))
    times = F.least(end, (F.col("piece") + 1) * size) - F.greatest(F.col("__start"), F.col("piece") * size)
    packed = runs.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("__start", "col", "val", times.cast("int").alias("times")))).alias("e"))
    spread = lambda field: F.flatten(F.transform("e", lambda r: F.array_repeat(r[field], r["times"])))
    plain = ~F.exists("e", lambda r: r["times"] > 1)
    return packed.select("row", "piece", F.when(plain, F.col("e.col")).otherwise(spread("col")).alias("cols"), F.when(plain, F.col("e.val")).otherwise(spread("val")).alias("vals"))


def from_arrays(rows: DataFrame, shape: Shape) -> Matrix:
    entries = rows.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e"))
    return Matrix(entries.select("row", F.col("e.cols").alias("col"), F.col("e.vals").alias("val")), shape)


def in_order(matrix: Matrix) -> DataFrame:
    """Entries by row, column, value (a range shuffle, spilling)."""
    return matrix.df.orderBy("row", "col", "val")
