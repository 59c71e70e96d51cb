"""Block-compressed matrices: laid out once, multiplied by any number of vectors.

Entries are cut into the blocks of a grid; a block's columns come in strips of ``WIDTH``, so that
the matching slice of x always fits a task.  The entries of a block and strip are packed, in order of
rows, into pieces of at most ``ENTRIES``: the rows of a piece, where each starts, local columns,
values.  A product joins pieces to slices of x by block of columns, adds up segments inside
arrays, and merges the partial sums of rows along the grid.  Neither x nor single entries are
broadcast or shuffled again, and a row, column or place of any weight is many pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix, Shape
from ..sources import scratch
from . import partition

#: Columns of a strip: a slice of x has so many values at most.
WIDTH = 1 << 16
#: Entries of a piece.
ENTRIES = 1 << 16
#: Bound of a product scaled to whole numbers, so that the sums of a piece are exact.
LARGEST = float(1 << 46)

KEYS = ["col_blk", "strip", "lane"]
SCHEMA = "col_blk bigint, strip bigint, row_blk bigint, lane int, rows array<bigint>, ptr array<int>, cols array<int>, vals array<double>"


@dataclass(frozen=True)
class Blocks:
    """Pieces of a matrix; ``lanes`` lists the (col_blk, strip, lane) of a stored layout."""

    pieces: DataFrame
    shape: Shape
    col_bounds: list[tuple[int, int]]
    lanes: DataFrame | None = None
    table: str | None = None
    path: str | None = None

    def drop(self) -> None:
        """Delete a stored layout."""
        if self.table:
            spark = self.pieces.sparkSession
            spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            scratch.delete(spark, self.path)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _pack(size: int):
    """Sorted entries to pieces: never more than ``size`` entries are held for one, and as many for a batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId()
        key, held, n = None, [], 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal held, n
            if n:
                rows, cols, vals = (np.concatenate(x) for x in zip(*held))
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                done.append((*key, rows[first], np.append(first, n).astype(np.int32), cols, vals))
            held, n = [], 0

        def handed() -> pa.RecordBatch:
            scalars = [pa.array([d[i] for d in done], pa.int64()) for i in range(3)]
            arrays = [_lists([d[i] for d in done], k) for i, k in ((3, pa.int64()), (4, pa.int32()), (5, pa.int32()), (6, pa.float64()))]
            return pa.RecordBatch.from_arrays([*scalars, pa.array([lane] * len(done), pa.int32()), *arrays], names=["col_blk", "strip", "row_blk", "lane", "rows", "ptr", "cols", "vals"])

        for batch in batches:
            col_blk, strip, row_blk, row, col, val = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(row):
                continue
            turn = np.flatnonzero((col_blk[1:] != col_blk[:-1]) | (strip[1:] != strip[:-1]) | (row_blk[1:] != row_blk[:-1])) + 1
            for start, end in zip([0, *turn.tolist()], [*turn.tolist(), len(row)]):
                here = (int(col_blk[start]), int(strip[start]), int(row_blk[start]))
                if here != key:
                    close()
                    key = here
                while start < end:
                    upto = min(end, start + size - n)
                    held.append((row[start:upto], col[start:upto], val[start:upto]))
                    n += upto - start
                    start = upto
                    if n == size:
                        close()
            if sum(len(d[6]) for d in done) >= size:
                yield handed()
                done.clear()
        close()
        if done:
            yield handed()

    return pack


def compress(matrix: Matrix, grid: tuple[int, int] = (1, 1), balance: str = "uniform", entries: int | None = None, gather: bool = False) -> Blocks:
    """The layout of a matrix, not yet computed.

    Every task sorts and packs the entries that it has read, so that no entry is shuffled.  ``gather``
    first brings the entries of a block together, for fewer and fuller pieces: they are range-partitioned by
    block, row and column, equal places by where they come from.  No block, row or place is one task's work.
    """
    cuts = partition.both_cuts(matrix, grid, balance)
    placed = partition.assign_blocks(matrix.df, *cuts)
    slim = placed.select(
        "col_blk", F.floor(F.col("local_col") / WIDTH).alias("strip"), "row_blk", "row", F.pmod("local_col", F.lit(WIDTH)).cast("int").alias("place"), "val"
    )
    order = ["col_blk", "strip", "row_blk", "row", "place"]
    if gather:
        slim = slim.withColumn("__origin", F.monotonically_increasing_id()).repartitionByRange(*order, "__origin").drop("__origin")
    return Blocks(slim.sortWithinPartitions(*order).mapInArrow(_pack(entries or ENTRIES), SCHEMA), matrix.shape, partition.bounds_of(cuts[1]))


def store(matrix: Matrix, grid: tuple[int, int] = (1, 1), balance: str = "uniform", buckets: int | None = None, entries: int | None = None) -> Blocks:
    """The layout as a table bucketed by strip of columns: products read it where it lies.

    A strip's pieces of one packing task are a lane; slices of x go to the lanes of their
    strip, so that a strip of any weight is the work of many tasks.
    """
    made, spark = compress(matrix, grid, balance, entries, gather=True), matrix.spark
    path, table = scratch.folder(spark, "blocks"), f"lattis_blocks_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the arrays are computed once, by the packing tasks; only whole pieces move to their buckets
    made.pieces.repartition(n, *KEYS).write.bucketBy(n, *KEYS).option("path", path).format("parquet").saveAsTable(table)
    pieces = spark.table(table)
    return Blocks(pieces, made.shape, made.col_bounds, pieces.select(*KEYS).distinct(), table, path)


def _slices(blocks: Blocks, x: DataFrame) -> DataFrame:
    """(col_blk, strip, at, x): x in arrays of at most ``WIDTH`` values, once for each lane."""
    cut = partition.slices_at(x.where("x is not null"), blocks.col_bounds)
    values = cut.select("col_blk", F.floor(F.col("local_col") / WIDTH).alias("strip"), F.struct(F.pmod("local_col", F.lit(WIDTH)).cast("int").alias("at"), F.col("x").cast("double").alias("x")).alias("e"))
    packed = values.groupBy("col_blk", "strip").agg(F.collect_list("e").alias("e")).select("col_blk", "strip", F.col("e.at").alias("at"), F.col("e.x").alias("x"))
    # lanes: three numbers for each strip and packing task
    return packed if blocks.lanes is None else packed.join(F.broadcast(blocks.lanes), ["col_blk", "strip"])


def _segments(with_x: bool, exact: int | None):
    """Partial sums of the rows of every piece; entries whose column x lacks are left out, and rows without any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_slice, slice_x = None, np.zeros(0)
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            for i in range(batch.num_rows):
                rows, ptr, vals = (columns[n][i].values.to_numpy(zero_copy_only=False) for n in ("rows", "ptr", "vals"))
                there = None
                if with_x:
                    which = (columns["col_blk"][i].as_py(), columns["strip"][i].as_py())
                    if which != at_slice:
                        at_slice, slice_x, known = which, np.zeros(WIDTH), np.zeros(WIDTH, bool)
                        at = columns["at"][i].values.to_numpy(zero_copy_only=False)
                        slice_x[at], known[at] = columns["x"][i].values.to_numpy(zero_copy_only=False), True
                        whole = bool(known.all())
                    cols = columns["cols"][i].values.to_numpy(zero_copy_only=False)
                    if not whole:
                        there = known[cols]
                    with np.errstate(invalid="ignore", over="ignore"):
                        vals = vals * slice_x[cols]
                    if there is not None:
                        vals = np.where(there, vals, 0.0)
                if exact is not None:
                    scaled = np.rint(vals * 10.0**exact)
                    if not (np.abs(scaled) < LARGEST).all():
                        raise ValueError(f"products of 10^{exact} times {LARGEST:.0f} or more, or not finite, have no exact sums here")
                    vals = scaled.astype(np.int64)
                with np.errstate(invalid="ignore", over="ignore"):
                    sums = np.add.reduceat(vals, ptr[:-1])
                if there is not None:
                    some = np.add.reduceat(there.astype(np.int32), ptr[:-1]) > 0
                    rows, sums = rows[some], sums[some]
                out.append((rows, sums))
            if out:
                rows, sums = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sums)], names=["row", "y"])

    return run


def multiply(blocks: Blocks, x: DataFrame | None = None, exact: int | None = None) -> DataFrame:
    """(row, y) with y = sum of val * x[col]; ``x`` is (col, x) or None for ones, ``exact`` the digits of exact sums."""
    if x is None:
        source = blocks.pieces.select("rows", "ptr", "vals")
    else:
        keys = KEYS[:2] if blocks.lanes is None else KEYS
        # the slices of a task are what is hashed, whatever their estimated size: x is never broadcast
        source = blocks.pieces.join(_slices(blocks, x).hint("shuffle_hash"), keys).select("col_blk", "strip", "rows", "ptr", "cols", "vals", "at", "x")
    partial = source.mapInArrow(_segments(x is not None, exact), f"row bigint, y {'double' if exact is None else 'bigint'}")
    if exact is None:
        return partial.groupBy("row").agg(F.sum("y").alias("y"))
    total = F.sum(F.col("y").cast("decimal(28,0)"))
    return partial.groupBy("row").agg((total / F.lit(10**exact).cast("decimal(20,0)")).cast("double").alias("y"))
