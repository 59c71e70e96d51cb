"""Partitioning: cyclic rows, even and weighted contiguous cuts, process grids, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Matrix
from . import profile


def cyclic(entries: DataFrame, parts: int) -> DataFrame:
    """Entries with ``part`` = row mod parts and ``local_row`` = row div parts."""
    return entries.withColumn("part", F.pmod("row", F.lit(parts)).cast("bigint")).withColumn("local_row", F.floor(F.col("row") / parts))


def scatter(matrix: Matrix, parts: int) -> DataFrame:
    """The cyclic split dealt out: partition p of the table holds part p, by row and column.

    One shuffle of all entries; a product alone does without, see ``spmv``.
    """
    dealt = cyclic(matrix.df, parts).repartitionById(parts, F.col("part").cast("int"))
    return dealt.sortWithinPartitions("local_row", "col")


def global_row(parts: int) -> Column:
    return F.col("part") + F.col("local_row") * parts


def shards(matrix: Matrix, parts: int) -> DataFrame:
    """(part, n_rows, nnz) of all parts of the cyclic split, empty ones too."""
    n = matrix.shape.n_row
    counts = cyclic(matrix.df, parts).groupBy("part").agg(F.count("*").alias("nnz"))
    rows = F.floor((F.lit(n) - F.col("part") + (parts - 1)) / parts)
    every = matrix.spark.range(parts).select(F.col("id").alias("part"))
    return every.join(counts, "part", "left").select("part", F.greatest(rows, F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def even(spark: SparkSession, total: int, parts: int) -> DataFrame:
    """(part, start, count): the first ``total mod parts`` parts hold one more."""
    size, extra = divmod(total, parts)
    p = F.col("id")
    return spark.range(parts).select(
        p.alias("part"),
        (p * size + F.least(p, F.lit(extra))).alias("start"),
        (F.lit(size) + F.when(p < extra, 1).otherwise(0)).cast("bigint").alias("count"),
    )


AXES = ("row", "col")
#: Indices in one bucket of an axis; what is added up along an axis are totals of buckets.
BUCKET = 1 << 16


def _of(by_axis: dict[str, int]) -> Column:
    """A number for each axis, as a column over ``axis``."""
    out = F.lit(0).cast("bigint")
    for axis, value in by_axis.items():
        out = F.when(F.col("axis") == axis, F.lit(value).cast("bigint")).otherwise(out)
    return out


def _closed(firsts: DataFrame) -> DataFrame:
    """(axis, part, start, count) from the first index ``t`` that reaches each p/parts; ``none`` marks an axis without weights."""
    upto = Window.partitionBy("axis").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # a row per part
    total, parts, p = F.col("n"), F.col("parts"), F.col("p")
    cut = firsts.withColumn("b", p + F.max(F.when(p > 0, F.col("t") - p)).over(upto)).withColumn("lacking", F.count(F.when((p > 0) & F.col("t").isNull(), 1)).over(upto))
    good = (F.col("lacking") == 0) & (F.col("b") <= total - 1) & (total - F.col("b") >= parts - p)
    size = F.floor(total / parts)
    even = p * size + F.least(p, total - size * parts)
    start = F.when(F.col("none"), even).when(p == 0, F.lit(0)).when(good, F.col("b")).otherwise(total).cast("bigint")
    starts = cut.select("axis", "n", p.alias("part"), start.alias("start"))
    after = F.coalesce(F.lead("start").over(Window.partitionBy("axis").orderBy("part")), total)
    return starts.select("axis", "part", "start", (after - F.col("start")).cast("bigint").alias("count"))


def _every(spark: SparkSession, sides: dict[str, tuple[int, int]]) -> DataFrame:
    """(axis, p, n, parts) of all parts of all axes."""
    out = None
    for axis, (n, parts) in sides.items():
        rows = spark.range(parts).select(F.lit(axis).alias("axis"), F.col("id").alias("p"), F.lit(n).cast("bigint").alias("n"), F.lit(parts).cast("bigint").alias("parts"))
        out = rows if out is None else out.unionByName(rows)
    return out


def weighted_axes(weights: DataFrame, sides: dict[str, tuple[int, int]]) -> DataFrame:
    """(axis, part, start, count) of contiguous parts of about equal weight, for all axes of ``sides`` (axis: length, parts).

    ``weights`` has (axis, i, w) for indices of some weight, w not negative; the rest have none.  Going
    through the items of an axis, part p starts before the first item whose weight so far reaches p/parts of
    all, at most one cut per item and never so late that a later part finds no item; from the first
    part that can't be cut on, parts are empty at the end.  In closed form: with t_p the
    first item that reaches p/parts, part p starts at p + max over q <= p of (t_q - q).
    Without any weight, parts are even.

    Totals of buckets of indices say in which buckets a threshold is reached; only the items of
    those are added up one by one, each bucket by itself.  Nothing is read back to the driver.
    """
    parts = _of({a: s[1] for a, s in sides.items()})
    # a bucket that can't be null: no filter is derived for the join alone, and both uses of the weights share one shuffle
    own = weights.where("w > 0").select("axis", "i", F.col("w").cast("double").alias("w"), F.coalesce(F.floor(F.col("i") / BUCKET), F.lit(-1)).alias("bucket"))
    upto = Window.partitionBy("axis").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    totals = own.groupBy("axis", "bucket").agg(F.sum("w").alias("in_bucket"))
    placed = totals.select("axis", "bucket", "in_bucket", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0.0)).alias("offset"), F.sum("in_bucket").over(Window.partitionBy("axis")).alias("all"))
    share = lambda w: w * F.col("parts") / F.col("all")
    crossed = placed.withColumn("parts", parts).where(F.ceil(share(F.col("offset")) - 1e-9) <= F.floor(share(F.col("offset") + F.col("in_bucket")) + 1e-9))
    # a bucket for each part at most, and those whose edge is a threshold
    items = own.join(F.broadcast(crossed), ["axis", "bucket"])
    inside = Window.partitionBy("axis", "bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = items.withColumn("before", F.col("offset") + F.coalesce(F.sum("w").over(inside), F.lit(0.0)))
    lowest = F.greatest(F.floor(share(F.col("before"))), F.lit(1)).cast("bigint")
    highest = F.greatest(F.least(F.floor(share(F.col("before") + F.col("w"))) + 1, F.col("parts") - 1), lowest).cast("bigint")
    level = F.col("all") * F.col("p") / F.col("parts").cast("double")
    reach = before.select("axis", (F.col("i") + 1).alias("t"), "before", (F.col("before") + F.col("w")).alias("after"), "all", "parts", F.explode(F.sequence(lowest, highest)).alias("p"))
    hit = reach.where((F.col("p") < F.col("parts")) & (F.col("after") >= level) & (F.col("before") < level))
    # parts come in by a union, not by a join, from which filters would be derived for one use of the weights alone
    blank = _every(weights.sparkSession, sides).select("axis", "p", F.lit(None).cast("bigint").alias("t"))
    every = hit.select("axis", "p", "t").unionByName(blank).groupBy("axis", "p").agg(F.min("t").alias("t")).withColumns({"n": _of({a: s[0] for a, s in sides.items()}), "parts": parts})
    # every threshold of an axis with weights is reached by some item, if only the last
    none = F.max("t").over(Window.partitionBy("axis")).isNull()
    return _closed(every.withColumn("none", none).withColumn("t", F.when(F.col("t") < F.col("n"), F.col("t"))))


def uniform_axes(spark: SparkSession, sides: dict[str, tuple[int, int]]) -> DataFrame:
    """The same where every index weighs 1: thresholds are known, nothing is read."""
    level = F.col("n").cast("double") * F.col("p") / F.col("parts").cast("double")
    t = F.ceil(level).cast("bigint")
    return _closed(_every(spark, sides).withColumn("t", F.when(t < F.col("n"), t)).withColumn("none", F.col("n") <= 0))


def weighted(weights: DataFrame, total: int, parts: int) -> DataFrame:
    """(part, start, count) of one axis, from (i, w)."""
    return weighted_axes(weights.select(F.lit("row").alias("axis"), "i", "w"), {"row": (total, parts)}).drop("axis")


def _cuts(matrix: Matrix, sides: dict[str, int], balance: str) -> DataFrame:
    lengths = {"row": matrix.shape.n_row, "col": matrix.shape.n_col}
    sized = {axis: (lengths[axis], parts) for axis, parts in sides.items()}
    if balance == "uniform":
        return uniform_axes(matrix.spark, sized)
    return weighted_axes(profile.sparse_weights(matrix, balance, tuple(sides)), sized)


def cuts(matrix: Matrix, axis: str, parts: int, balance: str = "uniform") -> DataFrame:
    """(part, start, count) of one axis."""
    return _cuts(matrix, {axis: parts}, balance).drop("axis")


#: Cuts of an axis as they come to the driver: (part, start, count), a row per part.
Cuts = list[tuple[int, int, int]]


def both_cuts(matrix: Matrix, grid: tuple[int, int], balance: str = "uniform") -> tuple[Cuts, Cuts]:
    """Cuts of rows and of columns, from one scan of the entries."""
    found = _cuts(matrix, dict(zip(AXES, grid)), balance).collect()
    return tuple(sorted((r.part, r.start, r["count"]) for r in found if r.axis == axis) for axis in AXES)


def as_table(spark: SparkSession, cuts: Cuts) -> DataFrame:
    return spark.createDataFrame(cuts, "part bigint, start bigint, count bigint")


def grid_dims(ranks: int) -> tuple[int, int]:
    """The most square R x C = ranks with R >= C."""
    if ranks < 1:
        raise ValueError("a grid has at least one rank")
    c = next(c for c in range(int(ranks**0.5), 0, -1) if ranks % c == 0)
    return ranks // c, c


def bounds_of(cuts: DataFrame | Cuts) -> list[tuple[int, int]]:
    """(part, start) of the parts that hold something, by start: a row per part."""
    rows = cuts.select("part", "start", "count").collect() if isinstance(cuts, DataFrame) else cuts
    return sorted(((part, start) for part, start, count in rows if count > 0), key=lambda b: b[1])


def part_at(index: Column, bounds: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The part that an index falls into, and where that part starts: a binary search of one literal array."""
    if not bounds:
        return F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    parts, starts = (F.lit([int(b[i]) for b in bounds]).cast("array<bigint>") for i in (0, 1))
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    # how many parts start at the index or before it, from the highest binary digit down
    upto = F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.get(starts, n + step - 1) <= index, n + step).otherwise(n))
    return F.get(parts, upto - 1), F.get(starts, upto - 1)


def assign_blocks(entries: DataFrame, row_cuts: DataFrame | Cuts, col_cuts: DataFrame | Cuts) -> DataFrame:
    """Entries with ``row_blk``, ``col_blk`` and indices within the block.

    Cuts have a row per part; they are small and travel as literals of an array search.
    """
    out = entries
    for axis, table in (("row", row_cuts), ("col", col_cuts)):
        block, start = part_at(F.col(axis), bounds_of(table))
        out = out.withColumn(f"{axis}_blk", block).withColumn(f"local_{axis}", F.col(axis) - start)
    return out.where("row_blk is not null and col_blk is not null")


def slices_at(x: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    block, start = part_at(F.col("col"), bounds)
    return x.select(block.alias("col_blk"), (F.col("col") - start).alias("local_col"), "x").where("col_blk is not null")


def slices(x: DataFrame, col_cuts: DataFrame) -> DataFrame:
    """(col_blk, local_col, x): the dense vector by blocks of columns, indices within the block."""
    return slices_at(x, bounds_of(col_cuts))


def all_blocks(spark: SparkSession, grid: tuple[int, int]) -> DataFrame:
    r, c = grid
    return spark.range(r * c).select(F.floor(F.col("id") / c).alias("row_blk"), F.pmod("id", F.lit(c)).cast("bigint").alias("col_blk"), F.col("id").alias("rank"))


def block_nnz(matrix: Matrix, grid: tuple[int, int], balance: str = "uniform") -> DataFrame:
    """(row_blk, col_blk, rank, nnz) of all blocks, empty ones too."""
    placed = assign_blocks(matrix.df, *both_cuts(matrix, grid, balance))
    counts = placed.groupBy("row_blk", "col_blk").agg(F.count("*").alias("nnz"))
    return all_blocks(matrix.spark, grid).join(counts, ["row_blk", "col_blk"], "left").select("row_blk", "col_blk", "rank", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def block_weight(matrix: Matrix, grid: tuple[int, int], balance: str) -> DataFrame:
    """(row_blk, col_blk, rank, weight): weight of the block's rows plus that of its columns."""
    found = both_cuts(matrix, grid, balance)
    tables = [as_table(matrix.spark, t) for t in found]
    if balance == "uniform":
        tables = [t.select("part", F.col("count").cast("double").alias("weight")) for t in tables]
    else:
        part = F.when(F.col("axis") == "row", part_at(F.col("i"), bounds_of(found[0]))[0]).otherwise(part_at(F.col("i"), bounds_of(found[1]))[0])
        sums = profile.sparse_weights(matrix, balance).groupBy("axis", part.alias("part")).agg(F.sum("w").alias("weight"))
        tables = [t.select("part").join(sums.where(F.col("axis") == axis).drop("axis"), "part", "left").select("part", F.coalesce("weight", F.lit(0.0)).alias("weight")) for axis, t in zip(AXES, tables)]
    rows, cols = (t.select(F.col("part").alias(f"{axis}_blk"), F.col("weight").alias(f"{axis}_w")) for axis, t in zip(AXES, tables))
    return all_blocks(matrix.spark, grid).join(rows, "row_blk").join(cols, "col_blk").select("row_blk", "col_blk", "rank", (F.col("row_w") + F.col("col_w")).alias("weight"))


def balance_summary(df: DataFrame, value: str) -> DataFrame:
    """Least, largest and mean value over all parts."""
    v = F.col(value).cast("double")
    return df.agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), (F.sum(v) / F.count("*")).alias("avg_value"))
