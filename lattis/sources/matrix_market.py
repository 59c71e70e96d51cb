"""Matrix Market coordinate text: a distributed reader and a sorted writer.

Rules of the tolerant reader: comment lines start with ``%``; blank lines are skipped; tokens are
separated by blanks, tabs and carriage returns; the first other line of every file is its header
``n_row n_col nnz``, of which one occurrence is no entry; indices are
1-based on disk and 0-based here.  A folder of files is one matrix; their headers must agree in shape.  A line with a bad token or an index outside the header's
shape is dropped (``mode="dropmalformed"``) or an error (``mode="failfast"``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Matrix, Shape
from . import scratch

BLANKS = "[ \t\r]+"
SORTED_BANNER = "%%Sorted matrix file"
#: Different header lines up to which they are broadcast (about 100 bytes each).
BROADCAST_TEXTS = 100_000
#: Entries of a sorted part, beyond which there are more parts than Spark makes by itself.
PART_ROWS = 1_000_000


@dataclass(frozen=True)
class Header:
    n_row: int
    n_col: int
    nnz: int
    symmetry: str
    field: str
    #: How many files there are, how many different header lines, and the sum of the entries that they state.
    files: int
    different: int
    stated: int


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r"))


def is_content(value: Column) -> Column:
    return ~value.startswith("%") & (_trimmed(value) != "")


def parse_triplets(lines: DataFrame, value: str = "value", pattern: bool = False) -> DataFrame:
    """(row, col, val) of data lines, 0-based; null where a token is missing or bad."""
    # a line is cut into tokens once: filters are not pushed through the generator, which would copy the whole expression
    cut = lines.select(F.col(value).alias("line"), F.explode(F.array(F.split(_trimmed(F.col(value)), BLANKS))).alias("tokens"))
    tokens = F.col("tokens")
    val = F.lit(1.0) if pattern else F.get(tokens, F.lit(2)).try_cast("double")
    return cut.select((F.get(tokens, F.lit(0)).try_cast("bigint") - 1).alias("row"), (F.get(tokens, F.lit(1)).try_cast("bigint") - 1).alias("col"), val.alias("val"), "line")


def checked(triplets: DataFrame, shape: Shape, mode: str = "dropmalformed") -> DataFrame:
    """Triplets within a shape; others are dropped or raise."""
    good = (
        F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("val").isNotNull()
        & (F.col("row") >= 0) & (F.col("row") < shape.n_row) & (F.col("col") >= 0) & (F.col("col") < shape.n_col)
    )
    if mode == "dropmalformed":
        return triplets.where(good).select("row", "col", "val")
    if mode != "failfast":
        raise ValueError("mode is dropmalformed or failfast")
    fail = F.raise_error(F.concat(F.lit("bad matrix line: "), F.col("line")))
    # the check is part of a value that is kept, so that no plan drops it
    return triplets.select("row", "col", F.when(F.coalesce(good, F.lit(False)), F.col("val")).otherwise(fail.cast("double")).alias("val"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Content lines with the file that they stand in."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _kept(table: DataFrame, tag: str) -> DataFrame:
    """A small table, written once so that no later read scans the matrix for it again."""
    path = scratch.folder(table.sparkSession, tag)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, banner) of every file with either: its first content line and its banner, null where it has none.

    Minima over strings would sort all lines of a task, so that a first scan finds the lines by numbers alone: the hash of
    the first one of each file.  A second one takes the lines of such hashes and keeps the first of each file.
    """
    place = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), *place).withColumn("h", F.xxhash64("value"))
    content, banner = is_content(F.col("value")), F.col("value").startswith("%%MatrixMarket")
    blocks = lines.groupBy("file", "block").agg(F.min_by("h", F.when(content, F.col("at"))).alias("header"), F.min_by("h", F.when(banner, F.col("at"))).alias("banner"))
    of_file = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    hashes = blocks.groupBy("file").agg(of_file("header"), of_file("banner")).select(F.explode(F.array("header", "banner")).alias("h"))
    hashes = _kept(hashes.where("h is not null").distinct(), "first-lines")
    side = F.broadcast(hashes) if hashes.count() <= BROADCAST_TEXTS else hashes
    # other lines of these hashes come after the first ones; equal ones are counted as one before any sort
    found = lines.where(content | banner).join(side, "h", "left_semi").groupBy("file", "block", "value").agg(F.min("at").alias("at"))
    first = lambda which: F.min_by("value", F.when(which, F.struct("block", "at")))
    return _kept(found.groupBy("file").agg(first(content).alias("header"), first(banner).alias("banner")), "headers")


def read_header(spark: SparkSession, path: str, files: DataFrame | None = None) -> Header:
    """The banner and the shape of a file, or of all files of a folder; one row of sums over all files comes to the driver."""
    files = (file_headers(spark, path) if files is None else files).where("header is not null")
    tokens = F.split(_trimmed(F.col("header")), BLANKS)
    number = lambda i: F.get(tokens, F.lit(i)).try_cast("bigint")
    words = F.split(F.lower(F.btrim("banner")), r"\s+")
    word = lambda i, default: F.when(F.size(words) >= 5, F.get(words, F.lit(i))).otherwise(F.lit(default))
    told = files.select(
        "header", number(0).alias("n_row"), number(1).alias("n_col"), number(2).alias("nnz"),
        F.coalesce(word(4, "general"), F.lit("general")).alias("symmetry"), F.coalesce(word(3, "real"), F.lit("real")).alias("field"),
    )
    bad = F.col("n_row").isNull() | F.col("n_col").isNull() | F.col("nnz").isNull()
    kind = F.struct("n_row", "n_col", "symmetry", "field")
    r = told.agg(
        F.count("*").alias("files"), F.min(F.when(bad, F.col("header"))).alias("bad"), F.min(kind).alias("least"), F.max(kind).alias("most"),
        F.max("nnz").alias("nnz"), F.sum("nnz").alias("stated"), F.count_distinct("header").alias("different"),
    ).first()
    if not r.files:
        raise ValueError(f"no header in {path}")
    if r.bad is not None:
        raise ValueError(f"bad header in {path}: {r.bad!r}")
    if r.least != r.most:
        raise ValueError(f"files of {path} differ in shape or kind: {tuple(r.least)}, {tuple(r.most)}")
    return Header(r.least.n_row, r.least.n_col, r.nnz, r.least.symmetry, r.least.field, r.files, r.different, r.stated)


def _data(spark: SparkSession, path: str, header: Header, files: DataFrame) -> DataFrame:
    """Content lines without one occurrence of its header for each file: lines are a bag, so it does not matter which.

    Lines that look like a header are set apart by a join; those beyond one a file come back.
    """
    lines = _lines(spark, path).where(is_content(F.col("value"))).select("value")
    texts = files.where("header is not null").groupBy(F.col("header").alias("value")).agg(F.count("*").alias("files"))
    side = F.broadcast(texts) if header.different <= BROADCAST_TEXTS else texts
    alike = lines.join(side, "value").groupBy("value").agg((F.count("*") - F.max("files")).alias("more")).where("more > 0")
    # as many again, in steps, so that no array is long
    step = 1 << 12
    outer = alike.select("value", "more", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("more") - 1) / step))).alias("k"))
    again = outer.select("value", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(step), F.col("more") - F.col("k") * step))))
    return lines.join(side, "value", "left_anti").unionByName(again.select("value"))


def counted(spark: SparkSession, path: str) -> tuple[int, int]:
    """Entries that the headers state and entries that are there.

    Files with one header in common are parts of a matrix whose entries it states; others state their own.
    """
    header = read_header(spark, path)
    stated = header.stated if header.different > 1 else header.nnz
    return stated, read(spark, path, pattern="ones").nnz()


def read(spark: SparkSession, path: str, mode: str = "dropmalformed", symmetric: str = "ignore", pattern: str = "error", single: bool = False) -> Matrix:
    """A matrix file.  ``symmetric="expand"`` mirrors the stored half; ``pattern="ones"`` reads files without values."""
    files = file_headers(spark, path)
    header = read_header(spark, path, files)
    if header.field == "pattern" and pattern != "ones":
        raise ValueError("a pattern file has no values; read it with pattern='ones'")
    shape = Shape(header.n_row, header.n_col)
    entries = checked(parse_triplets(_data(spark, path, header, files), pattern=header.field == "pattern"), shape, mode)
    if single:
        entries = entries.withColumn("val", F.col("val").cast("float").cast("double"))
    if symmetric == "expand" and header.symmetry in ("symmetric", "skew-symmetric", "hermitian"):
        sign = -1.0 if header.symmetry == "skew-symmetric" else 1.0
        entries = entries.unionByName(entries.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
    return Matrix(entries, shape)


def value_text(val: Column, digits: int = 12) -> Column:
    """A double in ``digits`` significant digits as C's ``%g`` writes it: rounded from its exact binary value.

    Whole numbers are written by Spark; for others Spark would round the shortest decimal that stands for
    the double, which is wrong near ties, so that they go to Python in Arrow batches.
    """
    whole = (val == F.floor(val)) & (F.abs(val) < 10.0 ** min(digits, 15)) & (val != 0)

    @F.pandas_udf("string")
    def text(values: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.{digits}g}" if r else None for v, r in zip(values.tolist(), rest.tolist())], dtype=object)

    rest = ~F.coalesce(whole, F.lit(True))
    return F.when(whole, val.cast("bigint").cast("string")).otherwise(text(F.coalesce(val, F.lit(0.0)), rest))


def format_lines(entries: DataFrame, digits: int = 12) -> DataFrame:
    """Entries with ``line``, 1-based; values have ``digits`` digits at most, without zeros at the end, and an exponent where they are very large or small."""
    return entries.withColumn("line", F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), value_text(F.col("val"), digits)))


def write_sorted(matrix: Matrix, path: str, digits: int = 12, single_file: bool = False) -> None:
    """All entries by row and column, as text in ``path``, each part under a banner and the whole matrix's header.

    Parts are written in order of their names; ``single_file`` puts all in one.
    """
    nnz, by = matrix.nnz(), ["row", "col", "val"]
    head = F.array(F.lit(SORTED_BANNER), F.lit(f"{matrix.shape.n_row} {matrix.shape.n_col} {nnz}"))
    lines, parts = format_lines(matrix.df, digits), math.ceil(nnz / PART_ROWS)
    if single_file:
        ordered = lines.coalesce(1).sortWithinPartitions(*by)
    elif parts > int(matrix.spark.conf.get("spark.sql.shuffle.partitions")):
        ordered = lines.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    else:
        ordered = lines.orderBy(*by)
    # rows are numbered within their part: the first one brings the part's head
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    out = ordered.select("line", first.alias("first")).select(F.explode(F.when(F.col("first"), F.concat(head, F.array("line"))).otherwise(F.array("line"))).alias("line"))
    if matrix.df.isEmpty():
        out = matrix.spark.range(1).coalesce(1).select(F.explode(head).alias("line"))
    out.write.mode("overwrite").text(path)


def sort_file(spark: SparkSession, path: str, out: str, digits: int = 12) -> None:
    """Read, sort and write a matrix file; the source stays."""
    write_sorted(read(spark, path), out, digits)


def sort_files(spark: SparkSession, paths: list[str], folder: str, digits: int = 12) -> list[str]:
    """Sort every file of a list into ``folder``, as sorted_<name>; the written paths."""
    written = []
    for path in paths:
        out = f"{folder.rstrip('/')}/sorted_{path.rstrip('/').rsplit('/', 1)[-1]}"
        sort_file(spark, path, out, digits)
        written.append(out)
    return written
