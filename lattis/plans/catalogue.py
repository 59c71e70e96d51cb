"""Named queries over the benchmark tables, each with the SQL that says what it computes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..model import Matrix, ones
from ..operators import blocks, csr, dealt, partition, profile, spmv
from ..sources import matrix_market, scratch, views

PARTS, GRID, LANES, DIGITS = 4, (2, 2), 32, 4

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

N_ROW = "(SELECT CAST(max(o_orderkey) + 1 AS BIGINT) FROM orders)"
N_COL = "(SELECT CAST(max(p_partkey) + 1 AS BIGINT) FROM part)"
N_SUPP = "(SELECT CAST(max(s_suppkey) + 1 AS BIGINT) FROM supplier)"
ML = "(SELECT l_orderkey AS row, l_partkey AS col, CAST(l_quantity AS DOUBLE) AS val FROM lineitem)"
ROWS = f"(SELECT range AS row FROM range({N_ROW}))"
Y_ONES = "SELECT l_orderkey AS row, SUM(CAST(l_quantity AS DOUBLE)) AS y FROM lineitem GROUP BY 1"


def query(sql: str):
    def add(f):
        _found[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _ml(spark: SparkSession, sf_dir: str) -> Matrix:
    return views.orders_parts(spark, sf_dir)


# --- products -------------------------------------------------------------------------------


@query("SELECT l_orderkey AS row, SUM(CAST(l_quantity AS DOUBLE) * 1.0) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv_coo_ones(spark, sf_dir):
    m = _ml(spark, sf_dir)
    return spmv.spmv(m, ones(spark, m.shape.n_col))


Y_VECTOR = "SELECT l_orderkey AS row, CAST(SUM(CAST(CAST(l_quantity AS DOUBLE) * CAST(p_retailprice AS DOUBLE) AS DECIMAL(28,4))) AS DOUBLE) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


@query(Y_VECTOR)
def spmv_coo_vector(spark, sf_dir):
    return spmv.spmv(_ml(spark, sf_dir), _prices(spark, sf_dir), exact=DIGITS)


@query(f"SELECT r.row, COALESCE(y, 0.0) AS y FROM {ROWS} r LEFT JOIN ({Y_ONES}) s ON r.row = s.row")
def spmv_dense(spark, sf_dir):
    return spmv.spmv(_ml(spark, sf_dir), dense=True)


@query(f"SELECT row, y FROM ({Y_ONES}) WHERE row < 5 AND y <> 0")
def result_head5(spark, sf_dir):
    return spmv.head(spmv.spmv(_ml(spark, sf_dir), dense=True))


def _strategy(name: str, strategy: str):
    def f(spark, sf_dir):
        return spmv.spmv(_ml(spark, sf_dir), strategy=strategy, parts=PARTS, grid=GRID, lanes=LANES)

    f.__name__ = name
    query(Y_ONES)(f)


for _name, _plan in (("spmv_csr", "csr"), ("spmv_salted", "salted"), ("spmv_coo_chunked", "chunked"), ("spmv_coo_strided", "strided"), ("spmv_rows1d", "rows1d"), ("spmv_grid2d", "grid2d")):
    _strategy(_name, _plan)


def _prices(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").cast("double").alias("x"))


@query(Y_VECTOR)
def spmv_blocks_vector(spark, sf_dir):
    """A block layout, stored, times the vector of prices."""
    return blocks.multiply(blocks.store(_ml(spark, sf_dir), GRID, "nnz"), _prices(spark, sf_dir), exact=DIGITS)


@query(Y_VECTOR)
def spmv_csr_vector(spark, sf_dir):
    return spmv.spmv(_ml(spark, sf_dir), _prices(spark, sf_dir), "csr", exact=DIGITS)


@query(Y_VECTOR)
def spmv_grid2d_vector(spark, sf_dir):
    return spmv.spmv(_ml(spark, sf_dir), _prices(spark, sf_dir), "grid2d", grid=GRID, balance="comm", exact=DIGITS)


@query(Y_VECTOR)
def spmv_dealt_vector(spark, sf_dir):
    """Entries dealt to cyclic parts, stored, times the vector of prices."""
    return dealt.multiply(dealt.deal(_ml(spark, sf_dir), PARTS), _prices(spark, sf_dir), exact=DIGITS)


@query("SELECT l_suppkey AS row, CAST(SUM(CAST(CAST(l_extendedprice AS DOUBLE) AS DECIMAL(28,4))) AS DOUBLE) AS y FROM lineitem GROUP BY 1")
def spmv_hub_rows(spark, sf_dir):
    return spmv.spmv(views.suppliers_parts(spark, sf_dir), strategy="salted", exact=DIGITS)


@query("SELECT row, CAST(SUM(CAST(floor(v * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS y_micro FROM (SELECT vec_id AS row, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS v FROM embeddings) GROUP BY 1")
def spmv_embeddings(spark, sf_dir):
    m = views.vectors(spark, sf_dir)
    micro = Matrix(m.df.withColumn("val", F.floor(F.col("val").cast("float").cast("double") * 1000000 + 0.5).cast("double")), m.shape)
    return spmv.spmv(micro).select("row", F.col("y").cast("bigint").alias("y_micro"))


@query(
    "SELECT user_id AS row, CAST(SUM(CAST(CAST(value AS DOUBLE) * CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS DECIMAL(28,4))) AS DOUBLE) AS y "
    "FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IN ('view', 'signup', 'purchase', 'click', 'error') GROUP BY 1"
)
def spmv_events(spark, sf_dir):
    x = spark.range(len(views.EVENT_TYPES)).select(F.col("id").alias("col"), (F.col("id") + 1).cast("double").alias("x"))
    return spmv.spmv(views.users_events(spark, sf_dir), x, exact=DIGITS)


# --- layouts --------------------------------------------------------------------------------

COUNTS = f"SELECT r.row, COUNT(l_orderkey) AS nnz FROM {ROWS} r LEFT JOIN lineitem ON r.row = l_orderkey GROUP BY 1"


@query(f"SELECT row, CAST(COALESCE(SUM(nnz) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM ({COUNTS} UNION ALL SELECT {N_ROW}, 0)")
def csr_row_ptr(spark, sf_dir):
    return csr.row_ptr(_ml(spark, sf_dir))


@query(f"SELECT row, col, val, ROW_NUMBER() OVER (PARTITION BY row ORDER BY col, val) - 1 AS pos FROM {ML}")
def csr_positions(spark, sf_dir):
    return csr.positions(_ml(spark, sf_dir))


@query(f"SELECT row, string_agg(CAST(col AS VARCHAR), ',' ORDER BY col, val) AS cols, string_agg(CAST(CAST(val AS BIGINT) AS VARCHAR), ',' ORDER BY col, val) AS vals FROM {ML} GROUP BY row")
def csr_arrays(spark, sf_dir):
    pieces = csr.to_arrays(_ml(spark, sf_dir)).select("row", "piece", *_joined())
    # one text a row is the query's result: its pieces come together in order
    rows = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "cols", "vals"))).alias("e"))
    return rows.select("row", *(F.array_join(f"e.{c}", ",").alias(c) for c in ("cols", "vals")))


def _joined():
    return F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"), F.array_join(F.col("vals").cast("array<bigint>").cast("array<string>"), ",").alias("vals")


PIECE = 3


@query(
    f"SELECT row, piece, string_agg(CAST(col AS VARCHAR), ',' ORDER BY pos) AS cols, string_agg(CAST(CAST(val AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS vals "
    f"FROM (SELECT *, pos // {PIECE} AS piece FROM (SELECT row, col, val, ROW_NUMBER() OVER (PARTITION BY row ORDER BY col, val) - 1 AS pos FROM {ML})) GROUP BY 1, 2"
)
def csr_pieces(spark, sf_dir):
    """Compressed rows in pieces of three entries."""
    return csr.to_arrays(_ml(spark, sf_dir), PIECE).select("row", "piece", *_joined())


@query(f"SELECT row, col, val FROM {ML}")
def csr_round_trip(spark, sf_dir):
    m = _ml(spark, sf_dir)
    return csr.from_arrays(csr.to_arrays(m), m.shape).df


@query(f"SELECT row, col, val FROM {ML} ORDER BY row, col, val")
def matrix_sorted(spark, sf_dir):
    return csr.in_order(_ml(spark, sf_dir))


# --- text -----------------------------------------------------------------------------------


@query(f"SELECT row, col, val FROM {ML}")
def mm_parse(spark, sf_dir):
    m = _ml(spark, sf_dir)
    lines = matrix_market.format_lines(m.df).select(F.col("line").alias("value"))
    return matrix_market.checked(matrix_market.parse_triplets(lines), m.shape)


@query(f"SELECT row, col, val FROM {ML} WHERE row % 7 <> 0 AND row % 7 <> 1 AND row % 7 <> 2")
def mm_parse_malformed(spark, sf_dir):
    m = _ml(spark, sf_dir)
    good = matrix_market.format_lines(m.df)
    # every seventh row: a bad token, a row past the end, a missing value; the rest with tabs and blanks
    value = (
        F.when(F.col("row") % 7 == 0, F.concat(F.lit("x"), "line"))
        .when(F.col("row") % 7 == 1, F.concat_ws(" ", F.lit(str(m.shape.n_row + 1)), (F.col("col") + 1).cast("string"), F.lit("1")))
        .when(F.col("row") % 7 == 2, F.substring_index("line", " ", 2))
        .otherwise(F.concat(F.lit(" \t"), F.translate("line", " ", "\t"), F.lit(" \r")))
    )
    lines = good.select(value.alias("value")).unionByName(spark.createDataFrame([("% a comment",), ("",), (" \t",), ("0 1 1",)], "value string"))
    lines = lines.where(matrix_market.is_content(F.col("value")))
    return matrix_market.checked(matrix_market.parse_triplets(lines), m.shape)


@query(f"SELECT CAST(row + 1 AS VARCHAR) || ' ' || CAST(col + 1 AS VARCHAR) || ' ' || CAST(CAST(val AS BIGINT) AS VARCHAR) AS line FROM {ML}")
def mm_format(spark, sf_dir):
    return matrix_market.format_lines(_ml(spark, sf_dir).df).select("line")


@query(f"SELECT CAST(l_orderkey + 1 AS VARCHAR) || ' ' || CAST(l_partkey + 1 AS VARCHAR) || ' ' || printf('%.12g', l_extendedprice / 7.0) AS line FROM lineitem WHERE l_extendedprice / 7.0 <> floor(l_extendedprice / 7.0)")
def mm_format_fractions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), (F.col("l_extendedprice") / 7.0).alias("val"))
    return matrix_market.format_lines(rows.where(F.col("val") != F.floor("val"))).select("line")


@query(f"SELECT row, col, val FROM {ML}")
def mm_file_round_trip(spark, sf_dir):
    """Written sorted as many part files, read back as one matrix."""
    path = scratch.folder(spark, "matrix")
    matrix_market.write_sorted(_ml(spark, sf_dir), path)
    return matrix_market.read(spark, path, mode="failfast").df


@query("SELECT l_orderkey AS row, l_partkey AS col, CAST(CAST(l_extendedprice / 7.0 AS FLOAT) AS DOUBLE) AS val FROM lineitem")
def matrix_single_precision(spark, sf_dir):
    """Fractional values as the library narrows them when it takes a table as a matrix."""
    rows = views.table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 7.0)
    return Matrix.of(rows, _ml(spark, sf_dir).shape, "l_orderkey", "l_partkey", "v", single=True).df


@query("SELECT l_orderkey AS row, l_partkey AS col, CAST(CAST(CAST(printf('%.12g', l_extendedprice / 7.0) AS DOUBLE) AS FLOAT) AS DOUBLE) AS val FROM lineitem")
def mm_read_single(spark, sf_dir):
    """The same values written as text of twelve digits and read back as 32-bit floats."""
    path = scratch.folder(spark, "single")
    rows = views.table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 7.0)
    matrix_market.write_sorted(Matrix.of(rows, _ml(spark, sf_dir).shape, "l_orderkey", "l_partkey", "v"), path)
    return matrix_market.read(spark, path, mode="failfast", single=True).df


# --- profiles -------------------------------------------------------------------------------

ROW_PROFILE = f"SELECT r.row, COUNT(l_orderkey) AS nnz, COALESCE(MIN(l_partkey), {N_COL}) AS lo, COALESCE(MAX(l_partkey), -1) AS hi FROM {ROWS} r LEFT JOIN lineitem ON r.row = l_orderkey GROUP BY 1"
COLS = f"(SELECT range AS col FROM range({N_COL}))"
COL_PROFILE = f"SELECT c.col, COUNT(l_partkey) AS nnz, COALESCE(MIN(l_orderkey), {N_ROW}) AS lo, COALESCE(MAX(l_orderkey), -1) AS hi FROM {COLS} c LEFT JOIN lineitem ON c.col = l_partkey GROUP BY 1"


@query(ROW_PROFILE)
def row_profile(spark, sf_dir):
    return profile.axis_profile(_ml(spark, sf_dir), "row")


@query(COL_PROFILE)
def col_profile(spark, sf_dir):
    return profile.axis_profile(_ml(spark, sf_dir), "col")


def _weights(axis: str, balance: str) -> str:
    source = ROW_PROFILE if axis == "row" else COL_PROFILE
    w = {"uniform": "1.0", "nnz": "nnz", "comm": "CASE WHEN nnz > 0 THEN hi - lo + 1 ELSE 0 END"}[balance]
    return f"SELECT {axis} AS i, CAST({w} AS DOUBLE) AS w FROM ({source})"


def _cuts(axis: str, balance: str, parts: int) -> str:
    total = N_ROW if axis == "row" else N_COL
    return f"""
        WITH wt AS ({_weights(axis, balance)}),
        pre AS (SELECT i, COALESCE(SUM(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM wt),
        tot AS (SELECT SUM(w) AS allw, {total} AS n FROM wt),
        ps AS (SELECT range AS p FROM range(1, {parts})),
        ts AS (SELECT p, MIN(i) AS t FROM ps, tot LEFT JOIN pre ON before >= allw * p / {float(parts)} GROUP BY p),
        bs AS (SELECT p, p + MAX(t - p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS b, COUNT(*) FILTER (WHERE t IS NULL) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS lacking FROM ts),
        st AS (SELECT 0 AS part, 0 AS start UNION ALL SELECT p, CASE WHEN lacking = 0 AND b <= n - 1 AND n - b >= {parts} - p THEN b ELSE n END FROM bs, tot)
        SELECT CAST(part AS BIGINT) AS part, CAST(start AS BIGINT) AS start, CAST(COALESCE(LEAD(start) OVER (ORDER BY part), n) - start AS BIGINT) AS count FROM st, tot
    """


def _balanced(balance: str):
    def weights(spark, sf_dir):
        return profile.weights(_ml(spark, sf_dir), "row", balance)

    def cuts(spark, sf_dir):
        return partition.cuts(_ml(spark, sf_dir), "row", PARTS, balance)

    def col_cuts(spark, sf_dir):
        return partition.cuts(_ml(spark, sf_dir), "col", PARTS, balance)

    weights.__name__, cuts.__name__, col_cuts.__name__ = f"weights_{balance}", f"cuts_{balance}", f"col_cuts_{balance}"
    query(_weights("row", balance))(weights)
    query(_cuts("row", balance, PARTS))(cuts)
    query(_cuts("col", balance, PARTS))(col_cuts)


for _name in profile.BALANCES:
    _balanced(_name)


# --- partitions -----------------------------------------------------------------------------


@query(f"SELECT p.range AS part, p.range * (n // 7) + LEAST(p.range, n % 7) AS start, n // 7 + CASE WHEN p.range < n % 7 THEN 1 ELSE 0 END AS count FROM range(7) p, (SELECT {N_ROW} AS n)")
def partition_even(spark, sf_dir):
    return partition.even(spark, views.size(views.table(spark, sf_dir, "orders"), "o_orderkey"), 7)


SHARDS = f"SELECT r.row % {PARTS} AS part, COUNT(DISTINCT r.row) AS n_rows, COUNT(l_orderkey) AS nnz FROM {ROWS} r LEFT JOIN lineitem ON r.row = l_orderkey GROUP BY 1"


@query(SHARDS)
def split_cyclic(spark, sf_dir):
    return partition.shards(_ml(spark, sf_dir), PARTS)


@query(f"SELECT row, col, val, row % {PARTS} AS part, row // {PARTS} AS local_row FROM {ML}")
def shard_entries(spark, sf_dir):
    return partition.cyclic(_ml(spark, sf_dir).df, PARTS)


def _placed(balance: str) -> str:
    r, c = (f"({_cuts(axis, balance, n)})" for axis, n in zip(("row", "col"), GRID))
    return f"SELECT m.row, m.col, m.val, r.part AS row_blk, m.row - r.start AS local_row, c.part AS col_blk, m.col - c.start AS local_col FROM {ML} m JOIN {r} r ON m.row >= r.start AND m.row < r.start + r.count JOIN {c} c ON m.col >= c.start AND m.col < c.start + c.count"


BLOCKS = f"(SELECT range AS rank, range // {GRID[1]} AS row_blk, range % {GRID[1]} AS col_blk FROM range({GRID[0] * GRID[1]}))"
BLOCK_NNZ = f"SELECT b.row_blk, b.col_blk, b.rank, COALESCE(k, 0) AS nnz FROM {BLOCKS} b LEFT JOIN (SELECT row_blk, col_blk, COUNT(*) AS k FROM ({_placed('nnz')}) GROUP BY 1, 2) s ON b.row_blk = s.row_blk AND b.col_blk = s.col_blk"


@query(_placed("uniform"))
def block_assign(spark, sf_dir):
    m = _ml(spark, sf_dir)
    return partition.assign_blocks(m.df, *partition.both_cuts(m, GRID))


@query(BLOCK_NNZ)
def block_nnz(spark, sf_dir):
    return partition.block_nnz(_ml(spark, sf_dir), GRID, "nnz")


def _part_weight(axis: str, n: int) -> str:
    return f"SELECT part, COALESCE(SUM(w), 0.0) AS weight FROM ({_cuts(axis, 'comm', n)}) c LEFT JOIN ({_weights(axis, 'comm')}) w ON i >= start AND i < start + count GROUP BY 1"


@query(f"SELECT b.row_blk, b.col_blk, b.rank, r.weight + c.weight AS weight FROM {BLOCKS} b JOIN ({_part_weight('row', GRID[0])}) r ON r.part = b.row_blk JOIN ({_part_weight('col', GRID[1])}) c ON c.part = b.col_blk")
def block_weight(spark, sf_dir):
    return partition.block_weight(_ml(spark, sf_dir), GRID, "comm")


@query(f"SELECT CAST(MIN(nnz) AS DOUBLE) AS min_value, CAST(MAX(nnz) AS DOUBLE) AS max_value, CAST(SUM(nnz) AS DOUBLE) / COUNT(*) AS avg_value FROM ({BLOCK_NNZ})")
def balance_summary(spark, sf_dir):
    return partition.balance_summary(partition.block_nnz(_ml(spark, sf_dir), GRID, "nnz"), "nnz")


# --- statistics -----------------------------------------------------------------------------


@query("SELECT l_suppkey AS k, CAST(SUM(CAST(l_quantity AS DOUBLE)) AS DOUBLE) / COUNT(l_quantity) AS mean FROM lineitem GROUP BY 1")
def mean_stats(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(metrics.arithmetic_mean(F.col("l_quantity").cast("double")).alias("mean"))


@query("SELECT l_suppkey AS k, ROUND(EXP(SUM(CASE WHEN v > 0 THEN LN(v) ELSE 0.0 END) / COUNT(v)), 6) AS geo FROM (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) - 10 AS v FROM lineitem) GROUP BY 1")
def geo_mean(spark, sf_dir):
    v = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_quantity").cast("double") - 10).alias("v"))
    return v.groupBy("k").agg(F.round(metrics.geometric_mean(F.col("v")), 6).alias("geo"))


@query("SELECT l_suppkey AS k, ROUND(SUM(POW(CAST(l_quantity AS DOUBLE) - 25.5, 2)) / COUNT(l_quantity), 6) AS sigma FROM lineitem GROUP BY 1")
def sigma(spark, sf_dir):
    v = F.col("l_quantity").cast("double")
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(metrics.spread(v, F.lit(25.5)), 6).alias("sigma"))


#: A time for each part, as data: part/1000 seconds, none for part 0.
TIMED = f"(SELECT s.part, n_rows, s.nnz, {N_COL} AS n_col, CAST(s.part AS DOUBLE) / 1000 AS t FROM ({SHARDS}) s)"


def _timed(spark, sf_dir):
    m = _ml(spark, sf_dir)
    return partition.shards(m, PARTS).withColumn("n_col", F.lit(m.shape.n_col)).withColumn("t", F.col("part").cast("double") / 1000)


def _rate_sql(amount: str) -> str:
    return f"SELECT part, CASE WHEN t = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST({amount} AS DOUBLE) / 1e9 / t END AS rate FROM {TIMED}"


@query(_rate_sql("nnz * 12 + n_col * 4 + n_rows * 4"))
def bandwidth_coo(spark, sf_dir):
    return _timed(spark, sf_dir).select("part", metrics.bandwidth_coo(F.col("n_rows"), F.col("n_col"), F.col("nnz"), F.col("t")).alias("rate"))


@query(_rate_sql("nnz * 12 + (n_rows + 1) * 4 + n_rows * 4"))
def bandwidth_csr(spark, sf_dir):
    return _timed(spark, sf_dir).select("part", metrics.bandwidth_csr(F.col("n_rows"), F.col("nnz"), F.col("t")).alias("rate"))


@query(_rate_sql("nnz * 2"))
def gflops(spark, sf_dir):
    return _timed(spark, sf_dir).select("part", metrics.gflops(F.col("nnz"), F.col("t")).alias("rate"))


_P = PARTS


@query(
    f"WITH s AS ({SHARDS}), g AS (SELECT SUM(n_rows) AS n, SUM(nnz) AS z, {N_COL} AS c FROM s), h AS ("
    f"SELECT part AS rank, n_rows, nnz, c, CASE WHEN part = 0 THEN {_P * 24} + {_P * 8} + {_P * 8} + (n + {_P}) * 8 + (z + {_P}) * 8 + n * 12 + {_P * 8} "
    f"ELSE (n_rows + 1) * 4 + nnz * 8 + n_rows * 4 + n * 4 + {_P * 4} + c * 4 END AS host, "
    f"CASE WHEN part = 0 THEN c * 4 + (n + 1) * 4 + z * 8 + n * 8 ELSE (n_rows + 1) * 4 + nnz * 8 + c * 4 + n_rows * 4 END AS device FROM s, g) "
    "SELECT CAST(rank AS BIGINT) AS rank, CAST(host AS BIGINT) AS host_memory_bytes, CAST(device AS BIGINT) AS gpu_memory_bytes, CAST(host + device AS BIGINT) AS total_memory_bytes, CAST(host + device AS DOUBLE) / 1e6 AS total_memory_megabytes FROM h"
)
def footprint_1d(spark, sf_dir):
    m = _ml(spark, sf_dir)
    s = partition.shards(m, PARTS)
    whole = F.broadcast(s.agg(F.sum("nnz").alias("all_nnz")))  # one row
    n, c, p = F.lit(m.shape.n_row).cast("bigint"), F.lit(m.shape.n_col).cast("bigint"), F.lit(PARTS).cast("bigint")
    root = metrics.footprint_1d_root(n, c, F.col("all_nnz"), p, n, F.col("all_nnz"))
    other = metrics.footprint_1d(n, c, p, F.col("n_rows"), F.col("nnz"))
    host, device = (F.when(F.col("part") == 0, a).otherwise(b) for a, b in zip(root, other))
    return _totals(s.crossJoin(whole).select(F.col("part").alias("rank"), host.alias("host_memory_bytes"), device.alias("gpu_memory_bytes")))


def _totals(df: DataFrame) -> DataFrame:
    total = F.col("host_memory_bytes") + F.col("gpu_memory_bytes")
    return df.select("rank", "host_memory_bytes", "gpu_memory_bytes", total.alias("total_memory_bytes"), (total.cast("double") / 1e6).alias("total_memory_megabytes"))


@query(
    f"WITH b AS ({BLOCK_NNZ}), r AS ({_cuts('row', 'nnz', GRID[0])}), c AS ({_cuts('col', 'nnz', GRID[1])}), h AS ("
    f"SELECT rank, (r.count + 1) * 4 + nnz * 12 + n * 32 + r.count * 4 + {(GRID[0] + GRID[1]) * 8} + r.count * 4 + {GRID[0] * GRID[1] * 8} + n * 4 AS host, (r.count + 1) * 4 + nnz * 8 + c.count * 4 + r.count * 4 AS device "
    f"FROM b JOIN r ON r.part = row_blk JOIN c ON c.part = col_blk, (SELECT {N_ROW} AS n)) "
    "SELECT rank, CAST(host AS BIGINT) AS host_memory_bytes, CAST(device AS BIGINT) AS gpu_memory_bytes, CAST(host + device AS BIGINT) AS total_memory_bytes, CAST(host + device AS DOUBLE) / 1e6 AS total_memory_megabytes FROM h"
)
def footprint_2d(spark, sf_dir):
    m = _ml(spark, sf_dir)
    placed = partition.block_nnz(m, GRID, "nnz")
    for axis, cuts in zip(("row", "col"), partition.both_cuts(m, GRID, "nnz")):
        placed = placed.join(partition.as_table(spark, cuts).select(F.col("part").alias(f"{axis}_blk"), F.col("count").alias(f"{axis}s")), f"{axis}_blk")
    lit = lambda v: F.lit(v).cast("bigint")
    host, device = metrics.footprint_2d(lit(m.shape.n_row), lit(GRID[0]), lit(GRID[1]), F.col("rows"), F.col("cols"), F.col("nnz"))
    return _totals(placed.select("rank", host.alias("host_memory_bytes"), device.alias("gpu_memory_bytes")))
