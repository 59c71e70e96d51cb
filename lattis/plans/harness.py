"""One benchmarked product: read and partition, multiply, report, write result files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..model import Matrix, densify
from ..operators import blocks, dealt, partition, spmv
from ..sources import scratch, sinks
from . import timing

log = logging.getLogger("lattis")

#: Entries that one task handles at best.
TASK_ENTRIES = 4_000_000


@dataclass
class Report:
    name: str
    strategy: str
    parts: int
    balance: str
    #: Seconds to read, split and deal, seconds to multiply, GB/s and GFLOPS of each timed run.
    runs: list[tuple[int, float, float, float, float]] = field(default_factory=list)
    head: list[tuple[int, float]] = field(default_factory=list)

    def banner(self) -> str:
        return f"matrix {self.name}, strategy {self.strategy}, {self.parts} parts, balance {self.balance}"

    def lines(self) -> list[str]:
        return [f"run {i}: {comm:.6f} s communication, {run:.6f} s execution, {gbs:.3f} GB/s, {flops:.3f} GFLOPS" for i, comm, run, gbs, flops in self.runs]

    def summary(self) -> str:
        n = max(1, len(self.runs))
        comm, run, gbs, flops = (sum(r[i] for r in self.runs) / n for i in range(1, 5))
        values = ", ".join(f"y[{i}] = {y:g}" for i, y in self.head) or "no non-zeros among the first positions"
        return f"mean: {comm:.6f} s communication, {run:.6f} s execution, {gbs:.3f} GB/s, {flops:.3f} GFLOPS; {values}"


def task_count(spark: SparkSession, nnz: int) -> int:
    """Partitions for so many entries: as many as there are cores, more if tasks grew too large."""
    return max(1, spark.sparkContext.defaultParallelism, -(-nnz // TASK_ENTRIES))


def cluster(spark: SparkSession) -> dict[str, str]:
    """What runs the queries: cores, executors' settings, versions."""
    conf = dict(spark.sparkContext.getConf().getAll())
    wanted = ("spark.master", "spark.executor.memory", "spark.executor.cores", "spark.executor.instances", "spark.driver.memory")
    return {"version": spark.version, "parallelism": str(spark.sparkContext.defaultParallelism)} | {k: conf[k] for k in wanted if k in conf}


def footprints(matrix: Matrix, parts: int, threads: int = 0, shared: int = 0) -> DataFrame:
    """Bytes per part of the one-dimensional split, as the result file has them."""
    n, c, p = (F.lit(v).cast("bigint") for v in (matrix.shape.n_row, matrix.shape.n_col, parts))
    shards = partition.shards(matrix, parts)
    whole = F.broadcast(shards.agg(F.sum("nnz").alias("all_nnz")))  # one row
    root = metrics.footprint_1d_root(n, c, F.col("all_nnz"), p, n, F.col("all_nnz"))
    other = metrics.footprint_1d(n, c, p, F.col("n_rows"), F.col("nnz"))
    host, device = (F.when(F.col("part") == 0, a).otherwise(b) for a, b in zip(root, other))
    rows = shards.crossJoin(whole).select(
        F.col("part").alias("rank"), F.lit(threads).alias("threads"), F.lit(shared).alias("sharedmem"), F.col("n_rows").alias("n_row"), c.alias("n_col"), "nnz",
        host.alias("host_memory_bytes"), device.alias("gpu_memory_bytes"),
    )
    return sinks.footprint(rows)


def footprints_2d(matrix: Matrix, grid: tuple[int, int], balance: str, threads: int = 0, shared: int = 0) -> DataFrame:
    """Bytes per block of the two-dimensional split, as the result file has them."""
    sizes = [partition.as_table(matrix.spark, t).select(F.col("part").alias(f"{axis}_blk"), F.col("count").alias(f"n_{axis}")) for axis, t in zip(("row", "col"), partition.both_cuts(matrix, grid, balance))]
    placed = partition.block_nnz(matrix, grid, balance).join(sizes[0], "row_blk").join(sizes[1], "col_blk")
    n, r, c = (F.lit(v).cast("bigint") for v in (matrix.shape.n_row, *grid))
    host, device = metrics.footprint_2d(n, r, c, F.col("n_row"), F.col("n_col"), F.col("nnz"))
    rows = placed.select("rank", F.lit(threads).alias("threads"), F.lit(shared).alias("sharedmem"), "n_row", "n_col", "nnz", host.alias("host_memory_bytes"), device.alias("gpu_memory_bytes"))
    return sinks.footprint(rows, balance)


def run_all(matrices: dict[str, Callable[[], Matrix]], strategies: Sequence[str] = spmv.STRATEGIES, balances: Sequence[str] = ("uniform",), save: str | None = None, **options) -> list[Report]:
    """``run`` for every matrix under every strategy; those that cut by weight, under every balance too."""
    return [
        run(name, load, strategy=strategy, balance=balance, save=save, **options)
        for name, load in matrices.items()
        for strategy in strategies
        for balance in (balances if strategy == "grid2d" else balances[:1])
    ]


def _dealt(matrix: Matrix, strategy: str, parts: int, grid: tuple[int, int], balance: str) -> tuple[Callable[[], DataFrame], Callable[[], None]]:
    """The entries laid out as a strategy wants them, written: the product on them, and what deletes them."""
    if strategy == "rows1d":
        rows = dealt.deal(matrix, parts)
        return lambda: dealt.multiply(rows), rows.drop
    if strategy in ("csr", "grid2d"):
        layout = blocks.store(matrix, *(((1, 1), "uniform") if strategy == "csr" else (grid, balance)))
        return lambda: blocks.multiply(layout), layout.drop
    spark, path = matrix.spark, scratch.folder(matrix.spark, "entries")
    matrix.df.write.parquet(path)
    there = replace(matrix, df=spark.read.schema(matrix.df.schema).parquet(path))
    return lambda: spmv.spmv(there, strategy=strategy, parts=parts), lambda: scratch.delete(spark, path)


def run(
    name: str, load: Callable[[], Matrix], strategy: str = "coo", parts: int = 4, grid: tuple[int, int] = (2, 2), balance: str = "uniform",
    total: int = 5, warmup: int = 1, save: str | None = None, threads: int = 0, shared: int = 0,
) -> Report:
    """Benchmark ``load`` and the product with ones.

    Communication is all that happens before a product: reading, splitting and dealing out, done anew in
    every run.  Execution is the product on what the run has dealt.  Warm-up runs do not count.
    """
    report = Report(name, strategy, parts, balance)
    log.info(report.banner())
    now: dict[str, object] = {}

    def deal() -> None:
        now.get("drop", lambda: None)()
        now["matrix"] = load()
        now["product"], now["drop"] = _dealt(now["matrix"], strategy, parts, grid, balance)

    def product() -> DataFrame:
        return densify(now["matrix"].spark, now["product"](), now["matrix"].shape.n_row, "row", {"y": 0.0})

    dealing, executing = [], []
    for i in range(total):
        first = timing.repeat(deal, 1, 0).seconds[0]
        second = timing.repeat(lambda: product().write.format("noop").mode("overwrite").save(), 1, 0).seconds[0]
        if i >= warmup:
            dealing.append(first)
            executing.append(second)
    matrix = now["matrix"]
    nnz, shape, spark = matrix.nnz(), matrix.shape, matrix.spark
    rows, cols, z, t = (F.col(c) for c in ("n_row", "n_col", "nnz", "t"))
    rate = metrics.bandwidth_csr(rows, z, t) if strategy == "csr" else metrics.bandwidth_coo(rows, cols, z, t)
    timed = spark.createDataFrame([(i, c, e, shape.n_row, shape.n_col, nnz, e) for i, (c, e) in enumerate(zip(dealing, executing))], "run int, comm double, exec double, n_row long, n_col long, nnz long, t double")
    report.runs = [tuple(r) for r in timed.select("run", "comm", "exec", rate, metrics.gflops(z, t)).orderBy("run").collect()]  # a row per run
    report.head = [(r.row, r.y) for r in spmv.head(product()).collect()]
    now["drop"]()
    for line in report.lines():
        log.info(line)
    log.info(report.summary())
    if save:
        folder = sinks.folder(save, name, parts, strategy, balance, threads, shared)
        sinks.write_csv(sinks.statistics(spark, report.runs), f"{folder}/statistics")
        sinks.write_csv(footprints_2d(matrix, grid, balance, threads, shared) if strategy == "grid2d" else footprints(matrix, parts, threads, shared), f"{folder}/memory_footprint")
    return report
