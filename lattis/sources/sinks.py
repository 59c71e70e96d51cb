"""Result sinks: run statistics and footprints as CSV, under one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the result files.
STATISTICS = ["ID", "Communication(s)", "Execution(s)", "Bandwidth(GB/s)", "FLOPS(GFLOPS)"]
FOOTPRINT = ["rank", "threads", "sharedmem", "n_row", "n_col", "nnz", "host_memory_bytes", "gpu_memory_bytes", "total_memory_bytes", "total_memory_megabytes"]


def folder(save: str, matrix: str, parts: int, mode: str, balance: str = "none", threads: int = 0, shared: int = 0) -> str:
    """Results of one configuration; all of it is part of the path, so that runs never mix."""
    return f"{save.rstrip('/')}/matrix={matrix}/parts={parts}/mode={mode}/threads={threads}/shared={shared}/lb={balance}"


def statistics(spark: SparkSession, runs: list[tuple[int, float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame(runs, "run int, comm_s double, exec_s double, bandwidth_gbs double, gflops double").toDF(*STATISTICS)


def footprint(df: DataFrame, balance: str | None = None) -> DataFrame:
    """Per part with host and device bytes: all columns of the file, with totals."""
    out = df.withColumn("total_memory_bytes", F.col("host_memory_bytes") + F.col("gpu_memory_bytes")).withColumn("total_memory_megabytes", F.col("total_memory_bytes") / 1e6)
    if balance is None:
        return out.select(*FOOTPRINT)
    return out.withColumn("load balance mode", F.lit(balance)).select("rank", "load balance mode", *FOOTPRINT[1:])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
