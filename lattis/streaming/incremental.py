"""Row sums kept up to date while entries stream in (an addition, not a reference feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_product(entries: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(row, y) of a stream of (row, col, val), joined to a static x; write it in complete or update mode."""
    joined = entries.withColumn("p", F.col("val")) if x is None else entries.join(x, "col").withColumn("p", F.col("val") * F.col("x"))
    return joined.groupBy("row").agg(F.sum("p").alias("y"))


def windowed_product(entries: DataFrame, when: str, width: str, late: str, x: DataFrame | None = None) -> DataFrame:
    """(window, row, y) per event-time window; entries later than ``late`` are dropped."""
    marked = entries.withWatermark(when, late)
    joined = marked.withColumn("p", F.col("val")) if x is None else marked.join(x, "col").withColumn("p", F.col("val") * F.col("x"))
    return joined.groupBy(F.window(when, width), "row").agg(F.sum("p").alias("y"))
