"""Ordinary tables as sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Matrix, Shape

#: Codes of event types as columns.
EVENT_TYPES = ["view", "signup", "purchase", "click", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(df: DataFrame, key: str) -> int:
    """Length of an axis whose indices are the key's values, from 0."""
    top = df.agg(F.max(key)).first()[0]
    return 0 if top is None else int(top) + 1


def orders_parts(spark: SparkSession, sf_dir: str, single: bool = False) -> Matrix:
    """Quantity by order and part; repeated pairs add up."""
    shape = Shape(size(table(spark, sf_dir, "orders"), "o_orderkey"), size(table(spark, sf_dir, "part"), "p_partkey"))
    return Matrix.of(table(spark, sf_dir, "lineitem"), shape, "l_orderkey", "l_partkey", "l_quantity", single)


def suppliers_parts(spark: SparkSession, sf_dir: str) -> Matrix:
    """Price by supplier and part: few rows, each a hub."""
    shape = Shape(size(table(spark, sf_dir, "supplier"), "s_suppkey"), size(table(spark, sf_dir, "part"), "p_partkey"))
    return Matrix.of(table(spark, sf_dir, "lineitem"), shape, "l_suppkey", "l_partkey", "l_extendedprice")


def vectors(spark: SparkSession, sf_dir: str) -> Matrix:
    """Embeddings, a dense matrix in coordinate form."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return Matrix.of(df, Shape(size(table(spark, sf_dir, "embeddings"), "vec_id"), 64), "vec_id", "pos", "v")


def users_events(spark: SparkSession, sf_dir: str) -> Matrix:
    """Values of events by user and event type."""
    df = table(spark, sf_dir, "events")
    kind = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return Matrix.of(df.withColumn("kind", kind).where("kind >= 0"), Shape(size(df, "user_id"), len(EVENT_TYPES)), "user_id", "kind", "value")
