"""Sharding by jump consistent hashing: a key and the number of shards decide, without a ring table.

A key's 64-bit hash drives a sequence of jumps to ever larger shard numbers; its shard is the
last one below the number of shards.  Appending a shard therefore moves rows only into the
new one, one in (n + 1) of them.

Odd rows: a null key is hashed as the empty text; null texts have no bytes; rows with equal keys
share a shard and differ in their slots, which follow key (null first), size and checksum, and are
dealt in any order among rows equal in all three.  Columns beyond key and text are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: The multiplier of the generator behind the jumps, and its output's range.
MULTIPLIER = 2862933555777941757
RANGE = float(1 << 31)
#: Hexadecimal digits of a key's MD5 that make its hash, so that it fits a signed 64-bit number.
DIGITS = 15


def jump(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every hash: all keys take their next jump together until none lands below ``shards``."""
    if shards < 1:
        raise ValueError("there is at least one shard")
    state = hashes.astype(np.uint64)
    at, onto = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = onto[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)  # modulo 2**64
        onto[live] = ((at[live] + 1) * (RANGE / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[onto[live] < shards]
    return at.astype(np.int32)


def key_hash(*keys: str) -> Column:
    """A hash of key columns that does not depend on types, machines or versions."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def shard_of(hashes: Column, shards: int) -> Column:
    """The shard of a column of hashes; only the hashes travel to Python."""

    @F.pandas_udf("int")
    def land(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(), shards))

    return land(hashes)


def assign(df: DataFrame, key: str | list[str] = "doc_id", shards: int = 16, name: str = "shard") -> DataFrame:
    """All rows and columns with ``name``, the shard."""
    return df.withColumn(name, shard_of(key_hash(*([key] if isinstance(key, str) else key)), shards))


def moved(df: DataFrame, key: str | list[str] = "doc_id", shards: int = 16) -> DataFrame:
    """The rows that leave their shard when one is appended: what a copy to the new shard has to hold."""
    grown = assign(assign(df, key, shards), key, shards + 1, "__grown")
    return grown.where(F.col("__grown") != F.col("shard")).drop("shard", "__grown")


def write(df: DataFrame, path: str, key: str | list[str] = "doc_id", shards: int = 16, rows_per_file: int = 0) -> None:
    """All rows as Parquet in one folder a shard.

    Rows are not shuffled: every task adds a file to the shards it has rows of, so that no
    key or shard, however large, meets in one task.
    """
    assign(df, key, shards).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def number(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``slot``, their place in their group (not null) from 0 by ``order``, without gaps.

    Rows are range-partitioned by group, order and place of origin, so that no group or run of
    equal rows is one task's work; the sorted rows are written once with their places in their
    partitions, and one small row a partition and group says how many rows of the group come before.
    """
    spread = df.withColumn("__origin", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(group, *order, "__origin").sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of a row's place in it
    placed = cut(ordered.drop("__origin").withColumn("__place", place), "slots")
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    runs = placed.groupBy(group, part.alias("__part")).agg(F.min(inside).alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    # a row a partition and group: at most the partitions and the groups together
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), [group, "__part"])
    return joined.withColumn("slot", inside + F.col("__offset")).select(*df.columns, "slot")


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Per row: key, ``size`` (bytes of the text and one), ``text_crc32``, ``law``, ``shard``, ``slot`` in the shard, ``grown_shard`` (with one shard more)."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), key_hash(key).alias("__hash")
    )
    # a few bytes a row are written, so that the range partitioning samples them and not the texts
    rows = cut(slim.select("doc_id", "size", "text_crc32", shard_of(F.col("__hash"), shards).alias("shard"), shard_of(F.col("__hash"), shards + 1).alias("grown_shard")), "shards")
    numbered = number(rows, "shard", "doc_id", "size", "text_crc32")
    discard(rows)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
