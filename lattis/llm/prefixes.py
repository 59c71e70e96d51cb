"""The prefix trie of conversations, built level by level.

Going down, a live conversation knows its node; the conversations of a node with the same next
turn make a child, named by its smallest member.  A conversation stays live only while its
node has other members, since alone it is a chain of known shape.  Coming up, every level's
children are added up by parent: children, leaves and saved words.  So there are as many rounds as
the longest prefix that two conversations share, whatever the length of single ones.  Counts and
minima are combined before a shuffle; only the digest of a node's ends streams through one task,
in constant memory, as SHA-256 is sequential.

Turns travel as (SHA-256 of role and text, number of words), texts are read once.

Odd rows: null roles and texts are empty; turns of one conversation with the same number
follow their digests; repeated rows are turns of their own; rows without a conversation are left
out; no conversations give no nodes.  Columns beyond the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, new_path

#: What a word is, the size of a family of conversations, the longest prefix taken over is one less than ``PREFIXES``.
WORD, BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
FAMILY, PREFIXES = 20, 4
#: Turns numbered in one window; a longer conversation's are numbered by many tasks.
SPAN = 4096


def words(text: Column) -> Column:
    """Number of words, in memory of the text's size."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "w"), BLANKS, "")).cast("bigint")


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): every turn with its place from 0, its digest and its number of words."""
    role_text, content = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    slim = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role_text).cast("string"), F.lit(":"), role_text, content), 256)).alias("key"), words(content).alias("words"),
    )
    slim = cut(slim.withColumn("span", F.floor(F.col("turn") / SPAN)), "turns")
    before = Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "key")
    placed = slim.withColumn("inside", F.row_number().over(inside) - 1)
    found = placed.join(starts, (F.col("conv_id") == F.col("c")) & F.col("span").eqNullSafe(F.col("s")))
    out = cut(found.select("conv_id", (F.col("start") + F.col("inside")).alias("pos"), "key", "words"), "turns")
    discard(slim)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, key, words) and lengths (conv_id, len) of conversations whose first turns are those of their family's first."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(PREFIXES))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = cut(convs, "convs")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("given"))
    plan = cut(convs.join(heads, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")), "convs")
    discard(convs)
    first = turns.where((F.col("pos") < PREFIXES - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    shared = plan.join(first, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "words")
    rest = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "key", "words")
    # sorted by depth, so that a level reads little besides its own rows
    out = cut(shared.unionByName(rest).sortWithinPartitions("depth"), "rebuilt")
    return out, plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


def digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id): the members' numbers in order stream through the digest."""
    bounded_batches(ends.sparkSession)
    ordered = ends.select("depth", "node", "conv_id").repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (depth, node):
                    if place:
                        done.append((*place, digest.hexdigest()))
                    place, digest = (depth, node), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield handed(done)
        if place:
            yield handed([(*place, digest.hexdigest())])

    def handed(done: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)] or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])

    return ordered.mapInArrow(run, "depth bigint, node bigint, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, depth from 1, key, words) of conversations (conv_id, len), the root at depth 0."""
    spark = turns.sparkSession
    folder = new_path(spark, "trie")
    everyone = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.min("len").alias("len")).first()
    kept = "conv_id bigint, parent bigint, n_convs bigint, words bigint, len bigint"

    def level(kind: str, depth: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{kind}/depth={depth}")

    spark.createDataFrame([(everyone.node, None, everyone.n, 0, everyone.len)] if everyone.n else [], kept).write.parquet(f"{folder}/nodes/depth=0")
    alive = "conv_id bigint, node bigint, len bigint"
    lengths.where(F.lit(everyone.n > 1)).select("conv_id", F.lit(everyone.node).cast("bigint").alias("node"), "len").write.parquet(f"{folder}/live/depth=0")
    depth, live = 0, level("live", 0, alive)
    while not live.where(F.col("len") > depth).isEmpty():
        here = turns.where(F.col("depth") == depth + 1).select("conv_id", "key", "words")
        step = cut(live.where(F.col("len") > depth).join(here, "conv_id"), "step")
        children = step.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("len").alias("len"))
        children = cut(children, "children")
        depth += 1
        children.select("conv_id", F.col("node").alias("parent"), "n_convs", "words", "len").write.parquet(f"{folder}/nodes/depth={depth}")
        named = children.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("child"))
        step.join(named, ["node", "key"]).select("conv_id", F.col("child").alias("node"), "len").write.parquet(f"{folder}/live/depth={depth}")
        discard(step, children)
        live = level("live", depth, alive)
    nodes = spark.read.schema(f"{kept}, depth int").parquet(f"{folder}/nodes").withColumn("depth", F.col("depth").cast("bigint"))
    rolled = "conv_id bigint, parent bigint, n_convs bigint, len bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    for d in range(depth, -1, -1):
        here, own = level("nodes", d, kept), (F.col("n_convs") - 1) * F.col("words")
        if d < depth:
            below = level("rolled", d + 1, rolled).groupBy(F.col("parent").alias("conv_id"))
            sums = below.agg(F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            here = here.join(sums, "conv_id", "left")
        else:
            here = here.select("*", *(F.lit(None).cast("bigint").alias(c) for c in "kls"))
        alone = F.when((F.col("n_convs") == 1) & (F.col("len") > d), 1).otherwise(0)
        here.select(
            "conv_id", "parent", "n_convs", "len", F.coalesce("k", alone).cast("bigint").alias("n_children"),
            F.coalesce("l", F.lit(1)).cast("bigint").alias("n_leaves"), (own + F.coalesce("s", F.lit(0))).cast("bigint").alias("saved_tokens"),
        ).write.parquet(f"{folder}/rolled/depth={d}")
    up = spark.read.schema(f"{rolled}, depth int").parquet(f"{folder}/rolled").withColumn("depth", F.col("depth").cast("bigint"))
    shared = spark.read.schema(f"{alive}, depth int").parquet(f"{folder}/live").where("len = depth")
    ends = digests(shared.select(F.col("depth").cast("bigint").alias("depth"), "node", "conv_id"))
    single = nodes.where("n_convs = 1").select("conv_id", F.col("depth").alias("from"), "len")
    chains = turns.select("conv_id", "depth").join(single, "conv_id").where("depth > from").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("conv_id").alias("parent"), F.lit(1).cast("bigint").alias("n_convs"), "len",
        F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
    )
    none, own = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    alone = F.when((F.col("n_convs") == 1) & (F.col("depth") == F.col("len")), own)
    every = up.join(ends.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left").unionByName(chains.withColumn("ends_sha256", F.lit(None).cast("string")))
    return every.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", alone, none).alias("ends_sha256")
    )


def prefix_trie(df: DataFrame, rebuild: bool = True) -> DataFrame:
    """The trie of a table of conversations, of those whose first turns are their family's if ``rebuild``."""
    turns = numbered(df)
    if rebuild:
        return trie(*rebuilt(turns))
    return trie(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "words"), turns.groupBy("conv_id").agg(F.count("*").alias("len")))
