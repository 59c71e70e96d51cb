"""The queries of this subpackage: ``op1_`` to ``op13_`` over whole tables.

Each function takes (spark, sf_dir) and returns the operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Path of the public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; what odd rows give is stated in ``simhash``."""
    from . import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document; what odd rows give is stated in ``decontaminate``."""
    from . import decontaminate

    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back; what odd rows give is stated in ``warc``."""
    from . import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; what odd rows give is stated in ``multiindex``."""
    from . import multiindex

    return multiindex.link(_table(spark, sf_dir, "embeddings"))


#: The conversation that holds the template's control strings as text.
CONFLICT = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back; what odd rows give is stated in ``chat``."""
    from . import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; what odd rows give is stated in ``secrets``."""
    from . import secrets

    found = secrets.find(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", secrets.base_digest(F.col("base")).alias("base_sha256"), "spans")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded; what odd rows give is stated in ``bpe``."""
    from . import bpe

    return bpe.digest_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; what odd rows give is stated in ``toxicity``."""
    from . import toxicity

    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document; what odd rows give is stated in ``quality``."""
    from . import quality

    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; what odd rows give is stated in ``ppm``."""
    from . import ppm

    return ppm.score(_table(spark, sf_dir, "documents"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; what odd rows give is stated in ``shards``."""
    from . import shards

    return shards.place(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the spelling that each is a variant of; what odd rows give is stated in ``spelling``."""
    from . import spelling

    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations; what odd rows give is stated in ``prefixes``."""
    from . import prefixes

    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
