"""Spelling variants: words one edit apart, found in groups and never as pairs.

A word of m code points stands in m wildcard groups, one for each (position, prefix, suffix);
the members of a group differ by one replaced code point.  Each of its m deletions joins the
vocabulary; a hit is a word one indel apart.  A group has at most a member for each sign of the
alphabet, a vocabulary word at most (length + 1) times as many longer neighbours, so that no group
grows with the data.  What a group tells its members is its size and its best word, or its
second best to the best; a word adds these up over its groups.

Words have ranks by number of occurrences (larger first) and code-point order, so that the best
of several words is the one of least rank, and rows carry ranks instead of words.  Strings of more
than ``LITERAL`` code points stand for themselves by position and 127-bit polynomial
hashes of prefix and suffix, so that a word of any length gives rows in proportion to it.

Odd rows: null and empty texts have no words; a null id is the empty text before the colon of the
checksum; repeated rows count repeatedly; columns beyond id and text are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, discard, release
from .shards import number

#: What a run is (upper-case A-Z is lower by then), and how rarely a run loses a code point.
RUN = re.compile("[a-zÀ-ÿ]+")
ONE_IN = 97
#: Words of fewer code points or occurrences are left out.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words that a task counts before it hands its counts on.
HELD = 200_000
#: Code points up to which strings are keys as they are.
LITERAL = 64
#: Rows of keys in one batch.
KEYS = 50_000
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1234567
WILD, DELETED, ITSELF = 0, 1, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(ident: object, text: bytes) -> Counter:
    """Occurrences of a text's runs, those that the checksum picks without one code point."""
    start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
    out: Counter = Counter()
    for run, n in Counter(m.group() for m in RUN.finditer(text.translate(LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough; a task adds up what it can hold before the shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in runs_of(i, t).items() if t else ():
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield handed()
                    held.clear()
        yield handed()
        held.clear()
        release(None)

    counted = docs.select(F.col(ident).alias("doc_id"), as_bytes(text)).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def neighbourhood(word: str) -> Iterator[tuple[str, int]]:
    """Keys of a word: its wildcard groups, its distinct deletions, itself."""
    m, short = len(word), len(word) <= LITERAL
    if m <= LITERAL + 1:
        deleted = {word[:i] + word[i + 1 :] for i in range(m)}
        yield from ((d, DELETED) for d in deleted if len(d) >= LEAST_LENGTH)
    if short:
        yield from ((f"{word[:i]}*{word[i + 1:]}", WILD) for i in range(m))
        yield word, ITSELF
        return
    before = [0]
    for c in word:
        before.append((before[-1] * BASE + ord(c) + 1) % PRIME)
    yield f"{m}={before[m]:x}", ITSELF
    after, power = 0, 1
    for i in range(m - 1, -1, -1):
        yield f"{m}:{i}:{before[i]:x}:{after:x}", WILD
        # runs of one sign have the same deletion: the last of a run stands for it
        if m > LITERAL + 1 and (i == m - 1 or word[i] != word[i + 1]):
            yield f"{m - 1}={(before[i] * power + after) % PRIME:x}", DELETED
        after = (after + (ord(word[i]) + 1) * power) % PRIME
        power = power * BASE % PRIME


def keyed(words: DataFrame) -> DataFrame:
    """(key, kind, rank) of every key of (rank, word)."""
    bounded_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        kinds: list[int] = []
        ranks: list[int] = []

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(ranks, pa.int64())], names=["key", "kind", "rank"])

        for batch in batches:
            for rank, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, kind in neighbourhood(word):
                    keys.append(key)
                    kinds.append(kind)
                    ranks.append(rank)
                    if len(keys) >= KEYS:
                        yield handed()
                        for x in (keys, kinds, ranks):
                            x.clear()
        yield handed()
        release(None)

    return words.select("rank", "word").mapInArrow(run, "key string, kind byte, rank bigint")


def told(keys: DataFrame) -> DataFrame:
    """(rank, n, best) that each group tells each of its members: near words in it, and the best of them."""
    group = Window.partitionBy("key")
    ordered = group.orderBy("rank")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    wild = F.col("kind") == WILD
    seen = keys.select(
        "rank", "kind",
        F.count(F.lit(1)).over(group).alias("size"),
        F.row_number().over(ordered).alias("place"),
        F.first("rank").over(whole).alias("top"),
        F.lead("rank").over(ordered).alias("next"),
        F.max(of(ITSELF, F.col("rank"))).over(group).alias("itself"),
        F.count(of(DELETED, F.lit(1))).over(group).alias("longer"),
        F.min(of(DELETED, F.col("rank"))).over(group).alias("best_longer"),
    )
    near = F.when(wild, F.col("size") - 1).when(F.col("kind") == ITSELF, F.col("longer")).otherwise(F.when(F.col("itself").isNotNull(), 1).otherwise(0))
    best = F.when(wild, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))).when(F.col("kind") == ITSELF, F.col("best_longer")).otherwise(F.col("itself"))
    return seen.select("rank", near.cast("bigint").alias("n"), best.alias("best")).where("n > 0")


def follow(links: DataFrame) -> DataFrame:
    """(rank, root) at the end of the links (rank, root): every round doubles the steps, until none is left.

    Counts double along a link, so a chain has as many links as a count has binary digits at most.
    """
    links = cut(links, "forms")
    while True:
        ahead = links.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        moved = cut(links.join(ahead, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(links)
        links = moved
        if links.where("moved").isEmpty():
            return links.select("rank", "root")


def variants(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: ``form`` (its near word of largest count if that is twice its own), ``root``, ``n``, ``n_near``, ``form_n``."""
    counted = cut(vocabulary(docs, ident, text).select("word", "n", (-F.col("n")).alias("down"), F.lit(0).alias("all")), "words")
    ranked = number(counted, "all", "down", "word")
    words = cut(ranked.select(F.col("slot").alias("rank"), "word", "n"), "words")
    discard(counted)
    near = cut(told(keyed(words)).groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")), "near")
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    links = words.join(near, "rank").join(other, "best").where(F.col("form_n") >= 2 * F.col("n"))
    named = links.select("rank", "form", "form_n")
    roots = follow(links.select("rank", F.col("best").alias("root"))).join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root")
    found = words.join(near.select("rank", "n_near"), "rank", "left").join(named, "rank", "left").join(roots.select("rank", "root_word"), "rank", "left")
    return found.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
