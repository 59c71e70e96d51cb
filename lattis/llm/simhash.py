"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes of the
text's word shingles, repeats included.  Two fingerprints link at ``MAX_BITS`` = 2 or fewer
differing bits, so at least six of their eight positional bytes agree (the guaranteed
minimum of the count filter), and at least two of the four byte pairs do.

Index.  Postings of single bytes would hold a 256th of all fingerprints each, which makes
tallies quadratic.  So the index has blocks: fingerprints that agree on two of the four byte
pairs, of which any linked two share one at least.  Inside a block each fingerprint is filed
under each of its four other byte positions with the value there.  The index is joined by
postings, a pair's shared postings are tallied, and pairs whose tally and the block's four
positions reach the guaranteed minimum stay and are verified bit by bit.

Hot postings.  A posting of more than ``POSTING`` fingerprints never meets as pairs.  Its
members agree on five positions; they are filed again under each of their 25 variants with at
most one of the 24 other bits flipped: two of them share a variant exactly if they differ in
two or fewer bits, and a variant has at most 65 members.  Each such group is linked as a star,
which keeps every connection.  A linked pair shares two postings of a block at least: either
both are tallied or one is hot, so no pair is lost.

Only distinct fingerprints travel (copies collapse first, combined before the shuffle);
groups are found by ``graph.components``.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like all
others; fewer words than a shingle: the whole sequence is the one shingle; repeated rows
each get a row; a null id gets a row and is never the smallest id; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .graph import components

SEED = 42
MAX_BITS, MIN_BYTES = 2, 6
#: Members of a posting up to which its pairs are tallied one by one.
POSTING = 32
#: Hashes in memory at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(w) - words + 1]
    ends = ends[words - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """Columns ``keep`` of every row, and ``fp``: the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

    return map_texts(df, keep, text, make, "fp bigint")


#: Positions of a block: two of the four byte pairs.
BLOCKS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i in range(4) for j in range(i + 1, 4)]


def _mask(positions: Iterable[int]) -> int:
    """The bits of some byte positions, as a signed number."""
    m = sum(0xFF << 8 * p for p in set(positions))
    return m - (1 << 64) if m >> 63 else m


def _masks() -> tuple[list[int], list[list[int]]]:
    """The mask of every block, and those of the postings inside it."""
    return [_mask(b) for b in BLOCKS], [[_mask((*b, p)) for p in range(8) if p not in b] for b in BLOCKS]


def _shared(index: DataFrame, keys: list[str]) -> DataFrame:
    """The entries whose key has several, with ``n``, their number."""
    keyed = index.withColumn("k", F.xxhash64(*keys))
    return keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k")


def links(prints: DataFrame, posting: int = POSTING) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` of a table: they join all that link."""
    blocks, postings = _masks()
    fp = F.col("fp")
    filed = prints.select("fp", F.explode(F.lit(list(range(len(blocks))))).alias("c"))
    in_block = _shared(filed.withColumn("value", fp.bitwiseAND(F.get(F.lit(blocks), F.col("c")))), ["c", "value"])
    index = in_block.select("fp", "c", F.explode(F.get(F.lit(postings), F.col("c"))).alias("mask"))
    met = _shared(index.withColumn("value", fp.bitwiseAND(F.col("mask"))), ["mask", "value"])
    tallied = (
        met.where(F.col("n") <= posting)
        .groupBy("c", "mask", "value")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("c", F.explode("fps").alias("a"), "fps")
        .select("c", "a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
        .groupBy("a", "b", "c")
        .agg(F.count("*").alias("shared"))
    )
    pairs = tallied.where((F.col("shared") + len(BLOCKS[0]) >= MIN_BYTES) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = F.transform(F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0), lambda f: fp.bitwiseXOR(f))
    stars = (
        met.where(F.col("n") > posting)
        .select("fp", F.explode(F.concat(F.array("fp"), near)).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a != b")
    )
    return pairs.unionByName(stars)


def groups(prints: DataFrame, ident: str = "doc_id", posting: int = POSTING) -> DataFrame:
    """Rows of (ident, fp) with ``component_id``, the smallest ident of their group.

    ``prints`` is read several times: pass a table from the shared folder.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min(ident).alias("least")), "fps")
    found = components(links(distinct.select("fp"), posting)).withColumnRenamed("node", "fp")
    member = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(member.join(smallest, "component").select("fp", "component_id"), "groups")
    return prints.join(named, "fp", "left")


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Per row: ident, ``fingerprint`` (16 lower-case hex digits), ``component_id``."""
    prints = cut(fingerprints(df, [ident], text, words), "prints")
    return groups(prints, ident).select(ident, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
