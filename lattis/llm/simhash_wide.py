"""Near-dedup of texts at a similarity by SimHash, completed by a prefix filter: the pipeline's form of ``simhash``.

Two texts are near copies if the sets of their five-word shingles (as 64-bit hashes) have a
Jaccard similarity of 0.8 or more.

SimHash.  The fingerprints of ``simhash`` are linked by its byte-position index with tally and verification;
a link counts if the exact similarity of the two sets confirms it.  What these links join is known and
does not meet again.  Fingerprints within two bits are not all pairs of that similarity: the index below finds the rest.

Index.  Under any one order of all shingles, two sets of that similarity share a shingle among
the first ``n - ceil(0.8 n) + 1`` of each (prefix filter), so that postings keyed by the
shingles of prefixes miss no pair.  Shingles that are common in a bounded sample come last in the
order: texts that share a template, but are unlike beyond it, do not meet by its shingles.

Links.  Every pair is decided by the exact similarity of its sets, unless their sizes and places in a posting
rule it out (the first shingle that they share leaves too few to share).  First the members of each
posting are compared with its smallest one; what these stars join needs no further look.  In
postings that still hold several components, all pairs across components are compared: those
of up to ``SMALL`` members one by one, once for all postings.  What larger ones leave undecided are pairs of
their own members, so these texts are a smaller task of the same kind, which is solved anew under the order of
exact counts among them: the shingles that made them meet now come last.  Postings that are large even then,
whose texts are made of frequent shingles to four fifths, are compared in chunks of about ``BLOCK``
members, every two of which meet.

Only distinct sets travel.  Defined cases: null, empty and blank texts are copies of
each other; of a group the row with the smallest id stays (null last), of equal ids one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, discard, map_texts, release
from .graph import components
from . import simhash
from .multiindex import spanning
from .simhash import SEED

WORDS, SIMILARITY = 5, 0.8
SMALL, BLOCK = 32, 256
#: Rows of ids or posting keys up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
#: Texts whose shingles are counted, and the most frequent of these, which come last in the order.
SAMPLE, COMMON = 20_000, 500_000
#: Shingles whose columns are multiplied at a time.
COLUMNS_AT_ONCE = 4096


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's set of shingles."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(w) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64).view(np.int64))


def ratio(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction, so that pairs at exactly 0.8 are decided in whole numbers."""
    exact = Fraction(str(similarity))
    return exact.numerator, exact.denominator


def digests(df: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """Columns ``keep`` and 128 bits that are equal for equal sets."""

    def make():
        def work(texts):
            sets = [shingles(t, words).tobytes() for t in texts]
            return [np.array([xxhash.xxh64_intdigest(s, seed) for s in sets], np.uint64).view(np.int64).tolist() for seed in (1, 2)]

        return work

    return map_texts(df, keep, text, make, "k1 bigint, k2 bigint")


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(cid, hashes): the set of every text."""

    def make():
        def work(batch):
            found = [shingles(t, words) for t in batch]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))]  # no Python number for each hash

        return work

    return map_texts(texts, ["cid"], "text", make, "hashes array<bigint>")


def common(texts: DataFrame, n: int, words: int = WORDS, sample: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles of a sample of texts, and in how many of these they stand."""
    share = min(1.0, (SAMPLE if sample is None else sample) / max(n, 1))
    picked = texts.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found = sets(picked, words).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    table = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, counts = (table[c].to_numpy().astype(np.int64) for c in ("h", "n"))
    at = np.argsort(h)
    return h[at], counts[at]


def postings(texts: DataFrame, last: tuple[np.ndarray, np.ndarray], words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(posting, cid, size, place): every text under the shingles of its prefix, with their places in it."""
    bounded_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(last)
    num, den = ratio(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, keys, sizes, places = [], [], [], []
                for cid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h = shingles(text, words)
                    if not len(h):
                        continue
                    first = len(h) + (-len(h) * num // den) + 1  # len(h) - ceil(similarity * len(h)) + 1
                    if len(known):
                        place = np.searchsorted(known, h).clip(max=len(known) - 1)
                        h = h[np.lexsort((h, np.where(known[place] == h, counts[place], 0)))]
                    keys.append(h[:first])
                    ids.append(np.full(len(keys[-1]), cid))
                    sizes.append(np.full(len(keys[-1]), len(h), np.int32))
                    places.append(np.arange(len(keys[-1]), dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes, places)], names=["posting", "cid", "size", "place"])
        release(None)

    return texts.select("cid", as_bytes()).mapInArrow(run, "posting bigint, cid bigint, size int, place int")


def similar(h1: F.Column, h2: F.Column, similarity: float) -> F.Column:
    """Whether two sets are as similar: shared * (1 + s) >= (both sizes) * s."""
    num, den = ratio(similarity)
    return (F.size(F.array_intersect(h1, h2)) * F.lit(num + den)) >= ((F.size(h1) + F.size(h2)) * F.lit(num))


def possible(x: F.Column, y: F.Column, similarity: float) -> F.Column:
    """Whether two members of a posting can be near copies of which it is the first shared shingle."""
    num, den = ratio(similarity)
    left = F.least(x["size"] - x["place"], y["size"] - y["place"]).cast("long")
    return left * F.lit(num + den) >= (x["size"] + y["size"]) * F.lit(num)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are near copies."""
    pairs = cut(pairs.distinct(), "pairs")
    ends = cut(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "ends")
    known = cut(sets(among(texts, ends), words), "sets")
    one, two = (known.select(F.col("cid").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    found = cut(pairs.join(one, "a").join(two, "b").where(similar(F.col("ha"), F.col("hb"), similarity)).select("a", "b"), "near")
    discard(pairs, ends, known)
    return found


def among(texts: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "cid", how)


def near(one: list[np.ndarray], two: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of one list are as similar to which of another."""
    num, den = ratio(similarity)
    n1, n2 = (np.array([len(x) for x in side], np.int64) for side in (one, two))
    names, column = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row1, row2 = np.repeat(np.arange(len(one)), n1), np.repeat(np.arange(len(two)), n2)
    col1, col2 = column[: n1.sum()], column[n1.sum() :]
    both = np.flatnonzero((np.bincount(col1, minlength=len(names)) > 0) & (np.bincount(col2, minlength=len(names)) > 0))
    new = np.full(len(names), -1)
    new[both] = np.arange(len(both))
    col1, col2 = new[col1], new[col2]
    shared = np.zeros((len(one), len(two)), np.int64)
    for at in range(0, len(both), COLUMNS_AT_ONCE):
        sides = []
        for row, col, n in ((row1, col1, len(one)), (row2, col2, len(two))):
            held = (col >= at) & (col < at + COLUMNS_AT_ONCE)
            m = np.zeros((n, COLUMNS_AT_ONCE), np.float32)
            m[row[held], col[held] - at] = 1
            sides.append(m)
        shared += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return shared * (num + den) >= (n1[:, None] + n2[None, :]) * num


def by_fingerprints(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of the near copies that SimHash finds: the links of ``simhash`` that the exact similarity confirms.

    Texts of one fingerprint meet the smallest of them, which stands for them in the index.
    """
    prints = cut(simhash.fingerprints(texts, ["cid"]), "prints")
    hubs = cut(prints.groupBy("fp").agg(F.min("cid").alias("hub")), "print-hubs")
    equal = prints.join(hubs, "fp").where("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    one, two = (hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"h{c}")) for c in "ab")
    linked = simhash.links(hubs.select("fp")).join(one, "a").join(two, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    found = verified(equal.unionByName(linked), texts, words, similarity)
    discard(prints, hubs)
    return found


def links(texts: DataFrame, n: int, words: int = WORDS, similarity: float = SIMILARITY, exact: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that join the near copies among ``n`` texts (cid and text) of distinct sets.

    ``exact``: shingles are counted in all texts, not in a sample, for their order.  ``known``: components (node,
    component) of near copies found before, whose members need not meet again.
    """
    filed = cut(postings(texts, common(texts, n, words, n if exact else None), words, similarity), "postings")
    # joined by key at any size: adaptive execution splits the partitions of hot postings
    sizes = cut(filed.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = cut(filed.join(sizes, "posting"), "members")
    discard(filed, sizes)
    member = F.struct("cid", "size", "place")
    hubs = cut(members.groupBy("posting").agg(F.min(member).alias("hub")), "hubs")
    met = members.join(hubs, "posting").where(F.col("cid") != F.col("hub.cid"))
    met = met.where(possible(F.col("hub"), member, similarity)).select(F.col("hub.cid").alias("a"), F.col("cid").alias("b"))
    near_hubs = verified(met if known is None else unjoined(met, known), texts, words, similarity)
    stars = cut(components(near_hubs if known is None else near_hubs.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))), "stars")
    discard(hubs, near_hubs)
    parted = members.where("n > 2").join(stars.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    parted = cut(parted, "parted")
    still = parted.groupBy("posting").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("posting")
    still = cut(still, "open")
    open_ = cut(parted.join(still, "posting", "left_semi"), "still")
    discard(members, parted, still)
    parted = open_
    small = parted.where(F.col("n") <= SMALL).groupBy("posting").agg(F.collect_list(F.struct("cid", "size", "place", "component")).alias("all"))
    small = small.select(F.explode("all").alias("x"), "all")
    across = F.filter("all", lambda y: (y["cid"] > F.col("x.cid")) & (y["component"] != F.col("x.component")) & possible(F.col("x"), y, similarity))
    # the smallest member has met all others
    across = F.when(F.col("x.cid") != F.array_min(F.transform("all", lambda y: y["cid"])), across)
    pairs = small.select(F.col("x.cid").alias("a"), F.explode(F.transform(across, lambda y: y["cid"])).alias("b"))
    edges = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(pairs, texts, words, similarity))
    large = cut(parted.where(F.col("n") > SMALL).select("posting", "n", "cid"), "large")
    discard(parted)
    rest = forests(large, texts, words, similarity) if exact else again(large, texts, words, similarity)
    joined = cut(edges.unionByName(rest), "links")
    discard(stars, large, rest)
    return joined


def unjoined(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are not in one of the components."""
    few = known.count() <= BROADCAST_ROWS
    for c in "ab":
        side = known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        pairs = pairs.join(F.broadcast(side) if few else side, c, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def again(large: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) that join the near copies among all members of large postings, by an order of their own."""
    ids = cut(large.select("cid").distinct(), "large-ids")
    n = ids.count()
    if not n:
        discard(ids)
        return large.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    own = cut(among(texts, ids), "large-texts")
    found = links(own, n, words, similarity, exact=True)
    discard(ids, own)
    return found


def forests(large: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) that join the near copies within postings: members are dealt to chunks, and every two chunks meet."""
    ids = cut(large.select("cid").distinct(), "large-ids")
    known = cut(sets(among(texts, ids), words), "large-sets")
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = large.select("posting", "cid", chunks.alias("chunks"), F.pmod(F.xxhash64("cid", "posting"), chunks).cast("int").alias("own"))
    met = dealt.select("posting", "cid", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select("posting", "cid", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")).join(known, "cid")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        own, one, two = (pdf[c].to_numpy() for c in ("own", "one", "two"))
        first, second = pdf[own == one], pdf[own == two]
        ids1, ids2 = first["cid"].to_numpy(), second["cid"].to_numpy()
        sets1, sets2 = ([np.asarray(x, np.int64) for x in side["hashes"]] for side in (first, second))
        edges = spanning(near(sets1, sets2, similarity) & (ids1[:, None] != ids2[None, :]), ids1, ids2) if len(ids1) and len(ids2) else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return met.groupBy("posting", "one", "two").applyInPandas(forest, "a bigint, b bigint")


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group of near copies.

    ``docs`` is read several times: pass a table.  A row is known by its id and a hash of its text; rows that
    agree in both are repeated rows, of which one stays.
    """
    h = F.xxhash64(F.col(text).cast("string"))
    keyed = docs.select(F.col(ident).alias("id"), h.alias("h"), F.col(text).alias("text"))
    prints = cut(digests(keyed, ["id", "h"], "text", words), "set-digests")
    rows = prints.groupBy("k1", "k2", "id", "h").agg(F.count("*").alias("times"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "times"))
    classes = cut(rows.groupBy("k1", "k2").agg(least.alias("least")).select(F.monotonically_increasing_id().alias("cid"), "least", "least.id", "least.h", "least.times"), "set-classes")
    discard(prints)
    n = classes.count()
    texts = _matching(keyed.withColumnsRenamed({"id": "own", "h": "hash"}), "own", "hash", classes.select("cid", "id", "h", "times"), n, "inner").select("cid", "text")
    printed = by_fingerprints(texts, words, similarity)
    known = cut(components(printed), "known")
    edges = links(texts, n, words, similarity, known=known)
    found = components(edges)
    grouped = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    stays = cut(grouped.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"), F.col("least.h").alias("__h"), F.col("least.times").alias("__times")), "stays")
    discard(printed, known, edges, found, classes)
    name = free("__hash", docs.columns)
    out = _matching(docs.withColumn(name, h), ident, name, stays.withColumnsRenamed({"__id": "id", "__h": "h", "__times": "times"}), n, "left_semi")
    return out.drop(name)


def free(name: str, taken: list[str]) -> str:
    """``name``, longer where columns already have it (in any case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _matching(docs: DataFrame, ident: str, h: str, keys: DataFrame, n: int, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and hash are those of one of ``keys``, each key once."""

    def joined(some: DataFrame) -> DataFrame:
        key, keyed = (free(c, docs.columns) for c in ("__key", "__keyed"))
        side = some.select(F.col("id").alias(key), F.col("h").alias(keyed), *(c for c in some.columns if c not in ("id", "h", "times")))
        on = docs[ident].eqNullSafe(F.col(key)) & (docs[h] == F.col(keyed))
        met = docs.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, on, how)
        return met.drop(key, keyed)

    repeated = keys.where("times > 1")
    if repeated.isEmpty():
        return joined(keys)
    return joined(keys.where("times = 1")).unionByName(joined(repeated).dropDuplicates([ident, h]))
