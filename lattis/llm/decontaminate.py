"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised (A-Z lower-cased; words are runs of digits, a-z and non-ASCII
characters) and their words, as numbers, go into one suffix automaton.  Documents stream
through it word by word; the automaton tracks the longest match that ends at each word.
A *window* is ``window`` consecutive words of an item, or all words of a shorter one; it
ends at a word if the match there is long enough.  Words inside any window are hit.

Words that no item holds, and neighbours that never stand together in an item, break every
match.  These breaks are found for a whole batch by numpy, so that only runs that may
hold a window walk through the automaton; the result is the same as for all words.

Test items are dealt to shards of about ``SHARD_WORDS`` words.  Tasks build a shard's automaton and save it in the
shared folder (through ``pyarrow.fs``), tasks load it from there: no items pass the driver.  With several shards a task
gathers ``HOLD`` bytes of texts and takes them through one shard after the other.

Defined cases: null and empty texts (also items) have no words; an item without words has
no window; repeated items count once per id; a null id is the string ``null``; repeated document rows each get
their row; columns beyond those named are kept by ``clean`` and not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, new_path, rewrite_rows

WINDOW = 10
#: Words of test items in one automaton.
SHARD_WORDS = 100_000
#: Bytes that an item word is taken for when items are dealt to shards.
BYTES_A_WORD = 6
#: Bytes of texts that a load of several shards serves, and that go through one at a time.
HOLD, PORTION = 64 << 20, 4 << 20
#: A document goes if windows cover more than this share of its words; else the spans go.
MAX_COVERAGE = 0.5

_digits, _letters = range(48, 58), range(97, 123)
#: Bytes of a word stay (A-Z in lower case), all others turn to spaces.
NORMAL = bytes(b if b >= 128 or b in _digits or b in _letters else b + 32 if b + 32 in _letters and b < 97 else 32 for b in range(256))
_word = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, and what the windows need of it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for key, words in items:
            if words:
                coded.append((key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._grow(last, c)
        #: Shortest window: shorter runs can't hold one.
        self.least = min((min(window, len(codes)) for _, codes in coded), default=window)
        pairs = {a * len(self.vocabulary) + b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        #: Ids of the long items in whose windows a state's words occur, and of the short items that end in a state.
        inside: list[set[str]] = [set() for _ in self.next]
        whole: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for key, codes in coded:
            v = 0
            for c in codes:
                v = self.next[v][c]
                if len(codes) >= window:
                    u = v
                    while u > 0 and key not in inside[u]:
                        inside[u].add(key)
                        u = self.link[u]
            if len(codes) < window:
                u = v
                while self.length[self.link[u]] >= len(codes):
                    u = self.link[u]
                whole[u].append((len(codes), key))
        self.long_items: list[tuple[str, ...]] = [()] * len(self.next)
        self.short_items: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.long_items[v] = self.long_items[up] if self.length[up] >= window else tuple(sorted(inside[v]))
            self.short_items[v] = self.short_items[up] + tuple(sorted(set(whole[v])))

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the longest sequence of ``p`` followed by ``c``, apart from longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _grow(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, end, item ids) of all windows in a run of words that items hold."""
        follow, link, length, window = self.next, self.link, self.length, self.window
        v = matched = 0
        for i, c in enumerate(codes):
            while v and c not in follow[v]:
                v = link[v]
                matched = length[v]
            if c in follow[v]:
                v = follow[v][c]
                matched += 1
            if matched >= window:
                yield i - window + 1, i + 1, self.long_items[v]
            for n, key in self.short_items[v]:
                if n <= matched:
                    yield i - n + 1, i + 1, (key,)

    def batch(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document the spans of words that are hit (disjoint, in order), and the item ids."""
        out: list = [([], set()) for _ in docs]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        total = int(sizes.sum())
        if not total or not self.vocabulary:
            return out
        codes = np.fromiter(map(self.vocabulary.get, chain.from_iterable(docs), repeat(-1)), np.int64, total)
        ends = np.cumsum(sizes)
        joined = np.zeros(total, dtype=bool)  # with the word before
        both = np.flatnonzero((codes[1:] >= 0) & (codes[:-1] >= 0)) + 1
        if len(both) and len(self.pairs):
            pair = codes[both - 1] * len(self.vocabulary) + codes[both]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
            joined[both[found]] = True
        joined[ends[ends < total]] = False
        if self.least == 1:
            first = np.flatnonzero((codes >= 0) & ~joined)
        else:
            first = np.flatnonzero(joined & ~np.concatenate(([False], joined[:-1]))) - 1
        breaks = np.append(np.flatnonzero(~joined), total)
        stop = breaks[np.searchsorted(breaks, first, side="right")]
        for a, b in zip(first.tolist(), stop.tolist()):
            if b - a < self.least:
                continue
            d = int(np.searchsorted(ends, a, side="right"))
            offset = a - int(ends[d] - sizes[d])
            spans, keys = out[d]
            for i, j, items in self.walk(codes[a:b].tolist()):
                add_span(spans, i + offset, j + offset)
                keys.update(items)
        return out


def add_span(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span whose end is not before the ends so far; touching spans join."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def shards(benchmark: DataFrame, item: str, text: str, window: int, shard_words: int) -> list[str]:
    """Files in the shared folder with automata that together hold all items, each of about ``shard_words`` words (or one item).

    Different rows are dealt to shards by hash, and each shard's automaton is built and saved by a task; what comes to
    the driver are the names of the files.
    """
    spark = benchmark.sparkSession
    folder = new_path(spark, "automata")
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("key"), F.col(text).cast("string").cast("binary").alias("text")
    ).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // (BYTES_A_WORD * shard_words)))

    def build(items: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([(key, words_of(raw)) for key, raw in sorted(zip(items["key"], items["text"].map(lambda x: bytes(x) if x is not None else b"")))], window)
        path = f"{folder}-{uuid.uuid4().hex}"  # of this attempt of the task
        system, place = file_system(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            out.write(pickle.dumps(made, pickle.HIGHEST_PROTOCOL))
        return pd.DataFrame({"path": [path]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(count)))
    return sorted(r.path for r in dealt.groupBy("shard").applyInPandas(build, "path string").collect())


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


_held: dict[str, Automaton] = {}


def loaded(path: str) -> Automaton:
    """An automaton of a shard; a worker holds one at a time."""
    if path not in _held:
        _held.clear()
        system, place = file_system(path)
        with system.open_input_stream(place) as f:
            _held[path] = pickle.loads(f.read())
    return _held[path]


def matcher(paths: list[str]) -> Callable[[list[bytes | None]], tuple[list[int], list]]:
    """A function from texts to (numbers of words, and for each text its spans and item ids over all shards).

    Shards are the outer loop: each is loaded once for all texts of a call, which go through it a few at a time.
    """

    def match(texts):
        sizes: list[int] = []
        merged: list = [([], set()) for _ in texts]
        for k, path in enumerate(paths or [None]):
            automaton = loaded(path) if path else Automaton([])
            for at in portions(texts):
                docs = [words_of(t) for t in texts[at]]
                if k == 0:
                    sizes += map(len, docs)
                for (spans, keys), (more, also) in zip(merged[at], automaton.batch(docs)):
                    spans += more
                    keys |= also
        out = []
        for spans, keys in merged:
            whole: list[tuple[int, int]] = []
            for a, b in sorted(spans, key=lambda x: (x[1], x[0])) if len(paths) > 1 else spans:
                add_span(whole, a, b)
            out.append((whole, keys))
        return sizes, out

    return match


def portions(texts: list[bytes | None]) -> Iterator[slice]:
    """Runs of texts of about ``PORTION`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= PORTION:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def find(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``spans`` of hit words."""
    parts = shards(benchmark, item, item_text, window, shard_words)

    def make():
        match = matcher(parts)

        def work(texts):
            sizes, found = match(texts)
            return [
                sizes,
                [sum(b - a for a, b in spans) for spans, _ in found],
                [sorted(keys) for _, keys in found],
                [[{"start": a, "end": b} for a, b in spans] for spans, _ in found],
            ]

        return work

    return map_texts(docs, keep, text, make, "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>", HOLD * (len(parts) > 1))


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The documents without hit spans; those with more than ``max_coverage`` of their words hit go."""
    parts = shards(benchmark, item, item_text, window, shard_words)

    def make():
        match = matcher(parts)

        def work(texts):
            sizes, found = match(texts)
            new, stay = list(texts), [True] * len(texts)
            for i, (n, (spans, _)) in enumerate(zip(sizes, found)):
                if spans:
                    stay[i] = sum(b - a for a, b in spans) <= max_coverage * n
                    new[i] = without(texts[i], spans)
            return new, stay

        return work

    return rewrite_rows(docs, text, make, hold=HOLD * (len(parts) > 1))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _word.finditer(text.translate(NORMAL))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def digest(keys: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest()
