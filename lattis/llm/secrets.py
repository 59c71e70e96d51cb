r"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard.

Base kinds (code points, leftmost, not overlapping within a kind, failing matches dropped):
``assign``, ``access``, ``hex``.  Kind ``novel`` is what the method adds: strings near a
sensitive word that neither dictionaries nor surroundings explain.

Novelty.  A candidate is a run of printable signs after a sensitive word, at least ``SHORTEST`` long.  It is
split at changes of case and class and lower-cased, so that names fall into words.  Its *marginal bytes* are what it
adds to a zstandard frame of the text around it, brought to ``HEAD`` signs whatever there is of it, and primed by a
dictionary: the words of the Python library's and PySpark's sources, dates, and the words that most texts of the whole
table share.  They are compared with the mean of up to ``LIKE`` shuffles of the candidate that have a random
sign of the same class at each place.  What words make up compresses to a part of that; keys add as much, and are
reported from ``NOVELTY`` on, unless a base span covers part of them.

Quick whole-text tests (substring finds on bytes) decide which texts need the patterns; they
are necessary conditions, so nothing is missed.

Defined cases: null is empty; offsets count code points; a text without secrets has no spans
and its digest is that of the empty string; repeated rows each get their row; texts of any length
are read whole; columns beyond those kept and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
import string
import sysconfig
from collections import Counter
from functools import cache

import pyspark
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, map_texts, rewrite_rows

KINDS = ["assign", "access", "hex", "novel"]
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 at least: the same matches as runs of any length of which the short ones are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: What makes a place sensitive, how far before a candidate it may stand, and the text on each side that primes it.
SENSITIVE = re.compile(r"passw|passphrase|passcode|\bpass\b|\bpwd\b|secret|token|api.?key|\bauth|credential|bearer|private.?key|access.?key|signature|akia", re.I | re.A)
NEAR, AROUND, HEAD = 48, 64, 120
CANDIDATE = re.compile(r"""[^\s"'`<>(){}\[\],;]{11,}""")
SHORTEST = 11
#: Part of a random string's marginal bytes, shuffles, and how many of them decide where the part is far from it.
NOVELTY, LIKE, FEW, FAR = 0.89, 24, 6, 0.2
#: Words of the documents that make up the dictionary's end, and in how many texts each is at least.
WORDS, SHARED = 6000, 3
#: Hashes of texts with copies up to which they are broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000

_quick = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"credential", b"bearer", b"private", b"access", b"signature", b"akia")
_hex_map = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))
_hex_run = b"\x01" * 32

#: Words of the dictionary: letters, and files of the sources that hold them, at least.
LETTERS, FILES = (3, 16), 2
_word = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
_change = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_parts = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Folders of sources that are not code as people write it.
_left_out = {"test", "tests", "site-packages", "dist-packages", "__pycache__"}


def split(text: str) -> str:
    """Words, numbers and marks of a text, apart and in small letters."""
    return " ".join(_parts.findall(_change.sub(" ", text))).lower()


@cache
def vocabulary() -> tuple[str, ...]:
    """Words of the sources that come with Python and PySpark, those of most files last."""
    counts: Counter = Counter()
    for root in (sysconfig.get_paths()["stdlib"], os.path.dirname(pyspark.__file__)):
        for folder, inner, files in os.walk(root):
            inner[:] = sorted(set(inner) - _left_out)
            for name in sorted(files):
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                        counts.update({w.lower() for w in _word.findall(f.read())})
    kept = [w for w, n in counts.items() if n >= FILES and LETTERS[0] <= len(w) <= LETTERS[1]]
    return tuple(sorted(kept, key=lambda w: (counts[w], w)))


class Novelty:
    """Marginal bytes under a dictionary; ``words``: what documents share, the most frequent last."""

    def __init__(self, words: list[str] = ()):
        known = vocabulary()
        dates = [f"{y} - {m:02d} -" for y in range(2000, 2031) for m in range(1, 13)] + [f"t {h:02d} : 00 : 00" for h in range(24)]
        self.dictionary = " ".join([*dates, *(w.lower() for w in words), *known]).encode() + b" "
        self.filler = " ".join(known[::97])[-HEAD:]
        self.compressor = None

    def __getstate__(self):
        return {"dictionary": self.dictionary, "filler": self.filler, "compressor": None}

    def size(self, text: str) -> int:
        if self.compressor is None:
            given = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=LEVEL)
            self.compressor = zstandard.ZstdCompressor(dict_data=given, level=LEVEL, write_content_size=False)
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def of(self, before: str, candidate: str, after: str) -> float:
        """The bytes that a candidate adds, in terms of what random strings like it add."""
        head = f"{self.filler} {split(after)} {split(before)}"[-HEAD:] + " "
        least = self.size(head)
        own = self.size(f"{head}{split(candidate)} ") - least
        rng, total = random.Random(candidate), 0
        signs = list(candidate)
        for n in range(1, LIKE + 1):
            rng.shuffle(signs)
            total += self.size(f"{head}{split(''.join(other(c, rng) for c in signs))} ") - least
            if n == FEW and abs(own * n / max(total, 1) - NOVELTY) > FAR:
                break
        return own * n / max(total, 1)


LEVEL = 19
_classes = (string.ascii_lowercase, string.ascii_uppercase, string.digits)


def other(c: str, rng: random.Random) -> str:
    """A random sign of the same class; what is no letter and no digit stays."""
    return next((rng.choice(x) for x in _classes if c in x), c)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A candidate without the marks around it."""
    while start < end and text[start] in "=:.-_*#|/\\~&?!>":
        start += 1
    while end > start and text[end - 1] in ".:!?*|&\\":
        end -= 1
    return start, end


def novel_spans(text: str, base: list[tuple[int, int, int]], model: Novelty) -> list[tuple[int, int, int]]:
    out, done, at, reach = [], 0, 0, 0
    spans = sorted((a, b) for a, _, b in base)
    for m in SENSITIVE.finditer(text):
        # candidates that start at most NEAR after the end of a sensitive word, each once
        last = m.end() + NEAR
        done = max(done, m.end())
        while done <= last and (c := CANDIDATE.search(text, done, last + SHORTEST)):
            c = CANDIDATE.match(text, c.start())
            done = c.end()
            start, end = trimmed(text, c.start(), c.end())
            if end - start < SHORTEST:
                continue
            while at < len(spans) and spans[at][0] < end:  # base spans that start before its end, and how far they reach
                reach, at = max(reach, spans[at][1]), at + 1
            if reach > start:
                continue
            if model.of(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]) >= NOVELTY:
                out.append((start, 3, end))
    return out


def scan(raw: bytes | None, model: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each as (start, kind, end)."""
    if not raw:
        return [], []
    low = raw.lower()
    words = any(q in low for q in _quick)
    if not words and _hex_run not in raw.translate(_hex_map):
        return [], []
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, model)) if words else base


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit(df: DataFrame, text: str = "text") -> Novelty:
    """The dictionary of a table: the words that most of its texts share, counted in all of them, copies once.

    Words of up to 16 letters, small but for the first: a key that stands in several documents is no word.
    """
    texts = df.select(F.col(text).cast("string").alias("t")).where("t is not null").select("t", F.xxhash64("t").alias("h"))
    # only texts that have copies are gathered; the others are counted where they are read
    copied = cut(texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "copied")
    side = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    once = texts.join(side, "h", "left_anti").select("t").unionByName(texts.join(side, "h", "left_semi").select("t").distinct())
    words = once.select(F.explode(F.array_distinct(F.split("t", r"[\s\p{Punct}]+"))).alias("w")).where(F.col("w").rlike(r"^\p{L}\p{Ll}{3,15}$")).groupBy("w").agg(F.count("*").alias("n"))
    shared = words.where(F.col("n") >= SHARED).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    discard(copied)
    return Novelty([r.w for r in reversed(shared)])


def find(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, ``base`` and ``spans`` as kind:start:end lists."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, text))

    def make():
        model = shared.value

        def work(texts):
            found = [scan(t, model) for t in texts]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            return [*counts, [spelled(b) for b, _ in found], [spelled(a) for _, a in found]]

        return work

    return map_texts(df, keep, text, make, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every reported span masked; of an assignment the name stays."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, text))

    def make():
        model = shared.value

        def one(raw):
            _, spans = scan(raw, model)
            if not spans:
                return raw
            whole = raw.decode("utf-8", "replace")
            out, at = [], 0
            for a, k, b in spans:
                if k == 0:
                    a = ASSIGN.match(whole, a).start(2)
                if b > at:
                    if a >= at:
                        out += [whole[at:a], mask]
                    at = b
            return "".join([*out, whole[at:]])

        return lambda texts: ([one(t) for t in texts], None)

    return rewrite_rows(df, text, make)


def base_digest(base: F.Column) -> F.Column:
    return F.sha2(base, 256)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(spelled(spans).encode()).hexdigest()
