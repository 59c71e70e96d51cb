"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone.  Trees are fitted on the driver on at most
``TRAIN_ROWS`` labelled rows (a sample by hash; rows that are held out never count), with
features cut into ``BINS`` quantile bins and level-wise growth from gradient histograms.
The fitted forest is five flat arrays; numpy walks all rows of a batch down a tree at once.

Defined cases: null text is empty, an empty text has all-zero statistics and a score like any
other; without labelled rows every score is 0.5; null labels are left out; repeated rows each get their
row, and of conflicting labels of one id the largest counts; columns beyond
id and text are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 80, 4, 0.12, 10, 1.0
CUTOFF = 0.3

_MARKS = [b"!", b"?", b".", b",", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"/", b"<", b"=", b"\n", b" "]
_kinds = bytes(
    1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c" else 5 if b >= 128 else 6 for b in range(256)
)
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
NAMES = ["bytes", "lower", "upper", "digits", "space", "high", "marks", "words", "word_length", "short", "long", "distinct", "top", "pairs", "lines", "line_length", "repeated_lines", "capital_words", "plain"] + [f"mark_{m[0]}" for m in _MARKS]


def statistics(text: bytes | None) -> list[float]:
    """What a text looks like; shares are of bytes, words or lines."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    kinds = text.translate(_kinds)
    share = [kinds.count(k) / n for k in (1, 2, 3, 4, 5, 6)]
    words = text.split()
    w = max(1, len(words))
    sizes = list(map(len, words))
    counts = Counter(words)
    top = max(counts.values(), default=0) / w
    short = sum(s <= 3 for s in sizes) / w
    long_ = sum(s >= 14 for s in sizes) / w
    pairs = sum(a == b for a, b in zip(words, words[1:])) / w
    lines = [x for x in text.split(b"\n") if x]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    plain = len(text.translate(_PLAIN).split()) / w
    capital = sum(x[:1].isupper() for x in words) / w
    return [
        math.log1p(n), *share, math.log1p(len(words)), sum(sizes) / w, short, long_, len(counts) / w, top, pairs,
        math.log1p(len(lines)), n / max(1, len(lines)), repeated, capital, plain, *(text.count(m) / w for m in _MARKS),
    ]


class Forest:
    """Trees as flat arrays; a leaf points at itself."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = (np.zeros(0, t) for t in (np.int32, np.float64, np.int32, np.int32, np.float64))
        self.roots: list[int] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        if not len(y):
            return self
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.base)
        nodes: list[list] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            root = self._grow(nodes, binned, edges, p - y, p * (1 - p), margin)
            self.roots.append(root)
        columns = list(zip(*nodes))
        self.feature, self.left, self.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
        self.cut, self.value = np.array(columns[1]), np.array(columns[4])
        return self

    def _grow(self, nodes, binned, edges, gradient, hessian, margin) -> int:
        """One tree, level by level; adds its values to the margins."""
        at = np.zeros(len(gradient), np.int64)  # of a row: its node within the level
        root = len(nodes)
        nodes.append([0, np.inf, root, root, 0.0])
        level = [root]
        rows = np.arange(len(gradient))
        for depth in range(DEPTH + 1):
            k = len(level)
            g_all, h_all = np.bincount(at, gradient[rows], k), np.bincount(at, hessian[rows], k)
            for i, node in enumerate(level):
                nodes[node][4] = -RATE * g_all[i] / (h_all[i] + RIDGE)
            best = np.full(k, 1e-6)
            choice = np.full((k, 2), -1)
            for f in range(binned.shape[1] if depth < DEPTH else 0):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                key = at * width + binned[rows, f]
                g, h, n = (np.cumsum(np.bincount(key, v, k * width).reshape(k, width), 1) for v in (gradient[rows], hessian[rows], None))
                gain = g**2 / (h + RIDGE) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + RIDGE) - (g_all**2 / (h_all + RIDGE))[:, None]
                gain[(n < LEAST) | (n[:, -1:] - n < LEAST)] = 0
                where = gain.argmax(1)
                better = gain[np.arange(k), where] > best
                best[better] = gain[np.arange(k), where][better]
                choice[better] = np.stack([np.full(k, f), where], 1)[better]
            split = choice[:, 0] >= 0
            done = ~split[at]
            margin[rows[done]] += np.array([nodes[node][4] for node in level])[at[done]]
            if not split.any():
                break
            below, first = [], np.zeros(k, np.int64)
            for i in np.flatnonzero(split):
                f, b = choice[i]
                first[i] = len(below)
                a = len(nodes)
                nodes[level[i]][:4] = [int(f), float(edges[f][b]), a, a + 1]
                nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, a + 1, a + 1, 0.0]]
                below += [a, a + 1]
            rows, at = rows[~done], at[~done]
            at = first[at] + (binned[rows, choice[at, 0]] > choice[at, 1])
            level = below
        return root

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def held_out(ident: str, parts: int = 5) -> F.Column:
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % parts == 0


def training_rows(docs: DataFrame, labels: DataFrame, ident: str, label: str, text: str, rows: int, parts: int = 5) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that are not held out, a sample by hash."""
    picked = labels.where(F.col(ident).isNotNull() & F.col(label).isin(0, 1) & ~held_out(ident, parts)).groupBy(F.col(ident).alias("id")).agg(F.max(label).cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(rows)
    # the sample is bounded by its parameter, so it may travel
    own = docs.where(~held_out(ident, parts)).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return own.join(F.broadcast(picked), "id").select("id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    def make():
        return lambda texts: [[statistics(t) for t in texts]]

    found = map_texts(training_rows(docs, labels, ident, label, text, rows), ["id", "y"], "text", make, "x array<double>")
    # repeated ids could multiply rows: the bound holds for rows too
    table = found.orderBy(F.xxhash64("id"), "id", "x").limit(rows).toArrow()
    y = table["y"].to_numpy()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(len(y), len(NAMES))
    return Forest().fit(x, y)


def score(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", cutoff: float = CUTOFF, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: ident, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ident, text, label, rows))

    def make():
        forest = shared.value
        return lambda texts: [forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES)))]

    out = map_texts(docs.select(F.col(ident).alias("id"), held_out(ident).alias("held_out"), F.col(text).alias("text")), ["id", "held_out"], "text", make, "score double")
    return out.select(F.col("id").alias(ident), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


