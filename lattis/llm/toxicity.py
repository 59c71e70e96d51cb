"""Toxicity by a subsequence string kernel SVM with Nystroem landmarks.

Kernel.  Strings are words of a sentence between border signs.  The kernel counts common
subsequences of three symbols, contiguous or gapped, that lie within ``SPAN`` symbols, each
weighed by ``DECAY`` for every symbol left out; it is scaled to 1 for equal strings.  Gaps
make inserted characters cheap; separators inside a word, look-alike digits and words spelled
in single letters are undone before.

Training.  Labels are on documents, insults in their sentences: a labelled document (of a bounded sample by hash, never
held-out rows) is a bag of sentences, whose units are words and, where no word explains a bag, pairs of neighbours.  A toxic
bag has one toxic unit at least, a clean one none.  Rounds of labelling and fitting: first every toxic bag picks the
units that most tell toxic bags from clean ones, later the unit of the largest margin; what ``support`` bags pick is
positive, with versions that have inserted or doubled characters.  All units of clean bags are negative: fitting starts
with some, and adds all others that violate their margin until none do or the rounds end.  The SVM is linear in the
Nystroem features of landmarks chosen among both kinds.

Scoring.  The weights on landmarks fold into one vector over subsequences, because the
kernel is an inner product of (hashed) subsequence counts; a word's margin is then a sum over its own
subsequences.  A document's score is a logistic function, fitted on the sample, of its
largest margins.  All words of all texts count; margins of frequent words are cached.  Pairs are scored where phrases
were learnt and the first word is like the first of one (a kernel of ``HEAD`` at least).

Words longer than ``LONGEST`` are cut to overlapping pieces, in training and in scoring alike.

Defined cases: null text is empty; an empty text has no margin and the score of a text
without insults; repeated rows each get their row, and of conflicting labels of one id the
largest counts; without labels of both kinds every score is the share of toxic labels (0.5
without labels); columns beyond id, text and label are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, map_texts, rewrite_rows
from .quality import held_out, training_rows

#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 20_000
SPAN, DECAY, CLASSES = 6, 0.5, 64
#: Negative words that fitting starts with, landmarks, and rounds of violators and of labelling.
START, LANDMARKS, ROUNDS, LABELLINGS = 4000, 384, 2, 2
#: A unit must stand in this many times more toxic than clean bags (by share) to explain one.
RATIO = 8.0
#: Toxic bags that must pick a unit: this share of all, within these bounds; for a phrase this share, and the upper bound at least.
SHARE, LEAST, MOST, PHRASE_SHARE = 0.002, 2, 4, 0.02
#: Units that a bag picks at first, and the share of toxic bags for which any of these, not the first alone, is positive.
DEPTH, AGAIN = 3, 0.02
#: How alike a word and the first of a phrase must be.
HEAD = 0.6
LONGEST = 32
CACHE = 120_000
CUTOFF = 0.5

#: Characters that stand for letters.
LOOKS = str.maketrans("013457@$!|", "oieastasil")
_sentence = re.compile(r"[.!?\n]+(?:\s|$)")
_inner = re.compile(r"[^\w@$!|]+|_+")
_edges = ".,;:!?\"'()[]{}<>*#%&$-_|/\\"

_pairs = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]
_weights = np.array([DECAY ** (k - 2) for _, k in _pairs])
_codes: dict[str, int] = {"^": 1, "$": 2}


def code(c: str) -> int:
    """The class of a character: letters a-z have their own, others share."""
    got = _codes.get(c)
    if got is None:
        got = _codes[c] = 3 + ord(c) - 97 if "a" <= c <= "z" else 29 + ord(c) * 31 % (CLASSES - 29)
    return got


def plain(word: str) -> str:
    """A word without the marks around and inside it, look-alikes turned to letters."""
    word = word.strip(_edges)
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.translate(LOOKS)
        word = _inner.sub("", word)
    return word


def normal(unit: str) -> str:
    """A word, or the words of a phrase, as strings of the kernel."""
    return " ".join(map(plain, unit.split(" "))) if " " in unit else plain(unit)


def pairs_of(text: str) -> set[str]:
    """Neighbouring words of a sentence, normalised."""
    out = set()
    for sentence in _sentence.split(unicodedata.normalize("NFC", text).lower()):
        words = [p for w in sentence.split() if (p := plain(w))]
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return out


def strings_of(text: str) -> list[list[str]]:
    """Sentences as lists of raw words, with words spelled in single letters joined and added."""
    out = []
    for sentence in _sentence.split(unicodedata.normalize("NFC", text).lower()):
        words = sentence.split()
        if words:
            run: list[str] = []
            more = []
            for w in [*words, ""]:
                p = w.strip(_edges) if len(w) <= 3 else w
                if len(p) == 1 and p.isalnum():
                    run.append(p)
                    continue
                if len(run) >= 3:
                    more.append("".join(run))
                run = []
            out.append(words + more)
    return out


def windows(word: str) -> list[str]:
    """A string as pieces of at most LONGEST symbols that overlap by half."""
    if len(word) <= LONGEST:
        return [f"^{word}$"]
    step = LONGEST // 2
    return [("^" if i == 0 else "") + word[i : i + LONGEST] + ("$" if i + LONGEST >= len(word) else "") for i in range(0, len(word) - step, step)]


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of all strings: (string, subsequence, value), each pair once, strings scaled to norm 1."""
    width = max(map(len, strings)) + SPAN
    table = np.zeros((len(strings), width), np.int64)
    for i, s in enumerate(strings):
        table[i, : len(s)] = [code(c) for c in s]
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = width - SPAN
    keys, values = [], []
    first = table[:, :starts]
    for (j, k), w in zip(_pairs, _weights):
        third = table[:, k : k + starts]
        key = (first * CLASSES + table[:, j : j + starts]) * CLASSES + third
        row, col = np.nonzero(third)
        keys.append(row * CLASSES**3 + key[row, col])
        values.append(np.full(len(row), w))
    key, value = np.concatenate(keys), np.concatenate(values)
    key, back = np.unique(key, return_inverse=True)
    value = np.bincount(back, value, len(key))
    row = key // CLASSES**3
    norm = np.sqrt(np.bincount(row, value * value, len(strings)))
    norm[norm == 0] = 1
    assert len(length) == len(norm)
    return row, key % CLASSES**3, value / norm[row]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The scaled subsequence kernel of two lists of strings."""
    out = np.zeros((len(a), len(b)))
    if not a or not b:
        return out
    row, col, value = features(b)
    known, place = np.unique(col, return_inverse=True)
    table = np.zeros((len(known), len(b)))
    table[place, row] = value
    row, col, value = features(a)
    at = np.minimum(np.searchsorted(known, col), len(known) - 1)
    there = known[at] == col
    row, at, value = row[there], at[there], value[there]
    for lo in range(0, len(row), 8192):
        r = row[lo : lo + 8192]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))  # rows are in order
        out[r[first]] += np.add.reduceat(value[lo : lo + 8192, None] * table[at[lo : lo + 8192]], first)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """Linear SVM (dual coordinate descent, squared hinge); the last column of x is the constant."""
    rng = np.random.default_rng(seed)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    square = (x * x).sum(1) + 0.5 / cost
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def altered(word: str, rng: np.random.Generator, copies: int = 2) -> list[str]:
    """A word as people disguise it: a character inserted, doubled or left out."""
    out = [word]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(copies if len(word) >= 5 else 0):
        i = int(rng.integers(1, len(word)))
        out.append(word[:i] + letters[int(rng.integers(26))] + word[i:])
        out.append(word[:i] + word[i - 1] + word[i:])
    return out


class Model:
    def __init__(self, share: float = 0.5):
        self.vector = np.zeros(CLASSES**3)
        self.bias = -1.0
        self.logit = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        #: First words of the phrases that were learnt; landmarks and their weights.
        self.heads: list[str] = []
        self.marks: list[str] = []
        self.beta = np.zeros(0)
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}
        self.opens: dict[str, bool] = {}

    def __getstate__(self):
        return {**self.__dict__, "young": {}, "old": {}, "opens": {}}

    def fit(self, good: list[str], bad: list[str], seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        pos = sorted({v for w in bad for v in altered(w, rng)})
        clean = set(pos)
        neg = [w for w in dict.fromkeys(good) if w not in clean]
        pool = [bad[i] for i in rng.permutation(len(bad))[: LANDMARKS * 2 // 3]]
        pool += [neg[i] for i in rng.permutation(len(neg))[: LANDMARKS - len(pool)]]
        marks = list(dict.fromkeys(p for w in pool for p in windows(w)))
        labelled = [(p, sign) for words, sign in ((pos, 1.0), (neg, -1.0)) for w in words for p in windows(w)]
        strings, y = [p for p, _ in labelled], np.array([sign for _, sign in labelled])
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])  # landmarks to Nystroem features
        x = np.hstack([kernel(strings, marks) @ root, np.ones((len(strings), 1))])
        w = train_svm(x, y, np.where(y > 0, 10.0 * max(1.0, len(neg) / max(1, len(pos))) ** 0.5, 10.0))
        beta = root @ w[:-1]
        self.vector = np.zeros(CLASSES**3)
        row, col, value = features(marks)
        np.add.at(self.vector, col, beta[row] * value)
        self.bias = float(w[-1])
        self.marks, self.beta = marks, beta
        self.heads = sorted({w.split(" ")[0] for w in bad if " " in w})
        self.forget()
        return self

    def phrases(self, words: list[str]) -> list[str]:
        """Pairs of neighbours whose first word is like that of a phrase."""
        unknown = list({w for w in words[:-1] if w not in self.opens})
        if unknown:
            if len(self.opens) > CACHE:
                self.opens = {}
            known = {w: [f"^{p[:LONGEST]}$"] for w in unknown if (p := plain(w))}
            like = kernel([x[0] for x in known.values()], [f"^{h[:LONGEST]}$" for h in self.heads]).max(1) if known else []
            self.opens.update(dict.fromkeys(unknown, False) | {w: bool(k >= HEAD) for w, k in zip(known, like)})
        return [f"{a} {b}" for a, b in zip(words, words[1:]) if self.opens.get(a)]

    def margins(self, words: list[str]) -> list[float]:
        """Margins of normalised words (empty ones get the least)."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            for piece in windows(w) if w else ():
                pieces.append(piece)
                owner.append(i)
        out = np.full(len(words), -2.0)
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            row, col, value = features(part)
            np.maximum.at(out, owner[at : at + 4096], np.bincount(row, value * self.vector[col], len(part)) + self.bias)
        return out.tolist()

    def look(self, words: list[str]) -> list[float]:
        """Margins of raw words, through the cache."""
        got = list(map(self.young.get, words))
        if None in got:
            missing = list({w for w, g in zip(words, got) if g is None})
            fresh = [w for w in missing if w not in self.old]
            found = {w: self.old[w] for w in missing if w in self.old} | dict(zip(fresh, self.margins([normal(w) for w in fresh]) if fresh else ()))
            if len(self.young) + len(found) > CACHE:
                self.old, self.young = self.young, {}
            self.young.update((w, m) for w, m in found.items() if len(w) <= 64)
            got = [found[w] if g is None else g for w, g in zip(words, got)]
        return got

    def summaries(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text: the largest and second largest margin of its words, and log of those over 0."""
        words, ends = [], []
        for t in texts:
            for s in strings_of((t or b"").decode("utf-8", "replace")):
                words += s
                if self.heads:
                    words += self.phrases(s)
            ends.append(len(words))
        margins = np.array(self.look(words)) if words else np.zeros(0)
        out, start = np.zeros((len(texts), 3)), 0
        for i, end in enumerate(ends):
            own = margins[start:end].clip(-2, 2)
            start = end
            if len(own) > 1:
                out[i, :2] = np.partition(own, -2)[-2:][::-1]
            else:
                out[i, :2] = (own[0] if len(own) else -2.0), -2.0
            out[i, 2] = np.log1p((own > 0).sum())
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.logit[0] + self.summaries(texts) @ self.logit[1:]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def support(toxic: int) -> int:
    """Toxic bags that must pick a unit."""
    return min(max(LEAST, int(SHARE * toxic)), MOST)


def telling(bags: DataFrame, toxic: int, clean: int, least: int) -> DataFrame:
    """(unit, weight): units of ``least`` toxic bags that stand far more often in toxic bags than in clean ones, weighed by bags times log of ratio."""
    counts = bags.groupBy("unit").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    ratio = (F.col("bad") / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    return counts.where((F.col("bad") >= least) & (F.length("unit") >= 3)).select("unit", "bad", ratio.alias("ratio")).where(F.col("ratio") >= RATIO).select("unit", (F.col("bad") * F.log("ratio")).alias("weight"))


def picks(toxic_bags: DataFrame, told: DataFrame, by: str, depth: int = 1) -> DataFrame:
    """(bag, unit, place): the units of every toxic bag that are largest by a column of ``told``."""
    order = Window.partitionBy("bag").orderBy(F.desc(by), "unit")  # a document's words
    return toxic_bags.join(told, "unit").withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("bag", "unit", "place")


def chosen(picked: DataFrame, sketches: DataFrame, least: int) -> list[str]:
    """Units that ``least`` bags pick: fewer than there are toxic bags in the sample.

    Bags of one sketch (the least of three hashes of their words, which near copies mostly share) count once, so that
    what merely stands in copies of one toxic text is not taken.
    """
    found = picked.join(sketches, "bag").groupBy("unit").agg(F.count_distinct("sketch").alias("n"))
    return sorted(r.unit for r in found.where(F.col("n") >= least).collect())


def sketched(toxic_bags: DataFrame) -> DataFrame:
    least = [F.min(h) for h in (F.xxhash64("unit"), F.hash("unit"), F.xxhash64("unit", F.lit(1)))]
    return toxic_bags.groupBy("bag").agg(F.xxhash64(*least).alias("sketch"))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    sample = cut(training_rows(docs, labels, ident, label, text, rows), "toxic-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.5
        return Model(min(max(share, 0.001), 0.999))

    def words_of():
        return lambda texts: [[list({p for s in strings_of((t or b"").decode("utf-8", "replace")) for w in s if (p := plain(w))}) for t in texts]]

    def neighbours():
        return lambda texts: [[list(pairs_of((t or b"").decode("utf-8", "replace"))) for t in texts]]

    # copies of one text are one bag
    texts = sample.groupBy("text").agg(F.max("y").alias("y")).withColumn("bag", F.xxhash64("text"))
    bags = map_texts(texts, ["bag", "y"], "text", words_of, "units array<string>")
    bags = cut(bags.select("bag", "y", F.explode("units").alias("unit")), "toxic-bags")
    model, least = Model(min(max(toxic / (toxic + clean), 0.001), 0.999)), support(toxic)
    toxic_bags = bags.where("y = 1").select("bag", "unit")
    first = cut(picks(toxic_bags, telling(bags, toxic, clean, least), "weight", DEPTH), "toxic-picks")
    sketches = cut(sketched(toxic_bags), "toxic-sketches")
    bad = sorted({*chosen(first.where("place = 1"), sketches, least), *chosen(first, sketches, max(least, int(AGAIN * toxic)))})
    # phrases: of bags that no word explains, if there are enough of them
    often = max(MOST, int(PHRASE_SHARE * toxic))
    rest = texts.where("y = 1").join(first, "bag", "left_anti")
    good: list[str] = []
    if rest.limit(often).count() >= often:
        open_pairs = map_texts(rest, ["bag"], "text", neighbours, "units array<string>").select("bag", F.explode("units").alias("unit"))
        open_pairs = cut(open_pairs.withColumn("y", F.lit(1.0)), "toxic-pairs")
        frequent = cut(open_pairs.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") >= often).select("unit"), "toxic-pairs")
        if not frequent.isEmpty():
            others = map_texts(texts.where("y = 0"), ["bag", "y"], "text", neighbours, "units array<string>").select("bag", "y", F.explode("units").alias("unit"))
            others = cut(others, "clean-pairs")
            both = open_pairs.join(frequent, "unit", "left_semi").select("bag", "y", "unit").unionByName(others.join(frequent, "unit", "left_semi").select("bag", "y", "unit"))
            phrases = chosen(picks(open_pairs.select("bag", "unit"), telling(both, toxic, clean, often), "weight"), sketches, often)
            heads = [p.split(" ")[0] for p in phrases]
            if heads:
                good = [r.unit for r in others.where(F.substring_index("unit", " ", 1).isin(heads)).select("unit").distinct().collect()]
                good = sorted(set(good) - set(phrases))
            bad += phrases
            discard(others)
        discard(open_pairs, frequent)
    if not bad:
        discard(sample, bags, first, sketches)
        return model
    clean_words = cut(bags.where("y = 0").groupBy("unit").agg(F.count("*").alias("n")), "clean-words")
    good += [r.unit for r in clean_words.orderBy(F.xxhash64("unit"), "unit").limit(START).collect()]
    good += [r.unit for r in clean_words.orderBy(F.desc("n"), "unit").limit(START // 4).collect()]
    spark = docs.sparkSession
    for labelling in range(LABELLINGS):
        for _ in range(ROUNDS):
            model.fit(good, bad)
            shared = spark.sparkContext.broadcast(model)

            def margins():
                return lambda units: [shared.value.margins([t.decode() for t in units])]

            against = map_texts(clean_words, ["unit"], "unit", margins, "margin double").where(F.col("margin") > -1)
            known = set(good) | set(bad)
            more = sorted(r.unit for r in against.select("unit").collect() if r.unit not in known)
            shared.unpersist()
            if not more:
                break
            good += more
        if labelling + 1 < LABELLINGS:
            # the largest margin of each toxic bag, if over 0 and more toxic than clean
            shared = spark.sparkContext.broadcast(model)

            def margins():
                return lambda units: [shared.value.margins([t.decode() for t in units])]

            known = bags.groupBy("unit").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).where((F.col("bad") / (toxic + 1)) > (F.col("good") / (clean + 1)))
            scored = map_texts(known, ["unit"], "unit", margins, "margin double").where(F.col("margin") > 0)
            again = chosen(picks(toxic_bags, scored, "margin"), sketches, least)
            bad = sorted(set(bad) | set(again))
            shared.unpersist()
    shared2 = spark.sparkContext.broadcast(model)

    def summaries():
        fitted = shared2.value

        def work(texts):
            return [fitted.summaries(texts).tolist()]

        work.close = fitted.forget
        return work

    found = map_texts(sample, ["id", "y"], "text", summaries, "x array<double>")
    # repeated ids could multiply rows: the bound holds for rows too
    table = found.orderBy(F.xxhash64("id"), "id", "x").limit(rows).toArrow()
    discard(sample, bags, clean_words, first, sketches)
    model.logit = logistic(np.array(table["x"].to_pylist()).reshape(-1, 3), table["y"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", cutoff: float = CUTOFF, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: ident, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ident, text, label, rows))

    def make() -> Callable:
        return lambda texts: [shared.value.score(texts)]

    out = map_texts(docs.select(F.col(ident).alias("id"), held_out(ident).alias("held_out"), F.col(text).alias("text")), ["id", "held_out"], "text", make, "score double")
    return out.select(F.col("id").alias(ident), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", cutoff: float = CUTOFF, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score is under the cutoff, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ident, text, label, rows))

    def make() -> Callable:
        model = shared.value

        def work(texts):
            return None, (model.score(texts) < cutoff).tolist()

        work.close = model.forget  # the worker lives on for later stages
        return work

    return rewrite_rows(docs, text, make)
