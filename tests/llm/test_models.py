import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattis.llm import ppm, quality, toxicity

# --- prediction by partial matching ----------------------------------------------------------


class Slow:
    """The same model from its definition: symbol lists, escapes, exclusion."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for z in map(self.padded, texts):
            for i in range(ppm.ORDER, len(z)):
                for o in range(ppm.ORDER + 1):
                    self.counts[o][z[i - o : i]][z[i]] += 1

    @staticmethod
    def padded(text):
        return bytes([ppm.END]) * ppm.ORDER + text + bytes([ppm.END])

    def probability(self, context, symbol):
        p, gone = 1.0, set()
        for o in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in self.counts[o].get(context[ppm.ORDER - o :], {}).items() if s not in gone}
            if seen:
                whole = sum(seen.values()) + len(seen)
                if symbol in seen:
                    return p * seen[symbol] / whole
                p *= len(seen) / whole
                gone |= set(seen)
        return p / (256 - len(gone))

    def score(self, text):
        z = self.padded(text)
        return sum(math.log10(self.probability(z[i - ppm.ORDER : i], z[i])) for i in range(ppm.ORDER, len(z)))


def test_trie_against_definition():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcab ") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [b"", "é".encode()]
    symbols, ends = ppm.stream(texts)
    keys, counts = np.unique(ppm.grams(symbols, ppm.ORDER, len(symbols))[ppm.places(symbols, ends, ppm.ORDER, len(symbols))], return_counts=True)
    slow, trie = Slow(texts), ppm.Trie(keys, counts)
    for _ in range(40):
        context = bytes(rng.choice(b"abc \xff\xc3z") for _ in range(ppm.ORDER))
        got = 10 ** trie.score(np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64))
        assert got.sum() == pytest.approx(1) and got == pytest.approx([slow.probability(context, s) for s in range(256)])


def plain_base(table):
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    split = lambda t: [w for w in (t or "").lower().replace("\n", " ").split(" ") if w]
    counts = Counter(w for i, t in table if not out(i) for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in table:
        w = [*split(t), None]
        yield i, (out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


@pytest.mark.parametrize("limits", [(ppm.CHUNK_BYTES, ppm.HOLD, ppm.SHARD_NODES), (700, 60, 40), (1, 1, 1)])
def test_ppm_scores(spark, docs, odd, limits):
    rng = random.Random(3)
    words = ["The", "cat", "sat", "on", "mat\n", "é", "zyx"] + [f"w{i}" for i in range(30)]
    table = [(i, " ".join(rng.choice(words[: rng.randint(2, 37)]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    table += [(100, None), (101, ""), (None, "no id"), (3, table[3][1]), (102, "unseen unseen words"), (103, "long text " * 20000)]
    out = ppm.score(odd(docs(table)), chunk_bytes=limits[0], hold=limits[1], shard_nodes=limits[2]).collect()
    expected = defaultdict(list)
    for i, x in plain_base(table):
        expected[i].append(x)
    assert len(out) == len(table)
    lower = {i: (t or "").lower().encode() for i, t in table}
    slow = Slow([lower[i] for i, _ in table if zlib.crc32(str("" if i is None else i).encode()) % 10])
    for r in out:
        held, n, known, train, base = expected[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base)
        if n < 1000:
            assert r.score == pytest.approx(slow.score(lower[r.doc_id]))


def test_ppm_asks_once_for_each_chunk(spark, docs):
    """Chunks keep their size, ask for everything once, and what they ask for adds up to the model."""
    table = [(i, f"alpha beta w{i % 7} gamma") for i in range(200)] + [(500, "long " * 400), (501, None)]
    rows = ppm.ask(docs(table, 2), "doc_id", "text", 10, 300, 1_000_000).cache()
    texts = defaultdict(list)
    for r in rows.where("n is null").collect():
        texts[r.chunk] += ppm.unpacked(bytes(r.docs)).column(2).to_pylist()
    assert len(texts) > 10 and all(len(x) == 1 or sum(map(len, x)) <= 300 for x in texts.values()) and sum(map(len, texts.values())) == len(table)
    asked = rows.where("n is not null")
    assert asked.groupBy("chunk", "word", "gram").count().where("count > 1").count() == 0
    train = [t or "" for i, t in table if zlib.crc32(str(i).encode()) % 10]
    assert asked.agg(F.sum(F.when(F.col("gram").isNotNull(), F.col("n")))).first()[0] == sum(len(t) + 1 for t in train)
    assert asked.where("word is null and gram is null").agg(F.sum("n")).first()[0] == len(train)


def test_ppm_splits_hot_contexts(spark):
    """N-grams that end in one hot pair of bytes go to several groups, whose answers are those of one."""
    rng = random.Random(8)
    made = {int.from_bytes(bytes([rng.choice(b"abcdefgh"), rng.choice(b"ijklmnop"), rng.choice(b"qrstuv"), *b". ", rng.choice(b"ABCDEF")]), "big") for _ in range(1500)}
    made |= {int.from_bytes(bytes(rng.choice(b"xyz \xff") for _ in range(6)), "big") for _ in range(300)}
    grams = spark.createDataFrame([(g, rng.choice([0, 1, 1, 2, 7])) for g in sorted(made)], "gram bigint, n bigint").repartition(4).cache()
    whole = {r.gram: r.value for r in ppm.scores(grams, 1_000_000).collect()}
    assert len(whole) == len(made)
    for bound in (400, 100, 30):
        leveled, split = ppm.levels(grams, bound)
        sizes = leveled.groupBy("level", "group").count().collect()
        assert sum(r["count"] for r in sizes) == len(made) and all(r["count"] <= bound for r in sizes) and split
        assert {r.gram: r.value for r in ppm.scores(grams, bound).collect()} == pytest.approx(whole, rel=1e-6)
    assert ppm.levels(grams, 1_000_000)[1] == []


def test_ppm_answers_come_in_small_batches(spark, docs, monkeypatch):
    """Answers of a chunk reach Python a few rows at a time, not as one table, and its texts after them."""
    monkeypatch.setattr("lattis.llm.common.BATCH_ROWS", 7)
    table = [(i, f"{'ab' * (i % 5)} word{i} c{i % 3}") for i in range(60)]
    found = ppm.score(docs(table, 2), chunk_bytes=300)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    few = {r.doc_id: (r.base_score, r.score) for r in found.collect()}
    monkeypatch.undo()
    more = {r.doc_id: (r.base_score, r.score) for r in ppm.score(docs(table)).collect()}
    assert set(few) == set(range(60)) and all(few[i] == pytest.approx(more[i], rel=1e-6) for i in few)


def test_ppm_words_of_equal_hash(monkeypatch):
    """Words that a seed does not tell apart get another seed."""
    digest = ppm.xxhash.xxh64_intdigest
    monkeypatch.setattr(ppm.xxhash, "xxh64_intdigest", lambda w, seed: 7 if seed < 2 and w in (b"a", b"b") else digest(w, seed))
    words = ppm.Words([pa.array([b"a", b"c"]), pa.array([b"b"])], np.array([3.0, 5.0, 0.0]))
    assert words.seed == 2 and [c.tolist() for c in words.of([b"b a", b"", b"c c a"])] == [[0, 3], [], [5, 5, 3]]


def test_ppm_without_training_rows(spark, docs):
    assert ppm.score(docs([])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ppm.score(docs([(held, "ab")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(-3 * math.log10(256))


# --- quality ---------------------------------------------------------------------------------


def walk(forest, row):
    margin = forest.base
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node]
        margin += forest.value[node]
    return 1 / (1 + math.exp(-margin))


def test_forest_learns_and_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    x[:, 4] = 1.0
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.Forest().fit(x[:1000], y[:1000])
    got = forest.score(x[1000:])
    assert ((got >= 0.5) == y[1000:]).mean() > 0.93
    assert got[:50] == pytest.approx([walk(forest, r) for r in x[1000:1050]])
    assert quality.Forest().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.Forest().fit(x[:50], np.ones(50)).score(x[:2]).min() > 0.9


def held_out_accuracy(spark, data, result, label, cutoff_rows=40):
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label)
    rows = result.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) >= cutoff_rows
    return sum(r.predicted == r[label] for r in rows) / len(rows)


SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    result = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert result.count() == 1000 and result.where("score < 0 or score > 1 or score is null").count() == 0
    assert held_out_accuracy(spark, SF, result, "quality") >= 0.95


def test_quality_odd_rows(spark, docs, odd):
    table = [(i, ("Good words in a calm line. " * 5) if i % 2 else "BAD!! %%% ### BAD!! " * 8) for i in range(80)] + [(100, None), (101, ""), (None, "x"), (1, "x" * 300000)]
    labels = odd(spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id bigint, quality int"))
    out = {r.doc_id: r for r in quality.score(odd(docs(table)), labels).collect()}
    assert out[100].score == out[101].score
    assert all(out[i].predicted == i % 2 for i in range(2, 80))
    assert {r.score for r in quality.score(docs(table), labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs([]), labels).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def slow_kernel(a, b):
    def vector(s):
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[tuple(map(toxicity.code, (s[i], s[j], s[k])))] += toxicity.DECAY ** (k - i - 2)
        return out

    va, vb = vector(a), vector(b)
    norm = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(x * vb[k] for k, x in va.items()) / norm if norm else 0.0


def test_kernel_against_definition():
    strings = ["^idiot$", "^idxiot$", "^a$", "^réeux$", "^aaaaaaa$", "^clown$"]
    got = toxicity.kernel(strings, strings)
    assert got == pytest.approx(np.array([[slow_kernel(a, b) for b in strings] for a in strings]))
    assert np.linalg.eigvalsh(got).min() > -1e-9 and got[0, 1] > got[0, 5]


def test_folded_weights_tolerate_gaps():
    good = ["window", "table", "closet", "running", "idea", "audio", "station", "crown", "brown", "modern"] * 3
    model = toxicity.Model().fit(good, ["idiot", "clown", "moron"])
    for w in ("idiot", "idxiot", "i-d-i-o-t", "1d10t", "cloown", "morron"):
        assert model.margins([toxicity.plain(w)])[0] > 0, w
    assert max(model.margins(["window", "running", "table"])) < 0
    assert toxicity.strings_of("You are an i d i o t. Fine")[0][-1] == "idiot"
    assert model.look(["idiot!", "the"]) == model.look(["idiot!", "the"])


def test_toxicity_held_out(spark):
    result = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert result.count() == 1000 and result.where("score < 0 or score > 1 or score is null").count() == 0
    assert held_out_accuracy(spark, SF, result, "toxic") >= 0.93


def test_toxicity_odd_rows(spark, docs, odd):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ser", "tan", "mol", "pri") for b in ("ent", "ova", "ilk", "ado")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    table = [(i, line(30) + (f". you {rng.choice(['blockhead', 'nitwit'])} {line(3)}" if i % 3 == 0 else "")) for i in range(150)]
    table += [(200, None), (201, ""), (None, "x"), (202, "w" * 200000), (203, "you b l o c k h e a d " + line(5)), (204, "nitt-wit " + line(9)), (1, table[1][1])]
    labels = odd(spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (7, None)], "doc_id bigint, toxic int"))
    out = {r.doc_id: r for r in toxicity.score(odd(docs(table)), labels).collect()}
    assert all(out[i].predicted == (i % 3 == 0) for i in range(150))
    assert out[203].predicted == out[204].predicted == 1 and out[200].predicted == out[201].predicted == 0
    stay = toxicity.accept(odd(docs(table)), labels)
    assert {r.doc_id for r in stay.collect()} >= {i for i in range(150) if i % 3} and stay.where(F.col("doc_id") == 0).count() == 0
    assert toxicity.score(docs([]), labels).count() == 0
    assert {r.score for r in toxicity.score(docs(table), labels.limit(0)).collect()} == {0.5}


def test_toxicity_unit_of_small_support(spark):
    """An insult that five of 10,000 toxic bags pick is positive; a word of five copies of one toxic text is not."""
    bags = [(i, 1.0, w) for i in range(400) for w in ("nitwit", f"only{i}")] + [(1000 + i, 1.0, w) for i in range(5) for w in ("blister", f"other{i}", f"more{i}")]
    bags += [(2000 + i, 1.0, w) for i in range(5) for w in ("copied", "text", "words")] + [(5000 + i, 0.0, "table") for i in range(50)]
    df = spark.createDataFrame(bags, "bag bigint, y double, unit string")
    toxic = df.where("y = 1").select("bag", "unit")
    least = toxicity.support(10_000)
    picked = toxicity.picks(toxic, toxicity.telling(df, 10_000, 10_000, least), "weight")
    assert toxicity.chosen(picked, toxicity.sketched(toxic), least) == ["blister", "nitwit"]


def phrase_table():
    """Toxic where "dirty swine" stands together; both words stand apart in clean texts."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ser", "tan", "mol", "pri", "gul") for b in ("ent", "ova", "ilk", "ado", "ume")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    table = []
    for i in range(600):
        middle = f"dirty swine {line(3)}" if i % 4 == 0 else rng.choice([f"dirty {line(1)} and swine", "swine are not dirty", line(3)])
        table.append((i, f"{line(12)}. {line(2)} {middle} {line(4)}. {line(6)}"))
    return table


def test_toxic_as_a_phrase_alone(spark, docs):
    table = phrase_table()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in table], "doc_id bigint, toxic int")
    # changed phrases, and words apart, in documents without labels
    more = [(1000, "then dirrty swine went"), (1001, "so dirty swinne went"), (1002, "dirty water for swine"), (1003, "swine dirty")]
    out = {r.doc_id: r for r in toxicity.score(docs(table + more), labels).collect()}
    assert all(out[i].predicted == (i % 4 == 0) for i, _ in table)
    assert [out[i].predicted for i, _ in more] == [1, 1, 0, 0]


def test_scores_are_those_of_the_kernel_machine(spark, docs):
    """Every score against margins computed from kernels with landmarks, unit by unit, without folding, caches or batches."""
    table = phrase_table()
    df = docs(table)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in table], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    assert model.heads == ["dirty"]

    def margin(unit):
        pieces = toxicity.windows(unit) if unit else []
        return max((float(toxicity.kernel([p], model.marks)[0] @ model.beta) + model.bias for p in pieces), default=-2.0)

    for _, text in table[:40] + [(0, ""), (0, "a"), (0, "d i r t y swine! " + "x" * 100)]:
        found = []
        for words in toxicity.strings_of(text):
            found += [margin(toxicity.plain(w)) for w in words]
            for a, b in zip(words, words[1:]):
                if toxicity.plain(a) and toxicity.kernel([f"^{toxicity.plain(a)}$"], ["^dirty$"])[0, 0] >= toxicity.HEAD:
                    found.append(margin(f"{toxicity.plain(a)} {toxicity.plain(b)}"))
        own = sorted((min(max(m, -2), 2) for m in found), reverse=True) + [-2.0, -2.0]
        z = model.logit @ [1, own[0], own[1], np.log1p(sum(m > 0 for m in found))]
        assert abs(model.score([text.encode()])[0] - 1 / (1 + np.exp(-z))) < 1e-6
