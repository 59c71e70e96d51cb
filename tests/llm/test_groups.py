import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattis.llm import graph, multiindex, simhash, simhash_wide


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(random.randrange(80), random.randrange(80)) for _ in range(60)], []):
        df = spark.createDataFrame(edges + [(7, None), (5, 5)], "a bigint, b bigint")
        nodes = {n for e in edges if e[0] != e[1] for n in e}
        got = {r.node: r.component for r in graph.components(df).collect()}
        assert got == union_find(nodes, [e for e in edges if e[0] != e[1]])


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_groups(rows, got):
    """rows: id -> fingerprint; got: id -> component; all pairs compared."""
    ids = sorted(rows)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (rows[a] ^ rows[b]).bit_count() <= 2]
    assert got == union_find(ids, edges)


def test_simhash_whole(spark, docs, odd):
    random.seed(2)
    words = ["alpha", "BETA", "gamma", "Über", "x", "delta"]
    texts = [None, "", " \t\n", "one", "one two", "A B C", "a  b\nc", "x y"]
    texts += [" ".join(random.choice(words) for _ in range(random.randint(1, 200))) for _ in range(40)]
    texts += [t + " tail" for t in texts[-10:] if t] + texts[-5:] + ["long " * 60000]
    table = list(enumerate(texts))
    out = simhash.near_duplicates(odd(docs(table))).collect()
    assert len(out) == len(texts)
    prints = {i: plain_fingerprint(t) for i, t in table if len(t or "") < 10000}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 for r in out if r.doc_id in prints)
    check_groups({r.doc_id: int(r.fingerprint, 16) for r in out}, {r.doc_id: r.component_id for r in out})


def test_simhash_hot_posting(spark):
    """Many fingerprints that share postings: the star form links as all pairs do."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    for b in base:
        for _ in range(150):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    rows = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows.items()], "doc_id bigint, fp bigint")
    for posting in (4, 64):
        check_groups(rows, {r.doc_id: r.component_id for r in simhash.groups(df, posting=posting).collect()})


def test_simhash_empty_nulls_and_repeats(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    out = simhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in out) == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, 0, 4)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_near_copy(spark, docs, odd):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts, group = [], []
    for g in range(25):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(100, 400))]
        for copy in range(4):
            v = list(w)
            for _ in range(copy and len(w) // 80):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
            group.append(g)
    hot = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(400):  # one large group of copies that all differ
        v = list(hot)
        v[rng.randrange(300)] = f"changed{i}"
        texts.append(" ".join(v))
        group.append("hot")
    texts += ["", None, "  ", "single", "single"]
    group += ["empty"] * 3 + ["single"] * 2
    table = odd(docs(list(enumerate(texts)) + [(0, texts[0]), (None, "alone with no id at all")]))
    out = simhash_wide.one_of_each(table)
    assert out.columns == table.columns
    rows = out.collect()
    kept = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(rows) == len(kept) + 1 and len(kept) == len(set(kept))
    for a in range(0, 100, 4):  # close copies of each group: similarity of 0.8 at least with the first
        near = [i for i in range(a, a + 4) if len(shingles(texts[a]) & shingles(texts[i])) >= 0.85 * len(shingles(texts[a]) | shingles(texts[i]))]
        assert len([i for i in near if i in kept]) == 1 and a in kept
    assert len([i for i in kept if group[i] == "hot"]) == 1
    assert [group[i] for i in kept].count("empty") == 1 and [group[i] for i in kept].count("single") == 1
    assert simhash_wide.one_of_each(docs([])).count() == 0


def test_unlike_texts_stay(spark, docs):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    distinct = len({tuple(t.split()) for t in texts})
    assert simhash_wide.one_of_each(docs(list(enumerate(texts)))).count() == distinct


def brute_links(vectors):
    good = {}
    for i, v in vectors:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good[i] = np.array(v, dtype=np.float64) / np.sqrt(np.sum(np.square(np.array(v, dtype=np.float64))))
    ids = list(good)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a] @ good[b] >= 0.95]
    links = dict.fromkeys((i for i, _ in vectors), 0)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return links, union_find([i for i, _ in vectors], edges), len(edges)


def test_multiindex(spark, odd):
    rng = np.random.default_rng(4)
    vectors = []
    for c in range(60):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 6))):
            vectors.append((base + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32).tolist())
    hot = rng.normal(size=8)
    vectors += [(hot + rng.normal(size=8) * 0.05).astype(np.float32).tolist() for _ in range(200)] + [vectors[0]] * 3
    vectors += [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0, None] + [0.5] * 6, [1.0] * 5]
    table = list(enumerate(vectors))
    df = odd(spark.createDataFrame([(i, v, 0) for i, v in table], "vec_id bigint, embedding array<float>, label int"))
    out = {r.vec_id: r for r in multiindex.link(df).collect()}
    assert len(out) == len(table)
    links, groups, pairs = brute_links(table)
    found = sum(r.n_links for r in out.values()) / 2
    assert found <= pairs and found >= 0.97 * pairs
    assert all(out[i].n_links <= links[i] for i in links)
    same = [i for i in links if out[i].n_links == links[i]]
    assert len(same) >= 0.95 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())
    assert sum(out[i].component_id == groups[i] for i in groups) >= 0.95 * len(groups)
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(len(table) - 7, len(table)))


def test_multiindex_small_chunks_and_empty(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    table = [(i, (base + rng.normal(size=8) * 0.05).tolist()) for i in range(90)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(multiindex, "CHUNK", 16)
    out = {r.vec_id: r for r in multiindex.link(df).collect()}
    links, groups, _ = brute_links([(r.vec_id, list(r.embedding)) for r in df.collect()])
    assert {i: r.n_links for i, r in out.items()} == links and {i: r.component_id for i, r in out.items()} == groups
    assert multiindex.link(df.limit(0)).count() == 0
    assert multiindex.link(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).where("kept").count() == 90


def near_copies_of(texts):
    """Brute force: ids (places) that one_of_each keeps, and all pairs at 0.8 or more."""
    own = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    return sorted(set(union_find(range(len(texts)), pairs).values())), pairs


def test_near_copies_at_exactly_the_similarity(spark, docs):
    """Pairs on both sides of 0.8, of equal and unequal lengths: exactly those of brute force."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts, at = [], {True: 0, False: 0}
    for n in (8, 9, 24, 104, 204):
        for tail in range(0, n // 3, max(1, n // 40)):
            w = [word() for _ in range(n)]
            texts += [" ".join(w), " ".join(w + [word() for _ in range(tail)])]
            texts += [" ".join(v := [word() for _ in range(n)]), " ".join(v[: n - tail // 2] + [word() for _ in range(tail // 2)])]
    for a in range(0, len(texts), 2):
        one, two = shingles(texts[a]), shingles(texts[a + 1])
        s = len(one & two) / len(one | two)
        if 0.72 <= s < 0.9:
            at[s >= 0.8] += 1
    assert min(at.values()) >= 15 and any(5 * len(shingles(a) & shingles(b)) == 4 * len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2]))
    kept, _ = near_copies_of(texts)
    assert sorted(r.doc_id for r in simhash_wide.one_of_each(docs(list(enumerate(texts)))).collect()) == kept


def test_near_copies_in_a_hot_posting(spark, docs, monkeypatch):
    """Unlike texts that share a template, and a few near copies among them: blocks lose no pair."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    template, texts = words(154), []
    for i in range(110):
        own = words(6)
        texts.append(" ".join(template + own + words(19)))
        if i < 40:
            texts.append(" ".join(template + own + words(19)))
    rng.shuffle(texts)
    kept, pairs = near_copies_of(texts)
    assert len(pairs) == 40 and len(kept) == 110
    monkeypatch.setattr(simhash_wide, "COMMON", 0)  # so that the template's postings stay hot
    monkeypatch.setattr(simhash_wide, "SMALL", 4)
    monkeypatch.setattr(simhash_wide, "BLOCK", 4)
    assert sorted(r.doc_id for r in simhash_wide.one_of_each(docs(list(enumerate(texts)))).collect()) == kept


def test_hot_postings_are_solved_by_an_order_of_their_own(spark, docs, monkeypatch):
    """Unlike texts meet by a passage that the sample does not show: exact counts among them put it last, no chunks are left."""
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, texts = words(60), []
    for i in range(120):
        own = words(90)
        texts.append(" ".join(own + passage))
        if i % 6 == 0:
            texts.append(" ".join([*own[:-1], "edited", *passage]))
    rng.shuffle(texts)
    kept, pairs = near_copies_of(texts)
    assert len(pairs) == 20 and len(kept) == 120
    monkeypatch.setattr(simhash_wide, "SAMPLE", 1)
    monkeypatch.setattr(simhash_wide, "SMALL", 4)
    sizes, again, forests = [], simhash_wide.again, simhash_wide.forests
    monkeypatch.setattr(simhash_wide, "again", lambda large, *a: (sizes.append(large.count()), again(large, *a))[1])
    monkeypatch.setattr(simhash_wide, "forests", lambda large, *a: (sizes.append(large.count()), forests(large, *a))[1])
    assert sorted(r.doc_id for r in simhash_wide.one_of_each(docs(list(enumerate(texts)))).collect()) == kept
    assert sizes[0] > 100 and sizes[1:] == [0]


def test_groups_are_those_of_brute_force(spark, docs, monkeypatch):
    """Chains of edited texts, pairs at 0.72 to 0.9 and short texts: one of each brute-force component stays, nothing else goes."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = []
    for n in (6, 12, 40, 100, 250):
        for _ in range(12):
            w = [word() for _ in range(n)]
            texts.append(" ".join(w))
            for _ in range(3):  # each an edit of the one before
                for _ in range(rng.randint(1, max(1, n // 45))):
                    w[rng.randrange(n)] = word()
                w = w + [word() for _ in range(rng.randint(0, 1))]
                texts.append(" ".join(w))
    rng.shuffle(texts)
    own = [shingles(t) for t in texts]
    near = [len(a & b) / len(a | b) for k, a in enumerate(own) for b in own[:k]]
    assert sum(0.8 <= s < 0.9 for s in near) >= 20 and sum(0.72 <= s < 0.8 for s in near) >= 20
    kept, _ = near_copies_of(texts)
    for small, block in ((32, 256), (2, 2)):
        monkeypatch.setattr(simhash_wide, "SMALL", small)
        monkeypatch.setattr(simhash_wide, "BLOCK", block)
        assert sorted(r.doc_id for r in simhash_wide.one_of_each(docs(list(enumerate(texts)))).collect()) == kept


def test_multiindex_slack_is_measured_or_not_needed(spark):
    """Few linked queries measure no recall: then every cell that can hold a link is visited."""
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(400, 32))
    vectors[399] = vectors[398] * 1.0001 + 1e-4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    assert multiindex.fit(multiindex.packed(df, "vec_id", "embedding"), 400).bound is not None
    twins = np.repeat(rng.normal(size=(200, 32)), 2, 0) + rng.normal(size=(400, 32)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(twins)], "vec_id bigint, embedding array<double>")
    grid = multiindex.fit(multiindex.packed(df, "vec_id", "embedding"), 400, queries=20)
    assert grid.bound is None and 0 < grid.slack < 0.1


def test_visited_cells_hold_every_link():
    """All pairs at a cosine of exactly the threshold, in all directions, on grids of all sizes."""
    rng = np.random.default_rng(16)
    for k in (1, 2, 7, 30):
        x = multiindex.unit(rng.normal(size=(500, 16)))
        n = rng.normal(size=x.shape) * rng.choice([0.01, 1, 5], size=x.shape)
        n -= (n * x).sum(1)[:, None] * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * multiindex.unit(n)
        grid = multiindex.Grid(multiindex.unit(rng.normal(size=(300, 16))), k)
        grid.bound = 0.1 + 1e-9
        assert all(home in seen for home, seen in zip(grid.cells(y).tolist(), grid.visits(x)))


@pytest.mark.parametrize("pairs", [1, 3, 20])
def test_multiindex_finds_the_only_links(spark, pairs):
    rng = np.random.default_rng(pairs)
    v = multiindex.unit(rng.normal(size=(20_000, 32)))
    for k in range(pairs):
        n = rng.normal(size=32)
        n -= (n @ v[2 * k]) * v[2 * k]
        v[2 * k + 1] = 0.951 * v[2 * k] + np.sqrt((1 - 0.951**2) / (n @ n)) * n
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(4)
    linked = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.link(df).where("n_links > 0").collect()}
    assert linked == {i: (1, i - i % 2) for i in range(2 * pairs)}


def test_multiindex_sparse_links(spark):
    """Few links just over the threshold among unlike vectors of 64 dimensions, in other cells than their partners."""
    rng = np.random.default_rng(15)
    v = rng.normal(size=(6000, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    for k in range(60):
        c, n = rng.uniform(0.951, 0.97), rng.normal(size=64)
        n -= (n @ v[2 * k]) * v[2 * k]
        v[2 * k + 1] = c * v[2 * k] + np.sqrt((1 - c * c) / (n @ n)) * n
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r for r in multiindex.link(df).collect()}
    assert all(out[i].n_links == 1 and out[i].component_id == i - i % 2 for i in range(120))
    assert all(out[i].n_links == 0 and out[i].kept for i in range(120, 6000))


def test_pipeline_links_by_fingerprints_first(spark, docs, monkeypatch):
    """SimHash finds near copies, the exact similarity decides, and the prefix filter adds what two bits do not reach."""
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [line(1500) for _ in range(6)]
    near = [t + " end" for t in texts[:4]]  # fingerprints as near as they come
    short = [line(120) for _ in range(6)]
    far = [" ".join("x" if i in (20, 70) else w for i, w in enumerate(t.split())) for t in short]
    table = docs(list(enumerate([*texts, *near, *short, *far])))
    seen = []
    by = simhash_wide.by_fingerprints
    monkeypatch.setattr(simhash_wide, "by_fingerprints", lambda *a: (seen.append(by(*a)), seen[-1])[1])
    monkeypatch.setattr(simhash_wide, "discard", lambda *a: None)
    kept = sorted(r.doc_id for r in simhash_wide.one_of_each(table).collect())
    assert kept == [*range(6), *range(10, 16)] and len(seen) == 1 and 1 <= seen[0].count() <= 10
    # a link that the similarity does not confirm does not count
    same = spark.createDataFrame([(1, "a b c"), (2, "a b c d e f")], "cid bigint, text string")
    monkeypatch.setattr(simhash_wide.simhash, "fingerprints", lambda df, keep: df.select(*keep, F.lit(5).cast("bigint").alias("fp")))
    assert by(same).count() == 0
