"""Spelling variants against brute force over all pairs, long words, odd rows."""

import random
import re
import zlib
from collections import Counter

from lattis.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_pairs(pairs):
    n = Counter()
    for ident, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        found = sorted((-n[o], o) for o in n if one_edit(w, o))
        near[w] = len(found)
        if found and -found[0][0] >= 2 * n[w]:
            form[w] = found[0][1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], near[w], n.get(form.get(w))) for w in n}


def got(table):
    rows = spelling.variants(table).collect()
    assert len(rows) == len({r.word for r in rows})
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_against_all_pairs(docs, odd):
    rnd = random.Random(3)
    letters = "abcéÿ"
    bases = ["".join(rnd.choices(letters, k=rnd.choice([5, 5, 6, 7]))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaab", "abababa", "ababab"]
    words = []
    for w in bases:
        for _ in range(4):
            words += [w] * rnd.choice([1, 2, 3, 5, 9, 20])
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:]])
    rnd.shuffle(words)
    pairs = [(i, " ".join(words[i::300]).upper() if i % 5 == 0 else "-".join(words[i::300])) for i in range(300)]
    pairs += [(None, "nulls nulls nulls"), (1000, None), (1001, ""), (1002, "Twice Twice twice"), (1002, "Twice Twice twice"), (1003, "×÷×÷× " * 5)]
    want = by_pairs(pairs)
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and r != f for _, f, r, *_ in want)
    assert got(odd(docs(pairs))) == want


def test_chain_of_forms(docs):
    # each word has twice the occurrences of the one before: the root is nine steps away
    chain = ["bbbbbbbbbb"[:i] + "aaaaaaaaaa"[i:] for i in range(10)]
    pairs = [(i, " ".join([w] * (3 << i))) for i, w in enumerate(chain)]
    assert got(docs(pairs)) == by_pairs(pairs)


def test_long_words(docs):
    rnd = random.Random(5)
    bases = ["".join(rnd.choices("abc", k=k)) for k in (63, 64, 65, 66, 67, 200)] + ["a" * 64, "a" * 65, "a" * 66]
    words = []
    for w in bases:
        for k in (7, 3, 3):
            words += [w] * k
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:]])
    pairs = [(i, w) for i, w in enumerate(words)]
    assert got(docs(pairs)) == by_pairs(pairs)
    # a word of a whole text gives rows in proportion to its length
    long = "ab" * 50_000
    pairs = [(i, t) for i, t in enumerate([long] * 9 + [long[:70_000] + "c" + long[70_000:]] * 3)]
    rows = got(docs(pairs))
    assert {(len(w), None if f is None else len(f), k, m) for w, f, _, k, m, _ in rows} >= {(100_000, None, 9, 1), (100_001, 100_000, 3, 1)}


def test_no_words(docs):
    assert got(docs([])) == set() and got(docs([(1, "four 12345"), (2, None)])) == set()
