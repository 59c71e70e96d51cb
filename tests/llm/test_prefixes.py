"""The prefix trie against its definition, odd rows, long and shared conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lattis.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def by_definition(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:] if rebuild else ts
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        mine = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = mine + sum(saved[k] for k in children[path])
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))))
        for p, m in members.items()
    }


def got(spark, rows, rebuild=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clashing = df.select("*", *(F.lit("x").alias(c) for c in ("node", "depth", "key", "words", "len", "span", "pos", "h")))
    found = [tuple(r) for r in prefixes.prefix_trie(clashing, rebuild).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(seed, n):
    rnd = random.Random(seed)
    turns = [("user", "hello there"), ("assistant", "well, hello  to\tyou"), ("user", ""), ("system", None), (None, "no role")]
    return [(c, t, *rnd.choice(turns)) for c in range(n) for t in range(rnd.choice([1, 2, 3, 6]))]


def test_random_and_odd_rows(spark):
    rows = made(1, 45)
    rows += [(None, 0, "user", "no conversation"), (61, None, "user", "first"), (61, 0, "user", "second"), (62, 5, "user", "tie"), (62, 5, "assistant", "tie"), (62, 5, "user", "tie")]
    rows += [(-3, 0, "user", "hello there"), (-3, 1, "user", "x"), (-25, 0, "user", "y"), (85, 0, "user", "base is absent"), (100, 0, "user", "long"), (100, 1, "a" * 3, "word " * 200_000)]
    assert got(spark, rows) == by_definition(rows)


def test_shared_conversations_as_they_are(spark):
    # a third of all conversations are copies; some end where others go on
    rows = made(2, 12) + [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(3 + c % 3)]
    assert got(spark, rows, rebuild=False) == by_definition(rows, rebuild=False)


@pytest.mark.parametrize("ids", [[4], [4, 24]])
def test_few_conversations(spark, ids):
    rows = [(c, t, "user", f"w{t}") for c in ids for t in range(2)]
    assert got(spark, rows) == by_definition(rows)


def test_long_conversation_is_numbered_in_spans(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SPAN", 16)
    rows = [(20, t if t != 5 else None, "user", f"w{t % 7}") for t in range(300)] + [(21, t, "user", "w1") for t in range(4)] + [(20, 100, "user", "twice")]
    assert got(spark, rows) == by_definition(rows)


def test_no_rows(spark):
    assert got(spark, []) == set() == by_definition([])
