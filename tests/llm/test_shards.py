"""Jump hashing against its definition, its law, its slots, odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np

from lattis.llm import shards

LONG = "x" * 2_000_000


def by_definition(key, n):
    last, ahead = -1, 0
    while ahead < n:
        last = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((last + 1) * (2.0**31 / ((key >> 33) + 1)))
    return last


def hashed(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def test_jump_is_its_definition():
    keys = np.random.default_rng(1).integers(0, 2**60, 3000)
    for n in (1, 2, 16, 17, 1000):
        assert shards.jump(keys, n).tolist() == [by_definition(int(k), n) for k in keys]
    assert shards.jump(keys[:0], 16).tolist() == []


def test_appended_shards_take_rows_only_into_themselves():
    keys = np.random.default_rng(2).integers(0, 2**60, 40_000)
    at = shards.jump(keys, 1)
    for n in range(2, 20):
        grown = shards.jump(keys, n)
        left = grown != at
        assert set(grown[left]) == {n - 1} and abs(left.mean() - 1 / n) < 0.02
        at = grown
    sizes = np.bincount(at)
    assert sizes.min() > 0.85 * sizes.mean() and sizes.max() < 1.15 * sizes.mean()


def test_place_by_brute_force(docs, odd):
    pairs = [(i, f"text {i} é" * (i % 7)) for i in range(400)] + [(7, "again"), (7, "again"), (8, None), (None, ""), (None, "no id"), (500, LONG)]
    pairs += [(9, "hot")] * 300  # one key holds much of all rows
    got = sorted((tuple(r) for r in shards.place(odd(docs(pairs, 7))).collect()), key=str)
    want, taken = [], Counter()
    rows = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    for i, size, crc in rows:
        shard = by_definition(hashed(i), 16)
        want.append((i, size, crc, "key", shard, taken[shard], by_definition(hashed(i), 17)))
        taken[shard] += 1
    assert got == sorted(want, key=str)


def test_hot_group_is_numbered_in_many_tasks(spark):
    df = spark.range(30_000).selectExpr("1 AS shard", "5 AS k").repartition(6)
    assert sorted(r.slot for r in shards.number(df, "shard", "k").collect()) == list(range(30_000))


def test_no_rows(docs):
    assert shards.place(docs([])).collect() == []


def test_written_shards(spark, docs, tmp_path):
    table = docs([(i, f"text {i}") for i in range(300)])
    shards.write(table, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(i, by_definition(hashed(i), 5)) for i in range(300)}
    assert {r.doc_id for r in shards.moved(table, shards=5).collect()} == {i for i in range(300) if by_definition(hashed(i), 6) == 5}
    # a key of several columns
    assert shards.assign(table, ["lang", "doc_id"], 4).where("shard between 0 and 3").count() == 300
