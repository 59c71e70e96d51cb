"""Stored layouts: bounded pieces, products that read them where they lie, cuts from one scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lattis.model import Matrix, Shape
from lattis.operators import blocks, csr, dealt, partition, profile, spmv


def matrix(spark, entries, n_row, n_col, partitions=4):
    return Matrix.of(spark.createDataFrame(entries, "row bigint, col bigint, val double").repartition(partitions), Shape(n_row, n_col))


def vector(spark, n, k):
    return spark.range(n).select(F.col("id").alias("col"), ((F.col("id") * k) % 5 + 1).cast("double").alias("x"))


def expected(entries, k):
    out = {}
    for r, c, v in entries:
        out[r] = out.get(r, 0.0) + v * ((c * k) % 5 + 1)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def as_many_tasks_as_asked(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed():
    """A hub row, a hub column and one place with a third of all entries."""
    rng = random.Random(7)
    entries = [(rng.randrange(50), rng.randrange(300), float(rng.randrange(9))) for _ in range(600)]
    entries += [(7, rng.randrange(300), 1.0) for _ in range(300)] + [(rng.randrange(50), 11, 2.0) for _ in range(300)] + [(3, 5, float(i % 4)) for i in range(600)]
    return entries


@pytest.mark.parametrize("balance", profile.BALANCES)
def test_stored_blocks_and_two_vectors(spark, skewed, monkeypatch, balance):
    monkeypatch.setattr(blocks, "WIDTH", 64)
    a = matrix(spark, skewed, 50, 300)
    layout = blocks.store(a, (2, 3), balance, entries=100)
    try:
        stored = layout.pieces.collect()
        assert all(len(r.vals) <= 100 and len(r.cols) == len(r.vals) == r.ptr[-1] and len(r.ptr) == len(r.rows) + 1 for r in stored)
        assert sum(len(r.vals) for r in stored) == len(skewed) and {r.row_blk for r in stored} == {0, 1} and {r.col_blk for r in stored} == {0, 1, 2}
        assert len({(r.col_blk, r.strip, r.lane) for r in stored}) > len({(r.col_blk, r.strip) for r in stored})
        for k in (1, 3):  # a second vector reads the same pieces
            y = blocks.multiply(layout, vector(spark, 300, k), exact=None if k == 1 else 4)
            assert {r.row: r.y for r in y.collect()} == expected(skewed, k)
        assert {r.row: r.y for r in blocks.multiply(layout).collect()} == {r: sum(v for i, _, v in skewed if i == r) for r in {e[0] for e in skewed}}
        # x without some columns: they give nothing, and rows of no other columns do not appear
        some = vector(spark, 300, 1).where("col = 5")
        assert {r.row: r.y for r in blocks.multiply(layout, some).collect()} == expected([e for e in skewed if e[1] == 5], 1)
    finally:
        layout.drop()


def test_plan_of_a_product_with_stored_blocks(spark, skewed):
    layout = blocks.store(matrix(spark, skewed, 50, 300), (2, 3), "nnz", buckets=4)
    try:
        lines = plan(blocks.multiply(layout, vector(spark, 300, 1))).splitlines()
        at = next(i for i, line in enumerate(lines) if "ShuffledHashJoin" in line)
        sources = [line for line in lines[at + 1 :] if "lattis_blocks" in line or "Exchange" in line]
        # the stored pieces are the first source below the join: no exchange comes before them
        assert "lattis_blocks" in sources[0] and "Bucketed: true" in sources[0]
        # what is broadcast are the lanes, read from the layout without arrays; x is not
        cast = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
        assert len(cast) == 1 and not any("Range" in line for line in lines[cast[0] :])
        assert "[col_blk" in lines[-1] and "vals" not in lines[-1].split("Batched")[0]
    finally:
        layout.drop()


def test_dealt_entries_are_not_dealt_again(spark, skewed):
    placed = dealt.deal(matrix(spark, skewed, 50, 300), 4, buckets=5)
    try:
        for k in (1, 3):
            y = dealt.multiply(placed, vector(spark, 300, k), exact=4)
            assert {r.row: r.y for r in y.collect()} == expected(skewed, k)
        # x is broadcast by its known length; entries and sums stay in their buckets
        assert not re.search(r"(?<!Broadcast)Exchange (hash|range|Round|Single)", plan(dealt.multiply(placed, vector(spark, 300, 1))))
        assert "Exchange" not in plan(dealt.multiply(placed))
    finally:
        placed.drop()
    assert not spark.catalog.tableExists(placed.table)


def test_one_repeated_place_comes_in_bounded_pieces(spark):
    entries = [(1, 4, 2.5)] * 1000 + [(1, 4, -0.0)] * 3 + [(1, 4, 0.0)] * 3 + [(1, 9, float(i)) for i in range(50)] + [(2, 0, 1.0)]
    a = matrix(spark, entries, 3, 10)
    pieces = csr.to_arrays(a, 16).collect()
    assert max(len(r.vals) for r in pieces) == 16 and len(pieces) == -(-1056 // 16) + 1
    back = csr.from_arrays(csr.to_arrays(a, 16), a.shape).df.collect()
    assert sorted(map(str, back)) == sorted(f"Row(row={r}, col={c}, val={v})" for r, c, v in entries)


def test_cuts_of_both_axes_from_one_scan(spark, tmp_path, skewed):
    matrix(spark, skewed, 50, 300).df.write.parquet(str(tmp_path / "m"))
    a = Matrix.of(spark.read.parquet(str(tmp_path / "m")), Shape(50, 300))
    seen = []
    for axis, parts in (("row", 3), ("col", 4)):
        seen.append(sorted(map(tuple, partition.cuts(a, axis, parts, "comm").collect())))
    both = partition.both_cuts(a, (3, 4), "comm")
    assert list(both) == seen
    counts = partition.block_nnz(a, (3, 4), "nnz")
    assert counts.agg(F.sum("nnz")).first()[0] == len(skewed)
    scanned = partition._cuts(a, {"row": 3, "col": 4}, "nnz")
    scanned.collect()
    # the profile is read and shuffled once, whatever uses it; counting the blocks is the second scan
    final = scanned._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count("FileScan parquet") == 1


def test_cuts_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(partition, "BUCKET", 8)
    rng = random.Random(3)
    for parts in (1, 2, 7, 30):
        w = [float(rng.choice([0, 0, 1, 5])) for _ in range(60)]
        table = spark.createDataFrame([(i, v) for i, v in enumerate(w)], "i bigint, w double")
        got = [(r.start, r["count"]) for r in partition.weighted(table, 60, parts).orderBy("part").collect()]
        from test_operators import greedy

        assert got == greedy(w, 60, parts)
    assert [tuple(r)[1:] for r in partition.uniform_axes(spark, {"row": (10, 4), "col": (2, 3)}).orderBy("axis", "part").collect()] == [
        (0, 0, 2), (1, 2, 0), (2, 2, 0), (0, 0, 3), (1, 3, 2), (2, 5, 3), (3, 8, 2),
    ]


def test_strips_of_wide_matrices(spark, monkeypatch):
    """Slices of x are arrays of a strip's columns, whatever the width of a block."""
    monkeypatch.setattr(blocks, "WIDTH", 16)
    entries = [(i % 5, (i * 37) % 1000, float(i % 3)) for i in range(400)]
    a = matrix(spark, entries, 5, 1000)
    for strategy in ("csr", "grid2d"):
        assert {r.row: r.y for r in spmv.spmv(a, vector(spark, 1000, 3), strategy, grid=(2, 2), exact=2).collect()} == expected(entries, 3)


def test_exact_sums_have_a_bound(spark):
    a = matrix(spark, [(0, 0, 1e12)], 1, 1)
    with pytest.raises(Exception, match="exact sums"):
        blocks.multiply(blocks.compress(a), exact=4).collect()
