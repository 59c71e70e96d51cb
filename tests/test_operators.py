import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lattis.functions import metrics
from lattis.model import Matrix, Shape, ones
from lattis.operators import blocks, csr, partition, profile, spmv
from lattis.plans import timing
from lattis.sources import sinks


def matrix(spark, entries, n_row, n_col):
    return Matrix.of(spark.createDataFrame(entries, "row bigint, col bigint, val double"), Shape(n_row, n_col))


EDGE = {
    "empty": ([], 3, 2),
    "holes": ([(1, 0, 2.0), (1, 1, -2.0), (3, 1, 4.0)], 5, 2),
    "repeated": ([(0, 0, 1.0), (0, 0, 2.0), (0, 0, 1.0), (1, 3, 0.0)], 2, 4),
    "hub": ([(0, i, float(i)) for i in range(200)] + [(2, 5, 1.0)], 3, 200),
}


@pytest.mark.parametrize("case", EDGE)
def test_strategies_agree(spark, case):
    entries, n, m = EDGE[case]
    a = matrix(spark, entries, n, m)
    x = spark.range(m).select(F.col("id").alias("col"), (F.col("id") % 3 + 1).cast("double").alias("x"))
    expected = [sum(v * (c % 3 + 1) for r, c, v in entries if r == i) for i in range(n)]
    for strategy in spmv.STRATEGIES:
        got = [r.y for r in spmv.spmv(a, x, strategy=strategy, dense=True, grid=(2, 2), balance="nnz").orderBy("row").collect()]
        assert got == expected, strategy
    assert [r.y for r in spmv.spmv(a, ones(spark, m), dense=True).orderBy("row").collect()] == [r.y for r in spmv.spmv(a, dense=True).orderBy("row").collect()]


def test_grid_keeps_all_entries(spark):
    random.seed(1)
    a = matrix(spark, [(random.randrange(40), random.randrange(40), 1.0) for _ in range(500)], 40, 40)
    for ranks in (1, 2, 4, 6, 9):
        grid = partition.grid_dims(ranks)
        for balance in profile.BALANCES:
            assert partition.block_nnz(a, grid, balance).agg(F.sum("nnz")).first()[0] == 500


def test_nulls_special_values_and_arguments(spark):
    a = Matrix.of(spark.createDataFrame([(0, None, 1.0), (0, 1, None), (0, 1, float("inf")), (1, 1, float("nan"))], "row int, col int, val double"), Shape(2, 2))
    got = {r.row: r.y for r in spmv.spmv(a).collect()}
    assert got[0] == math.inf and math.isnan(got[1])
    with pytest.raises(ValueError):
        spmv.spmv(a, strategy="other")
    with pytest.raises(ValueError):
        spmv.spmv(a, parts=0)
    outside = matrix(spark, [(0, 0, 1.0), (5, 0, 1.0), (0, -1, 1.0)], 2, 2)
    assert outside.within().df.count() == 1


def test_csr_round_trip_and_pointers(spark):
    entries, n, m = EDGE["holes"]
    a = matrix(spark, entries, n, m)
    assert [r.ptr for r in csr.row_ptr(a).orderBy("row").collect()] == [0, 0, 2, 2, 3, 3]
    back = csr.from_arrays(csr.to_arrays(a), a.shape)
    assert sorted(map(tuple, back.df.collect())) == sorted(entries)
    assert sorted((r.row, r.col, r.pos) for r in csr.positions(a).collect()) == [(1, 0, 0), (1, 1, 1), (3, 1, 0)]


def test_wide_rows_come_in_pieces(spark, monkeypatch):
    """A hub row among others, repeated places, more columns than a bucket: two levels give what one gives."""
    rng = random.Random(4)
    entries = [(rng.choice([0, 0, 0, 1, 2, 4]), rng.randrange(40), float(rng.randrange(9))) for _ in range(300)]
    a = matrix(spark, entries, 5, 40)
    one, two = (sorted(map(tuple, csr.positions(a, bucket).collect())) for bucket in (100, 6))
    assert one == two
    for bucket in (100, 6):
        pieces = csr.to_arrays(a, 7, bucket)
        assert pieces.where("size(cols) > 7 or size(cols) <> size(vals)").count() == 0 and pieces.groupBy("row", "piece").count().where("count > 1").count() == 0
        # all pieces of a row but its last are full, and its places go on from piece to piece
        placed = sorted((r.row, 7 * r.piece + k, c, v) for r in pieces.collect() for k, (c, v) in enumerate(zip(r.cols, r.vals)))
        assert placed == sorted((row, pos, col, val) for row, col, val, pos in one)
        assert sorted(map(tuple, csr.from_arrays(pieces, a.shape).df.collect())) == sorted(entries)
    monkeypatch.setattr(blocks, "WIDTH", 6)
    x = spark.createDataFrame([(i, i / 4) for i in range(40)], "col bigint, x double")
    expected = {r: sum(v * c / 4 for i, c, v in entries if i == r) for r in {e[0] for e in entries}}
    for strategy in ("csr", "grid2d"):
        for exact in (None, 4):
            assert {r.row: r.y for r in spmv.spmv(a, x, strategy, grid=(2, 3), exact=exact).collect()} == expected


def test_scatter_and_slices(spark):
    a = matrix(spark, [(i, j, 1.0) for i in range(11) for j in range(3)], 11, 3)
    dealt = partition.scatter(a, 4)
    assert dealt.rdd.getNumPartitions() == 4
    assert dealt.where(F.spark_partition_id() != F.col("part")).count() == 0 and dealt.count() == 33
    x = spark.createDataFrame([(i, float(i)) for i in range(7)], "col bigint, x double")
    got = sorted(map(tuple, partition.slices(x, partition.even(spark, 7, 3)).collect()))
    assert got == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (1, 0, 3.0), (1, 1, 4.0), (2, 0, 5.0), (2, 1, 6.0)]


def greedy(w, total, parts):
    """Item by item: cut when the weight so far reaches the next share and enough items are left."""
    everything = sum(w)
    if everything <= 0:
        size, extra = divmod(total, parts)
        counts = [size + (p < extra) for p in range(parts)]
        return [(sum(counts[:p]), counts[p]) for p in range(parts)]
    starts, so_far = [0], 0.0
    for i in range(total):
        p = len(starts)
        if p < parts and i and so_far >= everything * p / parts and total - i >= parts - p:
            starts.append(i)
        so_far += w[i]
    starts += [total] * (parts - len(starts))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], total])]


def test_weighted_cuts(spark):
    random.seed(2)
    cases = [([1.0, 1.0], 3), ([1.0] * 6, 4), ([0.0] * 6, 4), ([0.0, 0.0, 5.0, 0.0], 3)]
    cases += [([float(random.choice([0, 0, 1, 2, 9])) for _ in range(random.randint(1, 14))], random.randint(1, 9)) for _ in range(14)]
    for w, parts in cases:
        table = spark.createDataFrame(list(enumerate(w)), "i bigint, w double")
        got = [(r.start, r["count"]) for r in partition.weighted(table, len(w), parts).orderBy("part").collect()]
        assert got == greedy(w, len(w), parts), (w, parts)


def test_prefix_sum_across_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("w"))
    got = [r.s for r in csr.prefix_sum(df, "i", "w", "s", bucket=64).orderBy("i").collect()]
    assert got == [sum(k % 7 for k in range(i)) for i in range(1000)]


def test_split_shards_and_grid(spark):
    a = matrix(spark, EDGE["holes"][0], 5, 2)
    assert sorted(map(tuple, partition.shards(a, 3).collect())) == [(0, 2, 1), (1, 2, 2), (2, 1, 0)]
    assert sorted(map(tuple, partition.shards(a, 8).collect()))[5:] == [(5, 0, 0), (6, 0, 0), (7, 0, 0)]
    assert [partition.grid_dims(p) for p in (1, 2, 4, 6, 7, 12)] == [(1, 1), (2, 1), (2, 2), (3, 2), (7, 1), (4, 3)]
    tagged = partition.cyclic(a.df, 3).withColumn("back", partition.global_row(3))
    assert tagged.where("back != row").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(10, 5, 100, 0.0), (10, 5, 100, 2.0)], "r long, c long, z long, t double")
    coo, cs, fl = (F.col("x") for _ in range(3))
    rows = df.select(
        metrics.bandwidth_coo(F.col("r"), F.col("c"), F.col("z"), F.col("t")).alias("coo"),
        metrics.bandwidth_csr(F.col("r"), F.col("z"), F.col("t")).alias("csr"), metrics.gflops(F.col("z"), F.col("t")).alias("fl"),
    ).collect()
    assert rows[0].coo == math.inf
    assert rows[1].coo == pytest.approx((100 * 12 + 20 + 40) / 2e9) and rows[1].csr == pytest.approx((1200 + 44 + 40) / 2e9) and rows[1].fl == pytest.approx(200 / 2e9)
    v = spark.createDataFrame([(4.0,), (1.0,), (-3.0,)], "v double")
    got = v.agg(metrics.geometric_mean(F.col("v")).alias("g"), metrics.arithmetic_mean(F.col("v")).alias("m"), metrics.spread(F.col("v"), F.lit(1.0)).alias("s")).first()
    assert got.g == pytest.approx(4 ** (1 / 3)) and got.m == pytest.approx(2 / 3) and got.s == pytest.approx(25 / 3)


def test_timing_and_sinks(spark, tmp_path):
    runs = []
    t = timing.repeat(lambda: runs.append(1), total=4, warmup=1)
    assert len(runs) == 4 and len(t.seconds) == 3 and t.mean >= 0
    assert len(timing.sweep(lambda strategy: (lambda: None), [{"strategy": s} for s in ("coo", "csr")])) == 2
    folder = sinks.folder(str(tmp_path), "m", 4, "coo", "nnz")
    sinks.write_csv(sinks.statistics(spark, [(0, 0.1, 0.2, 1.0, 2.0)]), folder + "/rank_0")
    assert spark.read.option("header", True).csv(folder + "/rank_0").columns == sinks.STATISTICS
    one = spark.createDataFrame([(0, 32, 0, 3, 3, 4, 100, 200)], ", ".join(f"{c} long" for c in sinks.FOOTPRINT[:8]))
    assert sinks.footprint(one).first()["total_memory_bytes"] == 300
    assert sinks.footprint(one, "nnz").columns[1] == "load balance mode"


def test_running_product_streams(spark, tmp_path):
    from lattis.streaming import incremental

    source = tmp_path / "in"
    schema = "row bigint, col bigint, val double, at timestamp"
    for k in range(3):
        spark.sql(f"SELECT id % 2 AS row, id AS col, double({k + 1}) AS val, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,{k},0) AS at FROM range(4)").write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental.running_product(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r.row: r.y for r in spark.table("running").collect()} == {0: 12.0, 1: 12.0}
    w = incremental.windowed_product(stream, "at", "1 minute", "1 hour").writeStream.outputMode("update").format("memory").queryName("windowed").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("windowed").groupBy("window", "row").count().count() == 6


def test_harness(spark, tmp_path):
    from lattis.plans import harness

    entries, n, m = EDGE["holes"]
    report = harness.run("m", lambda: matrix(spark, entries, n, m), "csr", parts=3, total=2, save=str(tmp_path))
    assert len(report.runs) == 1 and report.head == [(3, 4.0)] and "y[3] = 4" in report.summary() and len(report.lines()) == 1
    folder = sinks.folder(str(tmp_path), "m", 3, "csr", "uniform")
    saved = spark.read.option("header", True).csv(folder + "/memory_footprint")
    assert saved.columns == sinks.FOOTPRINT and saved.count() == 3
    # the second matrix is slow to read: that is communication, not execution
    def slow():
        time.sleep(1.5)
        return matrix(spark, EDGE["repeated"][0], 2, 4)

    reports = harness.run_all({"m": lambda: matrix(spark, entries, n, m), "slow": slow}, total=1, warmup=0, save=str(tmp_path / "all"), grid=(2, 1), balances=("uniform", "nnz"), parts=2, threads=128, shared=1024)
    assert len(reports) == 2 * (len(spmv.STRATEGIES) + 1) and {r.balance for r in reports if r.strategy == "grid2d"} == {"uniform", "nnz"}
    for r in reports:
        ((_, comm, execution, _, _),) = r.runs
        assert r.head == ([(3, 4.0)] if r.name == "m" else [(0, 4.0)])
        assert execution > 0 and (r.name == "m" or comm > 1.5)
        saved = spark.read.option("header", True).csv(sinks.folder(str(tmp_path / "all"), r.name, 2, r.strategy, r.balance, 128, 1024) + "/statistics")
        assert saved.columns == sinks.STATISTICS and saved.count() == 1
    assert "threads=128/shared=1024" in sinks.folder("a", "m", 2, "coo", threads=128, shared=1024)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lattis_")]
    assert harness.task_count(spark, 10**9) == 250 and "version" in harness.cluster(spark)


def test_many_parts(spark):
    """Blocks of 2,000 parts by one array search, with empty parts between."""
    bounds = [(p, p * 3) for p in range(2000) if p % 5]
    block, start = partition.part_at(F.col("id"), bounds)
    rows = spark.range(0, 6100, 7).select("id", block.alias("b"), start.alias("s")).collect()
    for r in rows:
        expected = max((b for b in bounds if b[1] <= r.id), default=(None, None))
        assert (r.b, r.s) == expected
    assert spark.range(3).select(partition.part_at(F.col("id"), [])[0].alias("b")).where("b is null").count() == 3
