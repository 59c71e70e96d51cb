import pytest

from lattis.model import Matrix, Shape
from lattis.operators import spmv
from lattis.sources import matrix_market as mm

BANNER = "%%MatrixMarket matrix coordinate real general\n"
TINY = "3 3 4\n1 1 2\n1 3 1\n3 2 5\n3 3 -5\n"
CASES = {
    "tiny": (BANNER + TINY, [3, 0, 0]),
    "rect": (BANNER + "2 4 3\n1 4 1.5\n2 1 2\n2 4 0\n", [1.5, 2]),
    "dup": (BANNER + "2 2 3\n1 1 1\n1 1 2\n2 2 4\n", [3, 4]),
    "unsorted": (BANNER + "3 3 3\n3 3 3\n1 1 1\n2 2 2\n", [1, 2, 3]),
    "messy": ("\n% note\n \t\r\n3 3 4\r\n1\t1\t2\r\n% middle\n\n  1 3 1\n3 2 5\n3 3 -5", [3, 0, 0]),
    "bad": (BANNER + "3 3 9\na b c\n9 9 1\n0 1 1\n1 1\n1 1 2x\n1 1 2\n", [2, 0, 0]),
    "empty": (BANNER + "4 4 0\n", [0, 0, 0, 0]),
    "long comment": ("%" + "x" * 5000 + "\n2 2 1\n2 2 7\n", [0, 7]),
}


def write(tmp_path, text):
    path = tmp_path / "m.mtx"
    path.write_bytes(text.encode())
    return str(path)


def y_of(matrix):
    return [r.y for r in spmv.spmv(matrix, dense=True).orderBy("row").collect()]


@pytest.mark.parametrize("case", CASES)
def test_reader(spark, tmp_path, case):
    text, expected = CASES[case]
    assert y_of(mm.read(spark, write(tmp_path, text))) == expected


def test_splits_change_nothing(spark, tmp_path):
    import random

    random.seed(4)
    entries = [(random.randint(1, 50), random.randint(1, 50), random.randint(-9, 9)) for _ in range(3000)]
    path = write(tmp_path, BANNER + "50 50 3000\n" + "".join(f"{r} {c} {v}\n" for r, c, v in entries))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        matrix = mm.read(spark, path, mode="failfast")
        assert matrix.df.rdd.getNumPartitions() >= 10
        got = y_of(matrix)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [sum(v for r, _, v in entries if r == i + 1) for i in range(50)]


def test_failfast_and_missing_header(spark, tmp_path):
    with pytest.raises(Exception, match="bad matrix line"):
        y_of(mm.read(spark, write(tmp_path, CASES["bad"][0]), mode="failfast"))
    with pytest.raises(ValueError, match="no header"):
        mm.read(spark, write(tmp_path, "% only\n"))
    with pytest.raises(Exception):
        mm.read(spark, str(tmp_path / "missing.mtx"))


def test_symmetric_and_pattern(spark, tmp_path):
    half = "%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 1\n2 1 5\n"
    assert y_of(mm.read(spark, write(tmp_path, half))) == [1, 5]
    assert y_of(mm.read(spark, write(tmp_path, half), symmetric="expand")) == [6, 5]
    pattern = "%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 1\n2 1\n"
    with pytest.raises(ValueError, match="pattern"):
        mm.read(spark, write(tmp_path, pattern))
    assert y_of(mm.read(spark, write(tmp_path, pattern), pattern="ones")) == [1, 1]


def test_writer_round_trip(spark, tmp_path):
    matrix = mm.read(spark, write(tmp_path, BANNER + "3 3 5\n3 3 0.1\n1 2 1e300\n1 1 3\n1 1 -2.5\n2 2 1.25e-7\n"))
    mm.write_sorted(matrix, str(tmp_path / "out"), single_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == [mm.SORTED_BANNER, "3 3 5", "1 1 -2.5", "1 1 3", "1 2 1e+300", "2 2 1.25e-07", "3 3 0.1"]
    again = mm.read(spark, str(part))
    assert again.shape == Shape(3, 3)
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, matrix.df.collect()))


def test_folder_of_parts(spark, tmp_path):
    """What a distributed write leaves reads back whole; a line that looks like the header stays an entry."""
    entries = [(i % 40, i % 7, 1.0 + i / 8) for i in range(900)] + [(39, 39, 903.0), (39, 39, 903.0), (0, 0, 5.0)]
    matrix = Matrix(spark.createDataFrame(entries, "row bigint, col bigint, val double"), Shape(40, 40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mm.write_sorted(matrix, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 1 and all(p.read_text().splitlines()[:2] == [mm.SORTED_BANNER, "40 40 903"] for p in parts)
    again = mm.read(spark, str(tmp_path / "out"), mode="failfast")
    assert again.shape == Shape(40, 40) and sorted(map(tuple, again.df.collect())) == sorted(entries)
    (tmp_path / "out" / "more.mtx").write_text("3 3 1\n1 1 1\n")
    with pytest.raises(ValueError, match="differ"):
        mm.read(spark, str(tmp_path / "out"))
    mm.write_sorted(Matrix(matrix.df.limit(0), Shape(2, 3)), str(tmp_path / "none"))
    assert mm.read(spark, str(tmp_path / "none")).shape == Shape(2, 3) and mm.read(spark, str(tmp_path / "none")).df.count() == 0


def test_sort_files(spark, tmp_path):
    for name, text in (("a.mtx", "2 2 2\n2 1 1.5\n1 2 1\n"), ("b.mtx", "1 1 1\n1 1 4\n")):
        (tmp_path / name).write_text(text)
    first, second = mm.sort_files(spark, [str(tmp_path / "a.mtx"), str(tmp_path / "b.mtx")], str(tmp_path / "sorted"))
    assert first.endswith("sorted_a.mtx") and y_of(mm.read(spark, first)) == [1, 1.5] and y_of(mm.read(spark, second)) == [4]


def test_many_files_with_headers_of_their_own(spark, tmp_path):
    """1,100 files, each with its own number of entries in its header; one of another shape raises."""
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(1100):
        (folder / f"f{i:04}.mtx").write_text(f"{BANNER}5000 5000 {i + 1}\n{i + 1} 2 {i}\n")
    # one file holds its header's text as entries too
    (folder / "f0007.mtx").write_text(f"{BANNER}5000 5000 8\n5000 5000 8\n5000 5000 8\n8 2 7\n")
    again = mm.read(spark, str(folder), mode="failfast")
    got = sorted(map(tuple, again.df.collect()))
    assert got == sorted([(i, 1, float(i)) for i in range(1100)] + [(4999, 4999, 8.0)] * 2)
    assert mm.counted(spark, str(folder)) == (1100 * 1101 // 2, 1102)
    (folder / "g.mtx").write_text(f"{BANNER}5000 5001 1\n1 1 1\n")
    with pytest.raises(ValueError, match="differ"):
        mm.read(spark, str(folder))
    (folder / "g.mtx").write_text("5000 x 1\n1 1 1\n")
    with pytest.raises(ValueError, match="bad header"):
        mm.read(spark, str(folder))


def test_text_is_c_text(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    values = [float(f"{rng.randint(-(10**6), 10**6)}.{rng.randint(0, 10 ** rng.randint(1, 13))}") for _ in range(20_000)]
    values += [258.4208332655, 99999999999.95, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, 2.2e-308, 1e300, -1e22, 1e-5, 123456789012345.0, 0.5, 1e15, 999999999999.5]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    rows = df.select("v", mm.value_text(F.col("v")).alias("t"), mm.value_text(F.col("v"), 3).alias("s")).collect()
    assert len(rows) == len(values)
    assert [(r.v, r.t, r.s) for r in rows if r.t != "%.12g" % r.v or r.s != "%.3g" % r.v] == []


def test_single_precision(spark, tmp_path):
    path = write(tmp_path, BANNER + "1 2 2\n1 1 0.1\n1 2 0.5\n")
    import numpy as np

    assert sorted(r.val for r in mm.read(spark, path, single=True).df.collect()) == [float(np.float32(0.1)), 0.5]
    df = spark.createDataFrame([(0, 0, 0.1)], "row bigint, col bigint, val double")
    assert Matrix.of(df, Shape(1, 1), single=True).df.first().val == float(np.float32(0.1))


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    """No string minimum over all lines: it would sort a task's whole share of the text.  Repeats of header lines change nothing."""
    folder = tmp_path / "m"
    folder.mkdir()
    for name, body in (("a", "% c\n2 2 2\n1 1 3\n2 2 2\n"), ("b", BANNER + "2 2 2\n2 2 2\n1 2 5\n"), ("c", "%only\n\n")):
        (folder / name).write_text(body)
    found = {r.file[-1]: (r.header, r.banner) for r in mm.file_headers(spark, str(folder)).collect()}
    assert {k: v for k, v in found.items() if v != (None, None)} == {"a": ("2 2 2", None), "b": ("2 2 2", BANNER.strip())}
    assert sorted((r.row, r.col, r.val) for r in mm.read(spark, str(folder)).df.collect()) == [(0, 0, 3.0), (0, 1, 5.0), (1, 1, 2.0), (1, 1, 2.0)]
    plans = []
    keep, mm._kept = mm._kept, lambda table, tag: (plans.append(table._jdf.queryExecution().executedPlan().toString()), keep(table, tag))[1]
    try:
        mm.file_headers(spark, str(folder))
    finally:
        mm._kept = keep
    assert plans and "SortAggregate" not in plans[0]


def test_sorted_parts_grow_with_the_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mm, "PART_ROWS", 10)
    n = 10 * int(spark.conf.get("spark.sql.shuffle.partitions")) + 55
    entries = spark.range(n).selectExpr("(id * 7919) % 1000 as row", "id as col", "id / 3.0 as val")
    mm.write_sorted(Matrix(entries, Shape(1000, n)), str(tmp_path / "s"))
    texts = [p.read_text().splitlines() for p in sorted((tmp_path / "s").glob("part-*"))]
    lines = [x for t in texts for x in t[2:]]
    assert len(lines) == n and max(map(len, texts)) < 60
    assert lines == sorted(lines, key=lambda x: (int(x.split()[0]), int(x.split()[1])))
