import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lattis.llm import warc
from lattis.llm.common import new_path

LONG = "<html>" + "same " * 300 + "é</html>"


def table(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abc <>\n") for _ in range(rng.randint(0, 3000)))) for i in range(40)]
    rows += [(50, "http://x\r\ny", LONG), (51, None, LONG), (60, "u", LONG), (70, "s", "short"), (71, "s", "short"), (80, "n", None), (None, "z", LONG), (81, "r", "WARC/1.1\r\n\r\n" * 200), (82, "big", "x" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def expected(rows):
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and len(data) >= 1000 and j is not None]
        first = max(same, default=None)
        revisit = first is not None and i != first
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None


def test_round_trip(spark, odd):
    rows, df = table(spark)
    got = sorted(map(tuple, warc.round_trip(odd(df)).collect()), key=str)
    assert got == sorted(expected(rows), key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_source_filters_and_headers(spark, compression):
    warc.register(spark)
    path = new_path(spark, "warc-test")
    rows = [(f"<urn:t:{i}>", ["resource", "metadata"][i % 2], f"http://h/{i}", bytearray(b"\r\n\r\nWARC/1.1" * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "record_id string, warc_type string, target_uri string, payload binary")
    df.write.format("warc").option("compression", compression).mode("append").save(path)
    read = spark.read.format("warc").load(path)
    assert read.where("warc_type = 'warcinfo'").count() >= 1
    assert {r.record_id: r.payload for r in read.where("warc_type in ('resource', 'metadata')").collect()} == {r[0]: r[3] for r in rows}
    one = read.where("target_uri = 'http://h/7'")
    assert [r.payload for r in one.collect()] == [rows[7][3]]
    assert "warc_type" in str(spark.read.format("warc").load(path).where("warc_type = 'x'")._jdf.queryExecution().executedPlan())
    assert read.where(F.col("target_uri").startswith("http://h/2") & (F.col("payload_length") > 0)).count() == 11
    assert read.where("target_uri is null").where("warc_type != 'warcinfo'").count() == 0
    head = spark.read.format("warc").option("payload", "false").load(path).where("record_id = '<urn:t:5>'").first()
    assert head.payload is None and head.headers["warc-target-uri"] == "http://h/5" and head.payload_digest == hashlib.sha1(rows[5][3]).hexdigest()
    df.limit(2).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).where("warc_type != 'warcinfo'").count() == 2


def test_reader_passes_over_blocks(tmp_path):
    records = [{"warc_type": "resource", "record_id": f"<{i}>", "payload": bytes([65 + i]) * 5_000_000} for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record, records)))
    reader = warc.WarcReader({"path": str(tmp_path)})
    reader.filters = [("record_id", "=", "<2>")]

    class Counting:
        def __init__(self, raw):
            self.raw, self.bytes = raw, 0

        def read(self, n):
            out = self.raw.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.raw, name)

    with (tmp_path / "a.warc").open("rb") as f:
        counting = Counting(f)
        got = list(reader.records(warc.Reader(counting, False)))
    assert [r["record_id"] for r in got] == ["<2>"] and counting.bytes < 9_000_000


def test_broken_records(tmp_path):
    """A header without a usable length is passed over up to the next record; a cut record is left out."""
    good = [warc.record({"warc_type": "resource", "record_id": f"<{i}>", "payload": b"abc" * i}) for i in range(4)]
    bad = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: many\r\n\r\nsome bytes\r\n\r\n"
    endless = b"WARC/1.1\r\nWARC-Type: resource\r\n" + b"x" * (2 * warc.HEAD_BYTES) + b"\r\n\r\n"
    reader = warc.WarcReader({"path": str(tmp_path)})
    for data in (good[0] + bad + good[1] + b"\r\n\r\n" + good[2] + endless + good[3] + good[3][:-12], b"", b"no archive at all"):
        (tmp_path / "a.warc").write_bytes(data)
        with (tmp_path / "a.warc").open("rb") as f:
            got = [(r["record_id"], r["payload"]) for r in reader.records(warc.Reader(f, False))]
        assert got == ([(f"<{i}>", b"abc" * i) for i in range(4)] if data.startswith(b"WARC") else [])


def test_repeated_rows_of_the_largest_id(spark):
    df = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG), (2, "u", LONG)], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]
