"""WARC files as a Python data source, and deduplicated archives of web pages.

``spark.read.format("warc")`` plans partitions of whole files (small ones together), takes
filters on the record type and other header fields from Catalyst, reads a record's header
first, and passes over the block of a record that no filter wants: plain files seek, gzip
members are inflated in pieces that are dropped, never joined or decoded.  With the option
``payload=false`` all blocks are passed over.

``df.write.format("warc")`` gives each task files of its own under ``_temporary``; the commit
moves those of the tasks that won into place, so retried and lost tasks leave nothing.
Each record is a gzip member (option ``compression=none``: plain).

Paths are URIs for ``pyarrow.fs``.  The archive folder must be shared by all executors.

Defined cases: a null payload is empty; control characters in a header value are percent-encoded
(percent signs stay as they are, so that URIs do); a null header value is left out; other record
types than asked for never show; an empty table gives an archive without page records.  Repeated
rows have a record each; of rows that share the largest id each is a response.  A header without
a readable length, or of over ``HEAD_BYTES``, is passed over up to the next line that starts a
record; a record that ends early with its file is left out.  Damaged gzip data stop the job.
Ids that are no whole numbers are null when read back.  Columns beyond id, address and payload are not looked at.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import bounded_batches, cut, new_path

SCHEMA = (
    "record_id string, warc_type string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_length bigint, refers_to string, headers map<string,string>, payload binary"
)
#: The header fields of the columns.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE, BATCH_BYTES, BATCH_ROWS, PARTITION_BYTES, FILE_BYTES = 1 << 20, 8 << 20, 2048, 64 << 20, 1 << 30
#: Bytes of a record's header, at most.
HEAD_BYTES = 1 << 20
#: Payloads at least this long are stored once.
MIN_SHARED = 1000
#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_GROUPS = 100_000

_ARROW = pa.schema(
    [(n, pa.int64() if n == "payload_length" else pa.string()) for n in FIELDS]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


# --- records -----------------------------------------------------------------------------


class Reader:
    """Bytes of a plain or gzip file in order, with a way to pass over some."""

    def __init__(self, raw, packed: bool):
        self.raw, self.inflate = raw, zlib.decompressobj(31) if packed else None
        self.buffer, self.rest = bytearray(), b""

    def _piece(self) -> bytes:
        if self.inflate is None:
            return self.raw.read(PIECE)
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data or self.rest, zlib.decompressobj(31)
            data = self.rest or self.raw.read(PIECE)
            if not data:
                return b""
            out = self.inflate.decompress(data, PIECE)
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What stands before a mark, or ``most`` bytes and more if that has no end; None at the end."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            if len(self.buffer) >= most:
                at = len(self.buffer)
                break
            start = max(0, len(self.buffer) - len(mark))
            more = self._piece()
            if not more:
                return None
            self.buffer += more
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def pass_to(self, mark: bytes) -> bool:
        """Drop all before a mark; whether there is one."""
        while (at := self.buffer.find(mark)) < 0:
            del self.buffer[: max(0, len(self.buffer) - len(mark) + 1)]
            more = self._piece()
            if not more:
                return False
            self.buffer += more
        del self.buffer[:at]
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and (more := self._piece()):
            self.buffer += more
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        if len(out) < n:
            raise EOFError("a record ends early")
        return out

    def skip(self, n: int) -> None:
        have = min(n, len(self.buffer))
        del self.buffer[:have]
        n -= have
        if n and self.inflate is None:
            self.raw.seek(self.raw.tell() + n)
            return
        while n:
            piece = self._piece()
            if not piece:
                raise EOFError("a record ends early")
            self.buffer += piece[n:]
            n -= min(n, len(piece))


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines belong to the field before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def hex_digest(value: str | None) -> str | None:
    """A sha1 digest as bare lower-case hex; others as they are."""
    if value and value.lower().startswith("sha1:"):
        value = value[5:]
        try:
            return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
        except ValueError:
            return value
    return value


def columns_of(fields: dict[str, str]) -> dict:
    row = {column: fields.get(name.lower()) for column, name in FIELDS.items()}
    row["payload_digest"] = hex_digest(row["payload_digest"])
    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
    return row


def _safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(row: dict) -> bytes:
    """One WARC record; ``payload`` is left out of revisits, whose digest and length stay."""
    payload = row.get("payload") or b""
    kind = row.get("warc_type") or "resource"
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    length = row.get("payload_length")
    length = len(payload) if length is None else length
    body = b""
    content = row.get("content_type")
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {_safe(content or 'text/html; charset=utf-8')}\r\nContent-Length: {length}\r\n\r\n".encode()
        body, content = http + (payload if kind == "response" else b""), "application/http; msgtype=response"
    else:
        body = payload
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "WARC-Target-URI": row.get("target_uri"), "WARC-Refers-To": row.get("refers_to"), "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "X-Payload-Length": str(length), "Content-Type": content, "Content-Length": str(len(body)),
    }
    head = "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


# --- data source ---------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded_batches(spark)
    spark.dataSource.register(WarcSource)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", In: "in", StringStartsWith: "starts", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "there", IsNull: "null"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in kinds and column in FIELDS:
                self.filters.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            x = row[column]
            if kind == "null":
                good = x is None
            elif x is None:
                good = False
            elif kind == "there":
                good = True
            elif kind == "in":
                good = x in value
            elif value is None:
                good = False
            else:
                good = {"=": lambda: x == value, "starts": lambda: x.startswith(value), ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value}[kind]()
            if not good:
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, path = file_system(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        files = [f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name.endswith((".warc", ".warc.gz"))]
        out, paths, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if paths and size + f.size > PARTITION_BYTES:
                out.append(Files(paths))
                paths, size = [], 0
            paths.append(f.path)
            size += f.size
        return [*out, Files(paths)] if paths or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in self.records(Reader(raw, path.endswith(".gz"))):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def records(self, source: Reader) -> Iterator[dict]:
        with contextlib.suppress(EOFError):  # the last record may end early
            yield from self._records(source)

    def _records(self, source: Reader) -> Iterator[dict]:
        while (head := source.until(b"\r\n\r\n", HEAD_BYTES)) is not None:
            if not head.strip():
                continue
            fields = fields_of(head.lstrip(b"\r\n"))
            size = fields.get("content-length", "")
            if len(head) >= HEAD_BYTES or not (size.isascii() and size.isdigit()):
                if not source.pass_to(b"\nWARC/"):
                    return
                continue
            length = int(size)
            row = columns_of(fields)
            if not self.wanted(row):
                source.skip(length + 4)
                continue
            row["headers"], row["payload"] = list(fields.items()), None
            if self.payload and row["warc_type"] != "revisit":
                block = source.take(length)
                if (row["content_type"] or "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
                source.skip(4)
            else:
                source.skip(length + 4)
            yield row


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed = options.get("compression", "gzip") != "none"
        self.level = int(options.get("level", 4))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        fs, path = file_system(self.path)
        return fs, path, f"{path}/_temporary-{self.job}"

    def _member(self, row: dict) -> bytes:
        data = record(row)
        if not self.packed:
            return data
        deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return deflate.compress(data) + deflate.flush()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self._folder()
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for values in zip(*columns.values()):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                        out.write(self._member({"warc_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}))
                    data = self._member(dict(zip(columns, values)))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, path, folder = self._folder()
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{folder}/{name}", f"{path}/{name}")
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
        with fs.open_output_stream(f"{path}/_SUCCESS", compression=None) as f:
            f.write(b"")

    def abort(self, messages: list) -> None:
        fs, _, folder = self._folder()
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


# --- archives of pages ----------------------------------------------------------------------


def archive(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html", broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Write every page; of long equal payloads the one with the largest id is the response, others revisit it."""
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(ident).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("bigint"))
    # only groups of several: digests are combined before the shuffle, payloads are never shuffled for it
    shared = cut(rows.where(F.col("n") >= MIN_SHARED).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "shared")
    side = F.broadcast(shared) if shared.count() <= broadcast_groups else shared
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    rows.join(side, ["digest", "n"], "left").select(
        name("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All page records of an archive; lengths and digests of responses come from what was read."""
    register(spark)
    there = spark.read.format("warc").load(path).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    stored = F.col("payload").isNotNull()
    return there.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path)
    return read_pages(spark, path)
