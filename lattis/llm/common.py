"""Helpers that the operators of this subpackage share.

Working tables are written to the folder that the cluster names in
``spark.checkpoint.dir`` (all executors and the driver see it), so a lost executor costs
a re-read, never a recomputation of Python stages, and never a wrong result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch, so that very long rows do not pile up in a Python worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048
#: Name of the column that carries the text to Python.
TEXT = "__text"

_local: dict[str, str] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lattis-")
    return _local[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lattis-{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and in bytes, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(text: str = "text") -> F.Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(text).cast("string").cast("binary").alias(TEXT)


def release(work: object) -> None:
    """End of a task: caches that ``work`` offers to drop go, and free memory goes back to the system.

    Workers are used again by later stages, beside the executor's own memory.
    """
    getattr(work, "close", int)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``hold`` bytes; as they are without it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not hold:
            yield batch
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= hold:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    make: Callable[[], Callable[[list[bytes | None]], list]],
    fields: str,
    hold: int = 0,
) -> DataFrame:
    """Columns ``keep`` of every row, and the columns that Python derives from its text.

    ``make`` runs once per task and returns the function for a batch of texts, which
    returns one list (or Arrow array) for each column of ``fields`` (a DDL string); its
    ``close``, if any, is called at the end of the task.  ``hold``: bytes that batches are gathered to.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    source = df.select(*keep, as_bytes(text))
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([f for f in source.schema.fields if f.name != TEXT] + made.fields)
    arrow = [to_arrow(f.dataType) for f in made.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in gathered(batches, hold):
            columns = batch.columns
            derived = work(columns[-1].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*columns[:-1], *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(derived, arrow, strict=True))],
                names=names,
            )
        release(work)

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def rewrite_rows(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[bytes | None]], tuple[list | None, list | None]]],
    length: str = "n_chars",
    hold: int = 0,
) -> DataFrame:
    """The rows of ``df`` with new texts, or without those that the function rejects.

    The function takes a batch of texts and returns (new texts or None, flags of the rows
    that stay or None); its ``close``, if any, is called at the end of a task.  Where a text
    changes, a column ``length`` follows it.
    """
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)
    counts = df.columns.index(length) if length in df.columns else None
    kind, count_kind = (None if i is None else to_arrow(df.schema.fields[i].dataType) for i in (at, counts))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in gathered(batches, hold):
            columns = list(batch.columns)
            old = columns[at].cast(pa.binary()).to_pylist()
            texts, flags = work(old)
            if texts is not None:
                new = [x if isinstance(x, bytes) or x is None else x.encode() for x in texts]
                columns[at] = pa.array(new, pa.binary()).cast(kind)
                if counts is not None:
                    given = columns[counts].to_pylist()
                    columns[counts] = pa.array(
                        [g if n is o or n == o else None if n is None else len(n.decode("utf-8", "replace")) for g, n, o in zip(given, new, old)],
                        count_kind,
                    )
            batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch if flags is None else batch.filter(pa.array(flags, pa.bool_()))
        release(work)

    return df.mapInArrow(run, df.schema)
