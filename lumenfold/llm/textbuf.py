"""Arrow text columns as flat NumPy buffers, and the shared-folder helpers of the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = (1 << 20) - (1 << 16)
NULL_ID = -(2**63)


@dataclass
class Texts:
    """UTF-8 bytes of several texts end to end, with n + 1 offsets."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def texts_of(array: pa.Array) -> Texts:
    """Null texts are empty."""
    array = array.fill_null("") if array.null_count else array
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf[off[0] : off[-1]], off - off[0])


def steps(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about `limit` bytes of text each."""
    for batch in batches:
        n, whole = batch.num_rows, texts_of(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(whole.off, whole.off[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            part = whole.off[at : to + 1]
            yield batch.slice(at, to - at), Texts(whole.buf[part[0] : part[-1]], part - part[0])
            at = to
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system: workers wait for their next task beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def id_array(ids: pa.Array) -> np.ndarray:
    """Document ids as int64, null as NULL_ID."""
    return ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def quoted(name: str) -> Column:
    """A top-level column, whatever its name holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that are needed, so that others reach neither the scan nor Python."""
    return docs.select(*map(quoted, names or ("doc_id", "text")))


def numbered(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as c0, c1, .., so that no name of a table's own clashes with one used here."""
    return docs.select(*(quoted(n).alias(f"c{k}") for k, n in enumerate(names)))


def fresh(docs: DataFrame, stem: str) -> str:
    """A prefix that no column of the table begins with."""
    while any(c.lower().startswith(stem.lower()) for c in docs.columns):
        stem = f"_{stem}"
    return stem


def others(docs: DataFrame) -> list[str]:
    """The columns besides doc_id and text."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def with_carried(columns: list[tuple[str, str]], docs: DataFrame, carry: list[str]) -> StructType:
    """The schema of a result of (name, type) columns that goes on with columns of `docs`."""
    own = [StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType) for name, kind in columns]
    return StructType([*own, *(StructField(c, docs.schema[c].dataType) for c in carry)])


def carried(made: pa.RecordBatch, batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """`made` and the columns of `batch` from the first-th on."""
    return pa.RecordBatch.from_arrays([*made.columns, *batch.columns[first:]], names=[*made.schema.names, *batch.schema.names[first:]])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session gets one of its own where none is configured, as in tests; on a cluster that is an error, for workers share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'lumenfold-shared')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends there and no step runs twice. The folder goes when the session ends, or by `clear`."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Has the driver look for shuffles that nothing refers to any more, whose files executors then delete; without it they stay until its memory is short."""
    spark._jvm.System.gc()


_SESSION = uuid.uuid4().hex
_CLEARED: set[str] = set()


def session_folder(spark: SparkSession) -> str:
    """This process's part of the shared folder, deleted when it ends."""
    path = f"{shared_folder(spark)}/lumenfold/{_SESSION}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(clear, spark, path)
    return path


def clear(spark: SparkSession, path: str | None = None) -> None:
    """Deletes what `stored` has written; results that are still to be computed from it can't be any more."""
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark._jvm.org.apache.hadoop.fs.Path(path or session_folder(spark))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out():
    """Rows on which no model is fitted: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
