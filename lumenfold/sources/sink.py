"""Records out of table rows (SNK-1/2, COE-10): a column of binary records, to be kept in any table that Spark writes."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import LONGEST, SHAPES, WHOLE_VRS
from ..functions.tags import CHARSET_VRS, STRING_VRS, lookup, tag_of
from . import p10
from .batches import batched, spread


def build(rows: DataFrame, instance: str, values: dict[str, str], syntax: str = p10.EXPLICIT, charset: str = "ISO_IR 192") -> DataFrame:
    r"""(instance_id, content, error): a record per row, with the columns of `values` (keyword or tag to column name) as elements.

    Arrays are several values; null columns give no element. Text is UTF-8, or in a charset of one byte a character, and says so. A value that its VR or charset can't hold makes the content null with an error.
    """
    known = []
    for keyword, column in values.items():
        tag = tag_of(keyword)
        if tag is None:
            raise ValueError(f"unknown tag {keyword}")
        known.append((int(tag, 16), (lookup(tag) or ("", "UN"))[1], column))
    schema = pa.schema([("instance_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (made(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))))

    def in_charset(vr: str, value):
        return value.encode(p10.CHARSETS[charset]) if vr in CHARSET_VRS and isinstance(value, str) else value

    def made(name: str, *values) -> tuple:
        try:
            found = [(0x00080005, "CS", charset), *((tag, vr, in_charset(vr, encoded(vr, v))) for (tag, vr, _), v in zip(known, values) if v is not None)]
            return name, p10.write(found, syntax), None
        except (ValueError, OverflowError, TypeError, KeyError, struct.error) as e:
            return name, None, str(e)

    columns = [F.col(c).alias(f"v{j}") for j, (_, _, c) in enumerate(known)]
    return spread(rows.select(F.col(instance).cast("string").alias("instance_id"), *columns)).mapInArrow(run, "instance_id string, content binary, error string")


def valid(vr: str, value) -> str | None:
    """Why a value isn't one of its VR, or null: text by shape and length, numbers by type and range."""
    several = value if isinstance(value, (list, tuple)) else [value]
    if vr in STRING_VRS:
        for v in map(_text, several):
            parts = v.split("=") if vr == "PN" else [v]
            if vr in LONGEST and max(map(len, parts)) > LONGEST[vr]:
                return f"{vr} holds {LONGEST[vr]} characters, not {len(v)}"
            if v and vr in SHAPES and not re.fullmatch(SHAPES[vr], v):
                return f"{v[:20]!r} is no {vr}"
            if "\\" in v and vr not in WHOLE_VRS:
                return f"a value of {vr} has no backslash"
            if vr == "IS" and v and not -(2**31) <= int(v) < 2**31:
                return f"{v} is out of range for IS"
    elif vr in p10.NUMBERS:
        kind = np.dtype(p10.NUMBERS[vr])
        for v in several:
            if isinstance(v, bool) or not isinstance(v, (int, float)) or kind.kind != "f" and (isinstance(v, float) or not np.iinfo(kind).min <= v <= np.iinfo(kind).max):
                return f"{v!r} is out of range for {vr}"
    return None


def encoded(vr: str, value, strict: bool = False):
    """A value as `p10.write` takes it. With `strict`, text must also have its VR's shape and length."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if (strict or vr in p10.NUMBERS) and (why := valid(vr, value)) is not None:
        raise p10.Broken(why)
    if vr in STRING_VRS:
        return "\\".join(map(_text, value)) if isinstance(value, (list, tuple)) else _text(value)
    several = value if isinstance(value, (list, tuple)) else [value]
    if vr == "AT":
        return b"".join(int(v).to_bytes(4, "little")[2:] + int(v).to_bytes(4, "little")[:2] for v in several)
    return list(several)


def _text(value) -> str:
    return str(value) if not isinstance(value, float) else f"{value:.10g}"


def write_files(records: DataFrame, folder: str, suffix: str = ".dcm") -> DataFrame:
    """(instance_id, path, size, error): each content of (instance_id, content) as a file under a folder that every executor reaches, named by a hash of its instance.

    A file is written under another name first and then renamed, so a task that runs again leaves whole files. Null contents are errors. Rows are written when the result is computed.
    """
    schema = pa.schema([("instance_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        yield from batched(schema, (saved(target, base, *row) for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))

    def saved(target: fs.FileSystem, base: str, instance: str, content: bytes | None) -> tuple:
        if content is None:
            return instance, None, None, "no content"
        path = f"{base}/{hashlib.sha256(str(instance).encode()).hexdigest()[:40]}{suffix}"
        part = f"{path}.{uuid.uuid4().hex}"
        try:
            with target.open_output_stream(part) as out:
                out.write(content)
            target.move(part, path)
        except OSError as e:
            return instance, None, None, str(e)
        return instance, path, len(content), None

    return records.select(F.col("instance_id").cast("string").alias("instance_id"), "content").mapInArrow(run, "instance_id string, path string, size long, error string")
