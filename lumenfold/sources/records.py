"""Files or binary columns of records as element and instance tables (SRC-1..5, SRC-8, SRC-15/16)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tags import CHARSET_VRS, STRING_VRS, lookup
from ..operators.elements import wanted_tree
from . import charset, p10
from .batches import batched

ELEMENTS = "instance_id string, path string, depth int, parent_path string, item_index int, ordinal int, tag bigint, tag_hex string, keyword string, vr string, vm int, length bigint, present boolean, raw binary, text string, strings array<string>, longs array<bigint>, doubles array<double>, error string"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(instance_id, content) of all files under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("instance_id"), "content")


#: Columns that need an element's value decoded.
VALUES = {"vm", "text", "strings", "longs", "doubles"}


def _row(e: p10.Element, instance: str, ordinal: int, values: bool = True) -> tuple:
    known = lookup(e.tag_hex)
    text = strings = longs = doubles = None
    vm = 0
    if not values:
        pass
    elif e.raw is not None and e.vr in STRING_VRS:
        text = charset.decode(e.raw, e.charset, delimiters=b"\\^=" if e.vr == "PN" else b"\\") if e.vr in CHARSET_VRS else p10.decode_text(e.raw, "ISO_IR 100")
        if text is not None:
            text = text.strip("\0 ") if e.vr not in ("LT", "ST", "UT", "UC") else text.rstrip("\0 ")
            strings = [s.strip("\0 ") for s in text.split("\\")] if e.raw and e.vr not in ("LT", "ST", "UT", "UR") else None
            if e.vr in ("DS", "IS") and strings:
                try:
                    doubles = [float(s) for s in strings if s]
                    longs = [int(s) for s in strings if s] if e.vr == "IS" else None
                except ValueError:
                    doubles = longs = None
        vm = e.raw.count(b"\\") + 1 if e.raw else 0
    elif e.raw is not None and (numbers := p10.numbers(e.raw, e.vr)) is not None:
        vm = len(numbers)
        doubles = numbers.astype("f8").tolist()
        longs = numbers.tolist() if e.vr not in ("FL", "FD") and all(v < 2**63 for v in numbers.tolist()) else None
    elif e.raw is not None:
        vm = 1 if e.raw else 0
    raw = e.raw if e.raw is not None else b"".join(e.fragments) if e.fragments else None
    return instance, e.path, e.depth, e.parent, e.item, ordinal, e.tag, e.tag_hex, known[0] if known else None, e.vr, vm, e.length, True, raw, text, strings, longs, doubles, None


def elements(records: DataFrame, load_until: int | None = None, select: dict | None = None, keep_on_error: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Element rows of (instance_id, content), in preorder.

    A record that is broken gives the rows read so far and one row whose error says why; without keep_on_error it ends the job, unless
    nothing of it could be read. With `select`, a projection tree, other elements are skipped at every depth without being decoded; a sequence keeps its
    own row. Null contents give one error row. `columns` (two at least) names the columns that are to leave the worker, in any order; others are not made.
    """
    wanted = wanted_tree(select) if select is not None else None
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(ELEMENTS)
    names = kind.names
    if columns is not None:
        kind = StructType([kind[c] for c in columns])
    schema, picked, decoded = to_arrow_schema(kind), None if columns is None else itemgetter(*map(names.index, columns)), columns is None or not VALUES.isdisjoint(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1)) for row in rows(instance, content.as_py()))
        yield from batched(schema, found if picked is None else map(picked, found))

    def rows(instance: str, content: bytes | None) -> Iterator[tuple]:
        parser, n = p10.Parser(content or b"", load_until, wanted), 0
        for e in parser.elements():
            yield _row(e, instance, n, decoded)
            n += 1
        error = parser.error if content else "no content"
        if error is not None and (keep_on_error or not n):
            yield instance, "", 0, "", None, n, None, None, None, None, 0, 0, False, None, None, None, None, None, error
        elif error is not None:
            raise p10.Broken(f"{instance}: {error}")

    return records.select("instance_id", "content").mapInArrow(run, kind)


def instances(found: DataFrame) -> DataFrame:
    """One row per instance: transfer syntax, charset, error, number of elements."""
    root = F.col("depth") == 0
    return found.groupBy("instance_id").agg(
        F.max(F.when(root & (F.col("tag_hex") == "00020010"), F.col("text"))).alias("transfer_syntax_uid"),
        F.max(F.when(root & (F.col("tag_hex") == "00080005"), F.col("text"))).alias("charset"),
        F.max("error").alias("error"),
        F.sum(F.col("present").cast("long")).alias("n_elements"),
    )


def probe(records: DataFrame) -> DataFrame:
    """(instance_id, is_record), from the first 1024 bytes."""
    schema = pa.schema([("instance_id", pa.string()), ("is_record", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p10.is_record(h or b"") for h in batch.column(1).to_pylist()], pa.bool_())], schema=schema)

    return records.select("instance_id", F.substring("content", 1, 1024).alias("head")).mapInArrow(run, "instance_id string, is_record boolean")


def series(found: DataFrame) -> DataFrame:
    """(series_uid, n_instances, instances in order); files without a series have a null key."""
    uid = F.max(F.when((F.col("depth") == 0) & (F.col("tag_hex") == "0020000E"), F.col("text"))).alias("series_uid")
    return found.groupBy("instance_id").agg(uid).groupBy("series_uid").agg(F.count("*").alias("n_instances"), F.sort_array(F.collect_list("instance_id")).alias("instances"))


def to_utf8(records: DataFrame) -> DataFrame:
    """(instance_id, content, error): records with all text at every depth in UTF-8, and their charset elements saying so; text that its charset can't decode is an error."""
    schema = pa.schema([("instance_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (made(*row) for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))

    def made(instance: str, content: bytes | None) -> tuple:
        try:
            return instance, utf8_of(content or b""), None
        except (p10.Broken, ValueError, struct.error) as e:
            return instance, None, str(e)

    return records.select("instance_id", "content").mapInArrow(run, "instance_id string, content binary, error string")


def utf8_of(content: bytes) -> bytes:
    parser = p10.Parser(content)
    found = list(parser.elements())
    if parser.error or not found:
        raise p10.Broken(parser.error or "no elements")
    for e in found:
        if e.vr in CHARSET_VRS and e.raw:
            text = charset.decode(e.raw, e.charset, delimiters=b"\\^=" if e.vr == "PN" else b"\\")
            if text is None:
                raise p10.Broken(f"{e.path} is not in {e.charset or 'the default charset'}")
            e.raw = text.encode()
    kept = [e for e in found if e.tag != 0x00080005 and e.tag >> 16 != 2]
    return p10.write([*p10.nested(kept), (0x00080005, "CS", "ISO_IR 192")], parser.syntax)


def summaries(records: DataFrame) -> DataFrame:
    """(instance_id, size, error, n_elements) of each record: it is parsed where it is, and no element leaves the worker."""
    schema = pa.schema([("instance_id", pa.string()), ("size", pa.int64()), ("error", pa.string()), ("n_elements", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (one(instance, content.as_py()) for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1))))

    def one(instance: str, content: bytes | None) -> tuple:
        parser = p10.Parser(content or b"")
        n = sum(1 for _ in parser.elements())
        return instance, None if content is None else len(content), parser.error if content else "no content", n

    return records.select("instance_id", "content").mapInArrow(run, "instance_id string, size bigint, error string, n_elements bigint")


def walk(records: DataFrame) -> DataFrame:
    """One row by folder of instance_id: n_files, n_records, n_broken, n_elements, bytes. What a read of a whole tree finds, in one pass and with one small shuffle by folder."""
    folder = F.when(F.col("instance_id").contains("/"), F.regexp_replace("instance_id", "/[^/]*$", "")).otherwise("").alias("folder")
    return summaries(records).groupBy(folder).agg(
        F.count("*").alias("n_files"), F.sum((F.col("error").isNull() & (F.col("n_elements") > 0)).cast("long")).alias("n_records"), F.sum(F.col("error").isNotNull().cast("long")).alias("n_broken"),
        F.coalesce(F.sum("n_elements"), F.lit(0)).alias("n_elements"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )
