"""Corpus-wide line dedup with a once-seen and a twice-seen Bloom filter.

Each task reduces its lines' keys to distinct 64-bit hashes, a third of which may be one hot line, and deals them to segments of
the hash range. A segment's owner puts every hash into its once-seen filter, or, if it is there already, into its
twice-seen filter, and returns only the latter. In a second pass over the documents only keys that the twice-seen filters hold are counted, exactly, by the key's own text, and
give their first-choice document. Filters of at most `bound` bytes go to every worker, so that nothing else is shuffled; larger ones stay with their segments' owners, to which
the keys are dealt. Confirmed keys are broadcast only within `bound` bytes; otherwise the lines to drop are joined to the documents by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .graph import joined_by_key
from .hashing import mix64
from .textbuf import NULL_ID, carried, id_array, narrow, numbered, record, steps, stored, with_carried

MIN_CHARS, MIN_DOCS = 20, 3
#: Bytes of filters, and of confirmed keys, that are broadcast at most.
BOUND = 64 << 20
PROBES, BITS = 4, 16
#: Hashes that a task holds before it sends them on, and owners of a segment whose filter isn't broadcast.
HELD, OWNERS = 4 << 20, 8
SPACE = b" \t\n\v\f\r"


def line_keys(raw: bytes, min_chars: int = MIN_CHARS) -> list[tuple[bytes, bytes | None]]:
    """Each line and its key, or None for a key below min_chars code points."""
    out = []
    for line in raw.split(b"\n"):
        key = line.strip(SPACE).lower()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append((line, None))
        else:
            out.append((line, key))
    return out


def _distinct(raws: list[bytes], min_chars: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct keys of each text, with the text's number and a 64-bit hash."""
    sets = [{k for _, k in line_keys(raw, min_chars) if k} for raw in raws]
    keys = [k for s in sets for k in s]
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), keys, np.fromiter(map(xxh64_intdigest, keys), np.uint64, len(keys))


class Bloom:
    """A filter for at most n hashes, or one made from its bytes."""

    def __init__(self, n: int = 0, data: bytes | None = None):
        self.bits = np.frombuffer(data, np.uint8) if data is not None else np.zeros(max(8, 1 << max(0, BITS * n // 8 - 1).bit_length()), np.uint8)

    def _places(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(8 * len(self.bits) - 1)
        return np.stack([mix64(h, k) & mask for k in range(PROBES)]).astype(np.int64)

    def __contains__(self, h) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        p = self._places(h)
        return ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)

    def add(self, h: np.ndarray) -> None:
        p = self._places(h).ravel()
        np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (mix64(h, 99) % np.uint64(segments)).astype(np.int64)


def twice_seen(docs: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, bits): a Bloom filter of the hashes that at least two documents hold, and few others."""
    schema = pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("often", pa.binary())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            own = _segment(h, segments)
            order = np.argsort(own, kind="stable")
            cut = np.searchsorted(own[order], np.arange(segments + 1))
            parts = [(i, order[cut[i] : cut[i + 1]]) for i in np.flatnonzero(np.diff(cut)).tolist()]
            return record(schema, [i for i, _ in parts], [h[at].tobytes() for _, at in parts], [(n[at] > 1).tobytes() for _, at in parts])

        for _, texts in steps(batches, limit=8 << 20):
            seen.append(_distinct([texts.raw(i) for i in range(len(texts))], min_chars)[2])
            if sum(map(len, seen)) > HELD:
                yield flush()
        if seen:
            yield flush()

    def owner(table: pa.Table) -> pa.Table:
        sets = [(np.frombuffer(a, np.uint64), np.frombuffer(b, bool)) for a, b in zip(table["once"].to_pylist(), table["often"].to_pylist())]
        once, again = Bloom(sum(len(h) for h, _ in sets)), []
        for h, often in sets:
            known = once.has(h)
            once.add(h[~known])
            again.append(h[known | often])
        found = np.unique(np.concatenate(again))
        twice = Bloom(len(found))
        twice.add(found)
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([twice.bits.tobytes()], pa.binary())})

    return narrow(docs).mapInArrow(local, "segment long, once binary, often binary").groupBy("segment").applyInArrow(owner, "segment long, bits binary")


SUSPECT = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])


def suspects(docs: DataFrame, filters: dict[int, bytes], segments: int, min_chars: int) -> DataFrame:
    """(key, doc_id): each document's distinct keys that the twice-seen filters, which every worker has, hold."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = {s: Bloom(data=b) for s, b in sent.value.items()}
        for batch, texts in steps(batches, limit=8 << 20):
            of, keys, h = _distinct([texts.raw(i) for i in range(len(texts))], min_chars)
            own, keep = _segment(h, segments), np.zeros(len(h), bool)
            order = np.argsort(own, kind="stable")
            cut = np.searchsorted(own[order], np.arange(segments + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[s] : cut[s + 1]]
                keep[at] = blooms[s].has(h[at])
            keep = np.flatnonzero(keep)
            yield record(SUSPECT, pa.array([keys[i] for i in keep.tolist()], pa.binary()), id_array(batch.column(0))[of[keep]])

    return narrow(docs).mapInArrow(run, "key binary, doc_id long")


def dealt_suspects(docs: DataFrame, filters: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """The same rows with filters that are too large for every worker: hashes go to their segment's owners, which hold that segment's filter alone, and only what it holds goes on.

    A segment has several owners, to which documents are dealt by doc_id, so that a hot line's documents don't meet in one task.
    """
    schema = pa.schema([("segment", pa.int64()), ("part", pa.int64()), ("bits", pa.binary()), ("hash", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64())])
    ddl = "segment long, part long, bits binary, hash long, key binary, doc_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, limit=8 << 20):
            of, keys, h = _distinct([texts.raw(i) for i in range(len(texts))], min_chars)
            doc = id_array(batch.column(0))[of]
            yield record(schema, _segment(h, segments), doc % OWNERS, pa.nulls(len(h), pa.binary()), h.view(np.int64), pa.array(keys, pa.binary()), doc)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bloom = None, None
        for batch in batches:
            segment, part, h = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            opens = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            keep = np.zeros(len(h), bool)
            cuts = np.unique(np.concatenate([[0, len(h)], np.flatnonzero(opens)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if opens[a]:
                    place, bloom = (segment[a], part[a]), Bloom(data=batch.column(2)[a].as_py())
                inside = np.flatnonzero(~opens[a:b] & (segment[a:b] == place[0]) & (part[a:b] == place[1])) + a if place else []
                if len(inside):
                    keep[inside] = bloom.has(h[inside].view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5)], schema=SUSPECT).filter(pa.array(keep))

    owners = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OWNERS - 1).cast("long")))
    opening = filters.select("segment", owners.alias("part"), "bits", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    rows = narrow(docs).mapInArrow(run, ddl).unionByName(opening)
    return rows.repartition("segment", "part").sortWithinPartitions("segment", "part", F.col("bits").isNull()).mapInArrow(held, "key binary, doc_id long")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bound: int = BOUND, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, keep): keys in at least min_docs documents, and the largest doc_id among these; and the suspected repeats (key, doc_id) that were counted."""
    segments = segments or min(65_536, max(64, 4 * docs.rdd.getNumPartitions()))
    found = stored(twice_seen(docs, segments, min_chars))
    size = found.agg(F.sum(F.length("bits"))).first()[0] or 0
    small = size <= bound
    each = suspects(docs, {r["segment"]: bytes(r["bits"]) for r in found.toLocalIterator()}, segments, min_chars) if small else dealt_suspects(docs, found, segments, min_chars)
    each = each.distinct() if small else stored(each.distinct())  # a doc_id's repeated rows are one document
    lines = each.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= min_docs)
    return lines, each


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bound: int = BOUND, segments: int | None = None, carry: list[str] = (), prefix: str = "") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (the kept lines, joined by a newline).

    A line's key is the line stripped of ASCII white space and A-Z lower-cased. Keys of at least min_chars code points in at least min_docs documents lose
    all their lines except in the largest doc_id holding them. Null and empty texts are one empty line. Rows that share a doc_id count as one document and all
    keep their lines if it is the largest; null doc_ids together count as one document, the smallest. Texts are read whole, however long. Columns named in carry
    follow under their own names, whatever these are, others are ignored; prefix goes before n_lines and n_dropped, for tables with such columns of their own; an empty table gives an empty result.
    """
    lines, each = repeated_lines(docs, min_chars, min_docs, bound, segments)
    lines = stored(lines)
    names = [f"{prefix}n_lines", f"{prefix}n_dropped"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("text", pa.string())])
    result = with_carried([("doc_id", "long"), *((n, "long") for n in names), ("text", "string")], docs, carry)

    def cut(batch: pa.RecordBatch, texts, drops) -> pa.RecordBatch:
        total, dropped, kept = [], [], []
        for i, doc in enumerate(id_array(batch.column(0)).tolist()):
            lines = line_keys(texts.raw(i), min_chars)
            stay = [line for line, key in lines if key is None or not drops(i, doc, key)]
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return record(schema, batch.column(0), total, dropped, pa.array(kept, pa.binary()).cast(pa.string()))

    if (lines.agg(F.sum(F.length("key") + 64)).first()[0] or 0) <= bound:
        sent = docs.sparkSession.sparkContext.broadcast(lines.select("key", "keep").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = dict(zip(sent.value["key"].to_pylist(), sent.value["keep"].to_pylist()))
            for batch, texts in steps(batches, 1, 8 << 20):
                yield carried(cut(batch, texts, lambda i, doc, key: keep.get(key, doc) != doc), batch, 2)

        return numbered(docs, ["doc_id", "text", *carry]).mapInArrow(run, result)

    drops = joined_by_key(each, lines, "key").filter("doc_id != keep").groupBy("doc_id").agg(F.collect_set("key").alias("drops"))  # at most a document's own lines
    alone = numbered(docs, ["doc_id", "text", *carry])
    joined = alone.join(drops, F.coalesce(alone["c0"], F.lit(NULL_ID)) == drops["doc_id"], "left").select(alone["c0"], alone["c1"], drops["drops"], *(alone[f"c{k + 2}"] for k in range(len(carry))))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1, 8 << 20):
            sets = [set(x or ()) for x in batch.column(2).to_pylist()]
            yield carried(cut(batch, texts, lambda i, doc, key: key in sets[i]), batch, 3)

    return joined.mapInArrow(run_joined, result)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT row_no, doc_id, i, l[i] AS line,
    translate(trim(l[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_no, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
    (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep IS NOT NULL AND keep <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (key) GROUP BY row_no, doc_id
"""
