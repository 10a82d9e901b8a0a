"""SimHash near-duplicates found with pivot distance tables.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints collapse to one node.
Distances to pivots concentrate (32, deviation 4), so they can't spread nodes over a cluster alone: nodes are routed by
pairs of six fingerprint blocks instead, of which any two nodes within four bits share at least one. Within a bucket the
pivot distance table works: a pair whose distances to any of 32 pivots, random fingerprints and members far apart, differ by more than the radius is discarded by the
triangle inequality, and the survivors are verified. Buckets above a size are split into pairs of salted halves,
so no task holds an unbounded bucket, and each bucket gives a spanning forest of its links, not all its pairs.
`near_groups` does the same for a similarity: fingerprints of several lanes are routed by samples of their bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, joined_by_key
from .hashing import mix64, xxh64_spans
from .textbuf import narrow, record, steps, stored
from .words import shingles, words_of

WIDTH, RADIUS, SEED = 4, 4, 42
#: Bits of the six blocks; two of six are equal if at most four bits differ.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Nodes of a bucket that one task compares; larger buckets are split.
BUCKET = 4096
#: Pivots of a bucket: random ones and members of it; buckets of at most SMALL nodes have no table.
RANDOM_PIVOTS, MEMBER_PIVOTS, SMALL = 8, 24, 8
#: Near copies by shingles of five words: least similarity, 64-bit lanes of a fingerprint, share of the pairs at that similarity that meet in a bucket.
NEAR_WIDTH, SIMILARITY, LANES, RECALL = 5, 0.8, 4, 0.97


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits by text: bytes of eight counters are summed at once over at most 255 shingles."""
    n = np.diff(first)
    parts = -(-n // 255)
    head = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(np.arange(len(n)), parts)
    cut = first[of] + 255 * (np.arange(head[-1]) - head[of])
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    ones, half = np.uint64(0x0101010101010101), n[some] // 2
    for k in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(k)) & ones, cut).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counts.astype(np.int32), head[some], axis=0)
        bits = (total > half[:, None]).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))
        out[some] |= np.bitwise_or.reduce(bits, axis=1)
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, lanes: int = 0) -> DataFrame:
    """(doc_id, fp): one row per document; null and wordless texts have fingerprint 0. With lanes, fp is binary: the first lane as without, each other one of scrambled hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary() if lanes else pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            w = words_of(texts)
            a, b, first = shingles(w, width)
            h = xxh64_spans(w.buf, w.start[a], w.end[b], SEED)
            if not lanes:
                yield record(schema, batch.column(0), _fingerprints(h, first).view(np.int64))
                continue
            every = np.stack([_fingerprints(mix64(h, 50 + k) if k else h, first) for k in range(lanes)], axis=1)
            yield record(schema, batch.column(0), pa.array([row.tobytes() for row in every], pa.binary()))

    return narrow(docs).mapInArrow(run, f"doc_id long, fp {'binary' if lanes else 'long'}")


def _keys(fp: Column) -> list[Column]:
    at = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for a, w in zip(at, BLOCKS)]
    return [F.lit(t << 48).cast("long").bitwiseOR(F.shiftleft(block[i], 24)).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]


def _distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, rows of 64-bit lanes, to every pivot."""
    return np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def _pivots(fp: np.ndarray) -> np.ndarray:
    """Reference fingerprints of one bucket: fixed random ones, and members far apart from each other, in whose clusters coordinates differ most."""
    lanes = fp.shape[1]
    out = [mix64(np.arange(lanes, dtype=np.uint64) + np.uint64(lanes * k + 1), 11) for k in range(RANDOM_PIVOTS)]
    far = np.full(len(fp), 64 * lanes, np.int64)
    at = 0
    for _ in range(min(MEMBER_PIVOTS, len(fp) // 4)):
        out.append(fp[at])
        far = np.minimum(far, np.bitwise_count(fp ^ fp[at]).sum(axis=1))
        at = int(far.argmax())
    return np.stack(out)


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are links: pivot coordinates discard, the fingerprints decide."""
    keep = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius)
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]).sum(axis=1) <= radius]


def _forest(fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of one bucket's links. Each member is held against the unreached members only, of these against those whose most spread coordinate is near."""
    wide = int(table.std(axis=0).argmax())
    left = np.argsort(table[:, wide], kind="stable")
    heads, tails = [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            group = queue.pop()
            for q in group.tolist():
                at = table[left, wide]
                lo, hi = np.searchsorted(at, table[q, wide] - radius), np.searchsorted(at, table[q, wide] + radius, "right")
                near = left[lo:hi]
                found = lo + _near(fp, table, np.full(len(near), q), near, radius)
                if len(found):
                    new = left[found]
                    heads.append(np.full(len(new), q))
                    tails.append(new)
                    queue.append(new)
                    left = np.delete(left, found)
                if not len(left):
                    break
    return heads, tails


def links_within(key: np.ndarray, part: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets; equal (key, part) stand together. Small buckets compare all members, larger ones by their pivot table."""
    n = len(key)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    size = np.diff(np.concatenate([new, [n]]))
    if not (size > 1).any():
        return node[:0], node[:0]
    group, small = np.repeat(np.arange(len(new)), size), np.repeat(size <= SMALL, size)
    heads, tails = [], []
    for o in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero(small[:-o] & (group[:-o] == group[o:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + o]).sum(axis=1) <= radius]
        heads.append(i)
        tails.append(i + o)
    for a, z in zip(new[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = fp[a : a + z]
        h, t = _forest(own, _distances(own, _pivots(own)), radius)
        heads += [x + a for x in h]
        tails += [x + a for x in t]
    h, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heads, tails))
    return node[h], node[t]


def _lanes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit lanes."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def dealt_links(keyed: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(a, b) of rows (key, fp, node): enough links within the radius between rows of one key to reach all that are. Keys of more than `bucket` rows are split into pairs of salted halves."""
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key", F.ceil(F.col("n") / bucket).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts").cast("long"))
    split = keyed.join(hot, "key", "left")
    other = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1)))
    split = split.select("node", "fp", "key", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    part = F.shiftleft(F.least("own", "other").cast("long"), 31).bitwiseOR(F.greatest("own", "other").cast("long"))
    dealt = split.select("key", part.alias("part"), "fp", "node").repartition("key", "part").sortWithinPartitions("key", "part")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [_lanes(c) if k == 2 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            kept = [x[cut:] for x in now]
            if cut:
                k, p, f, v = (x[:cut] for x in now)
                yield record(schema, *links_within(k, p, f, v, radius))
        if kept is not None:
            k, p, f, v = kept
            yield record(schema, *links_within(k, p, f, v, radius))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of nodes (node, fp) whose fingerprints are within the radius: enough links to reach all that are."""
    if radius > 4:
        raise ValueError("six blocks find pairs within four bits")
    return dealt_links(nodes.select("node", "fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key")), radius, bucket)


def sampled_links(nodes: DataFrame, lanes: int, similarity: float, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of nodes (node, fp) whose wide fingerprints are as near as those of texts of that similarity are on average.

    Keys are samples of a fingerprint's bits: as many bits as leave some dozens of unlike nodes in a bucket of a table of this size, and as many samples as
    bring a pair of that distance together with a probability of `recall`. Both grow with the table.
    """
    differ = share_of_bits(similarity)
    width = int(np.clip(math.log2(max(2, nodes.count()) / 32), 8, 40))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** width))
    rng = np.random.default_rng(5)
    chosen = np.stack([rng.choice(64 * lanes, width, replace=False) for _ in range(tables)])
    schema = pa.schema([("key", pa.int64()), ("fp", pa.binary()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                part = batch.slice(first, 8192)
                bits = np.unpackbits(_lanes(part.column(1)).view(np.uint8), axis=1, bitorder="little")
                for t, at in enumerate(chosen):
                    key = bits[:, at].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) | t << 42
                    yield record(schema, key, part.column(1), part.column(0))

    return dealt_links(nodes.select("node", "fp").mapInArrow(run, "key long, fp binary, node long"), round(64 * lanes * differ), bucket)


def share_of_bits(similarity: float) -> float:
    """Share of fingerprint bits in which sets of that Jaccard similarity, equal in size, differ on average: their angle over a half turn."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = NEAR_WIDTH, lanes: int = LANES, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp (binary, of `lanes` 64-bit fingerprints), component_id: the smallest doc_id reachable by links.

    Two documents are linked if their fingerprints of `width`-word shingles differ in at most as many bits as texts of Jaccard similarity `similarity` do on average. The estimate's
    deviation is about 0.05 at 256 bits: pairs well above the similarity are found, pairs well below are not, those at it by half. Nulls, empty tables, repeated rows and other
    columns are as in `simhash_groups`.
    """
    fps = stored(fingerprints(docs, width, lanes))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).filter(F.col("node").isNotNull()))
    return _named(fps, nodes, components(sampled_links(nodes, lanes, similarity, bucket=bucket)))


def _named(fps: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fps with the root of their fingerprint's node. A fingerprint that many documents have is joined by broadcast."""
    named = nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    return joined_by_key(fps, stored(named), "fp", "left").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable by links. Null and empty texts have fingerprint 0 and link like any other; texts
    below `width` words are one shingle; repeated rows give repeated rows. Null doc_ids count as no id: their rows get their
    component's smallest id, or null if it has none. Texts are read whole, however long. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, width))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).filter(F.col("node").isNotNull()))
    return _named(fps, nodes, components(links(nodes, radius, bucket)))


def one_of_each(docs: DataFrame, groups: Callable[..., DataFrame] = simhash_groups, **options) -> DataFrame:
    """`docs` without the documents that aren't the smallest doc_id of their group; rows without doc_id stay, as do all columns, whatever their names."""
    gone = groups(docs, **options).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
