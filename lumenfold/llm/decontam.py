"""Benchmark decontamination by the q-gram lemma.

A passage within e edits of an item of n bytes shares at least n + 1 - q - q * e of its q-grams, and their diagonals (place in the text less place in the
item) lie within e of each other. Diagonals are dealt to bands of e + 1; two neighbouring bands together then hold all of
them. Shared q-grams are counted by item and band over whole texts, overlapping pairs of bands that reach the bound are kept, and a
banded alignment of each kept region decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import narrow, numbered, others, quoted, record, steps, texts_of, with_carried
from .words import Words, words_of

#: Bytes of q-grams, tried in this order: the longest that the lemma allows an item.
GRAMS, EDIT_RATE = (8, 5), 0.1
#: Bytes of benchmark text that are indexed at once, and such blocks that one scan is held against; a benchmark beyond both takes further scans.
BOUND, BLOCKS = 4 << 20, 64
#: Bytes of text that wait for each of several blocks, and shared q-grams that are expanded at once.
WAITING, EXPANDED = 64 << 20, 1 << 20


def edit_budget(n: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of n bytes."""
    return int(rate * n + 1e-9)


def gram(n: int, rate: float = EDIT_RATE) -> int:
    """Bytes of the q-grams for an item of n bytes: the longest of `GRAMS` that leave the lemma a bound of 1 at least; 0 if there is none, for items that are searched for as they are."""
    return next((q for q in GRAMS if n + 1 - q * (edit_budget(n, rate) + 1) >= 1), 0)


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits of the whole item against a passage of text, and that passage's end, with diagonals of low to high only; most + 1 if there are more."""
    width = high - low + 1
    far = most + 1
    steps_ = np.arange(width)
    at = low + steps_  # text place at which row i's cells begin: at + i
    row = np.where((at >= 0) & (at <= len(text)), 0, far).astype(np.int64)
    padded = np.concatenate([np.zeros(max(0, -low) + 1, np.int16) - 1, text.astype(np.int16), np.zeros(max(0, high + len(item) - len(text)) + 1, np.int16) - 1])
    shift = max(0, -low) + 1
    for i, byte in enumerate(item.tolist()):
        place = low + i + shift
        cell = row + (padded[place : place + width] != byte)
        cell[:-1] = np.minimum(cell[:-1], row[1:] + 1)
        cell = np.minimum.accumulate(cell - steps_) + steps_
        end = at + i + 1
        row = np.where((end >= 0) & (end <= len(text)), np.minimum(cell, far), far)
        if row.min() > most:
            return far, 0
    best = int(row.argmin())
    return int(row[best]), int(low + best + len(item))


def normalised(texts: list[bytes]) -> list[np.ndarray]:
    """Each text with A-Z lower-cased and one space between words."""
    w = words_of(texts_of(pa.array(texts, pa.binary()).cast(pa.string())))
    stop = np.flatnonzero(w.buf == 10)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    return [w.buf[a:b] for a, b in zip(start.tolist(), stop.tolist())]


class Index:
    """The q-grams of items, by code: which items have them, and where."""

    def __init__(self, item_ids: list, items: list[np.ndarray], rate: float, q: int):
        self.q, self.mask = q, np.uint64((1 << 8 * q) - 1)
        keep = list(zip(item_ids, items))
        self.ids, self.items = [i for i, _ in keep], [x for _, x in keep]
        self.n = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.array([edit_budget(len(x), rate) for x in self.items], np.int64)
        self.bound = self.n + 1 - q - q * self.edits
        codes = [self._codes(x) for x in self.items]
        code = np.concatenate(codes)
        owner, place = np.repeat(np.arange(len(codes)), [len(c) for c in codes]), np.concatenate([np.arange(len(c)) for c in codes])
        order = np.argsort(code, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.concatenate([first, [len(code)]])
        self.map = np.zeros(1 << 22, bool)
        self.map[self._slot(self.codes)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).view(np.int64)

    def _codes(self, buf: np.ndarray) -> np.ndarray:
        """Every q-gram as a number."""
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        return np.ndarray((len(buf) - self.q + 1,), "<u8", padded, 0, (1,)) & self.mask

    def _counted(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams by item and band, as keys in order and counts; q-grams are expanded some at a time, however often an item has them."""
        found = []
        for a in range(0, len(buf) - self.q + 1, 1 << 16):
            code = self._codes(buf[a : a + (1 << 16) + self.q - 1])
            at = np.flatnonzero(self.map[self._slot(code)])
            g = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            same = self.codes[g] == code[at]
            found.append(np.stack([at[same] + a, g[same]]))
        p, g = np.concatenate(found, axis=1)
        many = self.first[g + 1] - self.first[g]
        total = np.concatenate([[0], np.cumsum(many)])
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift, at = int(self.n.max()), 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(total, total[at] + EXPANDED, "right")) - 1)
            m = many[at:to]
            k = np.repeat(self.first[g[at:to]] - (total[at:to] - total[at]), m) + np.arange(total[to] - total[at])
            item = self.owner[k]
            new, n = np.unique(item << 40 | (np.repeat(p[at:to], m) - self.place[k] + shift) // (self.edits[item] + 1), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            at = to
        return keys, counts

    def search(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): each item's best passage in each text that has one; places in normalised bytes."""
        if len(w.buf) < self.q:
            return []
        keys, count = self._counted(w.buf)
        if not len(keys):
            return []
        shift = int(self.n.max())
        after = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        pair = count + np.where(keys[after] == keys + 1, count[after], 0)
        kept = keys[pair >= self.bound[keys >> 40]]  # a pair whose lower band is empty counts no more than the next pair
        stop = np.flatnonzero(w.buf == 10)
        begin = np.concatenate([[0], stop[:-1] + 1])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in kept.tolist():
            i, band = k >> 40, k & ((1 << 40) - 1)
            e, n = int(self.edits[i]), int(self.n[i])
            low, high = band * (e + 1) - shift, (band + 2) * (e + 1) - 1 - shift
            for t in range(int(np.searchsorted(stop, max(0, low))), min(len(stop), int(np.searchsorted(stop, high + n)) + 1)):
                a, b = int(begin[t]), int(stop[t])
                if best.get((t, i), (e + 1,))[0] == 0 or b - a < n - e:
                    continue
                lo, hi = max(a, low - e), min(b, high + n + e)
                if hi <= lo:
                    continue
                region = w.buf[lo:hi]
                edits, end = banded_edits(self.items[i], region, low - e - lo, high + e - lo, e)
                if edits <= e and edits < best.get((t, i), (e + 1,))[0]:
                    best[t, i] = edits, max(0, lo + end - n - a), lo + end - a
        return [(t, i, *v) for (t, i), v in best.items()]


class Searcher:
    """All items of a block: those that the lemma bounds by their q-grams, shorter ones as whole words by an automaton."""

    def __init__(self, item_ids: list, texts: list[bytes], rate: float):
        items = [(i, x) for i, x in zip(item_ids, normalised(texts)) if len(x)]
        self.indexes, self.n, self.ids, self.first = [], [], [], []
        for q in GRAMS:
            own = [(i, x) for i, x in items if gram(len(x), rate) == q]
            if own:
                self.first.append(len(self.ids))
                self.indexes.append(Index([i for i, _ in own], [x for _, x in own], rate, q))
                self.ids += [i for i, _ in own]
                self.n += [len(x) for _, x in own]
        short = [(i, x) for i, x in items if not gram(len(x), rate)]
        self.automaton = None
        if short:
            import ahocorasick

            self.automaton, same = ahocorasick.Automaton(), {}
            for i, x in short:
                same.setdefault(x.tobytes().decode("utf-8", "replace"), []).append(len(self.ids))
                self.ids.append(i)
                self.n.append(len(x))
            for word, numbers in same.items():
                self.automaton.add_word(f" {word} ", (word, numbers))
            self.automaton.make_automaton()

    def search(self, texts) -> list[tuple[int, int, int, int, int]]:
        w = words_of(texts)
        out = [(t, first + i, *rest) for first, index in zip(self.first, self.indexes) for t, i, *rest in index.search(w)]
        if self.automaton is not None:
            for t, line in enumerate(w.buf.tobytes().split(b"\n")[:-1]):
                seen, text = set(), f" {line.decode('utf-8', 'replace')} "
                for end, (word, numbers) in self.automaton.iter(text):
                    if word not in seen:
                        seen.add(word)
                        start = len(text[1 : end - len(word)].encode())
                        out += [(t, k, 0, start, start + self.n[k]) for k in numbers]
        return out


def _blocks(benchmark: DataFrame, bound: int) -> Iterator[tuple[list, list[bytes]]]:
    """The benchmark's items in blocks of at most `bound` bytes, or of one item."""
    ids, texts, size = [], [], 0
    for r in benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        raw = r["text"].encode("utf-8", "replace")
        if ids and size + len(raw) > bound:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(raw)
        size += len(raw)
    if ids:
        yield ids, texts


def _passes(benchmark: DataFrame, bound: int) -> Iterator[list[tuple[list, list[bytes]]]]:
    """Blocks that one scan of the documents is held against."""
    held = []
    for block in _blocks(benchmark, bound):
        held.append(block)
        if len(held) == BLOCKS:
            yield held
            held = []
    if held:
        yield held


_BUILT: dict[tuple, Searcher] = {}


def _searcher(sent, k: int, rate: float) -> Searcher:
    """The k-th block's; a worker keeps the last one, so that a benchmark of one block is indexed once."""
    key = (sent.id if hasattr(sent, "id") else id(sent), k, rate)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searcher(*sent.value[k], rate)
    return _BUILT[key]


def _searched(batches: Iterator[pa.RecordBatch], sent, rate: float) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Steps of the batches with what every block finds in them: (text, item id, bytes, edits, start, end). With several blocks, as many bytes of text as are worth building an index wait for each."""
    blocks, held, size = len(sent.value), [], 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for k in range(blocks):
            own = _searcher(sent, k, rate)
            for rows, (_, texts) in zip(found, held):
                rows += [(t, own.ids[i], own.n[i], *rest) for t, i, *rest in own.search(texts)]
        yield from ((batch, rows) for (batch, _), rows in zip(held, found))

    for step in steps(batches, 1):
        held.append(step)
        size += len(step[1].buf)
        if blocks == 1 or size >= WAITING:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, bound: int = BOUND) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, item_bytes, similarity, start, end.

    Texts are compared with A-Z lower-cased and white space as single spaces. An item is found where a passage is within rate * n edits, rounded down, of all of its n bytes; items that are too short for
    q-grams, under 5 bytes at this rate, are found as whole words. start and end are places in the
    normalised text; the best passage counts. Null and empty texts contain nothing, null and empty items are nowhere; texts are read whole, however long; repeated rows give repeated rows; null ids stay null; empty tables give an empty result;
    other columns, whatever their names, are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_bytes", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    ddl = "doc_id long, item_id long, edits long, item_bytes long, similarity double, start long, end long"
    out = None
    for blocks in _passes(benchmark, bound):
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, found in _searched(batches, sent, rate):
                doc = batch.column(0).to_pylist()
                yield record(schema, *zip(*((doc[t], i, e, n, 1 - e / n, start, end) for t, i, n, e, start, end in found))) if found else record(schema, *([],) * 7)

        part = narrow(docs).mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, bound: int = BOUND) -> DataFrame:
    """`docs` without the documents in which an item is found; all columns stay, whatever their names."""
    carry, columns = others(docs), docs.columns
    for blocks in _passes(benchmark, bound):
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, found in _searched(batches, sent, rate):
                stay = np.ones(batch.num_rows, bool)
                stay[[t for t, *_ in found]] = False
                yield pa.RecordBatch.from_arrays(batch.columns, names=["doc_id", "text", *carry]).filter(pa.array(stay))

        docs = numbered(docs, ["doc_id", "text", *carry]).mapInArrow(run, with_carried([("doc_id", "long"), ("text", "string")], docs, carry)).select(*map(quoted, columns))
    return docs
