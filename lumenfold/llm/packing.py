"""Packing of token sequences by minimum bin slack.

Whole windows of `size` tokens are cut off every document; what remains of it joins a pool of remainders. A sequence
starts with the pool's longest remainder. A bitset holds every sum that the multiset of remaining lengths can reach, built by
dynamic programming from the longest length down; the reachable sum nearest to the free room is taken, and its lengths are found
by tracing the bitsets back. Sequences that come out full leave; others wait for more remainders. What a partition's end
leaves over is cut to full sequences and then to powers of two, so no sequence needs padding. Partitions pack on their own:
nothing is shuffled, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textbuf import narrow, record, steps
from .tokens import tokenizer, vocabulary_path

SIZE = 1024
#: Remainders that wait in a task before sequences are filled from them.
WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def least_slack(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, none oftener than counts has it, whose sum is as near to room as any gets without exceeding it."""
    reach, full = 1, 1 << room
    mask = 2 * full - 1
    trail: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            trail.append((length, reach))
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    target, taken = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> target & 1:
            taken.append(length)
            target -= length
    return taken


class Packer:
    """Remainders by length, first come first gone."""

    def __init__(self, size: int):
        self.size = size
        self.pool: dict[int, deque[Piece]] = {}
        self.counts: dict[int, int] = {}
        self.n = 0

    def add(self, piece: Piece) -> None:
        self.pool.setdefault(len(piece.ids), deque()).append(piece)
        self.counts[len(piece.ids)] = self.counts.get(len(piece.ids), 0) + 1
        self.n += 1

    def _take(self, length: int) -> Piece:
        self.n -= 1
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.pool[length].popleft()

    def fill(self, keep: int) -> Iterator[list[Piece]]:
        """Full sequences, until `keep` remainders or none that fit together are left."""
        waiting: list[Piece] = []
        while self.n > keep:
            head = self._take(max(self.counts))
            lengths = least_slack(self.counts, self.size - len(head.ids))
            if sum(lengths) + len(head.ids) == self.size:
                yield [head, *map(self._take, lengths)]
            else:
                waiting.append(head)
        for piece in waiting:
            self.add(piece)

    def rest(self) -> Iterator[list[Piece]]:
        """The remainders cut to full sequences, the last tokens to powers of two."""
        yield from self.fill(0)
        pieces = [p for length in sorted(self.pool, reverse=True) for p in self.pool[length]]
        left = sum(len(p.ids) for p in pieces)
        cuts = [self.size] * (left // self.size) + [1 << k for k in range(self.size.bit_length(), -1, -1) if left % self.size >> k & 1]
        for want in cuts:
            sequence = []
            while want:
                p = pieces.pop(0)
                if len(p.ids) > want:
                    pieces.insert(0, Piece(p.doc_id, p.start + want, p.ids[want:], p.doc_tokens))
                    p = Piece(p.doc_id, p.start, p.ids[:want], p.doc_tokens)
                sequence.append(p)
                want -= len(p.ids)
            yield sequence


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the library's, then end_id, so null and empty texts have one id. Every id lies in one piece. All sequences
    are full but at most log2(size) a partition, whose lengths are powers of two. Repeated rows are packed as often as they
    occur; a null doc_id stays null; an empty table has no pieces; texts are read whole, however long; other columns, whatever their names, are ignored.
    """
    path = path or vocabulary_path()
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = TaskContext.get().partitionId() << 40, Packer(size)
        rows: list[list] = [[] for _ in schema]
        count = 0

        def put(sequence: list[Piece]) -> None:
            nonlocal count
            at = 0
            for p in sequence:
                for column, value in zip(rows, (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, base + count, at)):
                    column.append(value)
                at += len(p.ids)
            count += 1

        def flush() -> pa.RecordBatch:
            out = record(schema, *rows)
            for column in rows:
                column.clear()
            return out

        for batch, texts in steps(batches):
            ids, off = tokenizer(path).ids(texts)
            ids = np.ascontiguousarray(np.insert(ids, off[1:], end_id), "<u4")
            off = (off + np.arange(len(off))).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), off, off[1:]):
                cut = b - (b - a) % size
                for x in range(a, cut, size):
                    put([Piece(doc, x - a, ids[x : x + size], b - a)])
                if cut < b:
                    packer.add(Piece(doc, cut - a, ids[cut:b].copy(), b - a))
            if packer.n > 2 * window:
                for sequence in packer.fill(window):
                    put(sequence)
            if rows[0]:
                yield flush()
        for sequence in packer.rest():
            put(sequence)
        if rows[0]:
            yield flush()

    return narrow(docs).mapInArrow(run, PIECES)
