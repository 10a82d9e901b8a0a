"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own bytes and words and of its neighbours; the field labels it good or bad. Forward-backward gives each
line's marginal of being good; their mean, weighted by line length, goes through a fitted logistic curve and is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import prefix_sums, span_hash
from .textbuf import Texts, held_out, record, steps, texts_of
from .training import sample

#: Rows fitted per label at most, bins of a feature, and steps of fitting.
PER_LABEL, BINS, FIT_STEPS = 800, 6, 60
PENALTY = 1e-3

_CLASS = np.full(256, 8, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\v\f", b".,;:'\"()-?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", range(128, 256))):
    _CLASS[list(_bytes)] = _k
CLASSES = 9
WORD_BLOCK = 64
#: Features of a line; the neighbours' first NEAR of them are its features too.
FEATURES, NEAR = 19, 13


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each line of each text, lengths in bytes, and each text's first line. Empty texts have one empty line."""
    n = len(texts)
    buf = np.insert(texts.buf, texts.off[1:], 10)
    stop = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    last = texts.off[1:] + np.arange(n)
    first = np.concatenate([[0], np.searchsorted(stop, last) + 1])
    lines = len(stop)
    size = stop - start
    kind = np.frombuffer(buf.tobytes().translate(_CLASS.tobytes()), np.uint8)
    of = np.repeat(np.arange(lines) << 4, size + 1)
    count = np.bincount(of | kind, minlength=16 * lines).reshape(lines, 16)[:, :CLASSES].astype(np.float64)
    share = count / np.maximum(1, size)[:, None]
    inside = ~((kind == 3) | (buf == 10))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    ws, we = edge[::2], edge[1::2]
    line = of[ws] >> 4 if len(ws) else ws
    sums = prefix_sums(buf)
    h = span_hash(sums, ws, we)
    words = np.bincount(line, minlength=lines)

    def repeats(d: int) -> np.ndarray:
        same = np.flatnonzero((h[d:] == h[:-d]) & (line[d:] == line[:-d])) + d
        return np.bincount(line[same], minlength=lines) / np.maximum(1, words)

    # words that a block of the line has already had, whatever their distance
    at = np.arange(len(h)) - np.concatenate([[0], np.cumsum(words)])[line] if len(h) else np.zeros(0, np.int64)
    key = h ^ (line.astype(np.uint64) << np.uint64(32)) ^ (at // WORD_BLOCK).astype(np.uint64)
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=lines) / np.maximum(1, words) if len(h) else np.zeros(lines)
    whole = span_hash(sums, start, stop)
    same_line = np.concatenate([[False], whole[1:] == whole[:-1]]) & (size > 0)
    text = np.repeat(np.arange(n), np.diff(first))
    head = np.where(size > 0, kind[start], 15)
    tail = np.where(size > 0, kind[np.maximum(stop - 1, 0)], 15)
    x = np.stack([np.log1p(size), share[:, 1] / np.maximum(1e-9, share[:, 0] + share[:, 1] + share[:, 8]), share[:, 2], share[:, 4], share[:, 5], share[:, 6], share[:, 7], repeats(1), distinct, size / np.maximum(1, words), same_line, tail == 4, head == 1,
                  share[:, 8], share[:, 3], repeats(2), np.log1p(words), np.log1p(np.diff(first))[text], (np.arange(lines) - first[text] + 1) / np.diff(first)[text]], axis=1)
    return x, size, first


def _indices(x: np.ndarray, first: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Columns of the binned features that hold for each line: its own, then those of the lines before and after it."""
    bins = np.stack([np.searchsorted(cuts[k], x[:, k], "right") for k in range(FEATURES)], axis=1)
    edge = len(cuts[0]) + 1
    before, after = np.full((len(x), NEAR), edge), np.full((len(x), NEAR), edge)
    before[1:], after[:-1] = bins[:-1, :NEAR], bins[1:, :NEAR]
    before[first[:-1]], after[first[1:] - 1] = edge, edge
    return np.concatenate([bins, before, after], axis=1) + np.arange(FEATURES + 2 * NEAR) * (edge + 1)


def _chains(first: np.ndarray) -> Iterator[np.ndarray]:
    """For each place in a text: the lines there, texts with most lines first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    alive = len(order)
    for t in range(int(n.max(initial=0))):
        while n[order[alive - 1]] <= t:
            alive -= 1
        yield first[order[:alive]] + t


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of (line, label) potentials and (label, label) transition potentials: each line's marginals, the expected transitions, log Z."""
    e, m = np.exp(emission - emission.max(axis=1, keepdims=True)), np.exp(move)
    forward, scale = np.empty_like(e), np.empty(len(e))
    steps_ = list(_chains(first))
    for t, at in enumerate(steps_):
        a = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        s = a.sum(axis=1)
        forward[at], scale[at] = a / s[:, None], s
    backward = np.ones_like(e)
    moved = np.zeros((2, 2))
    for t in range(len(steps_) - 1, 0, -1):
        at = steps_[t]
        onward = e[at] * backward[at] / scale[at, None]
        backward[at - 1] = onward @ m.T
        moved += np.einsum("ni,ij,nj->ij", forward[at - 1], m, onward)
    return forward * backward, moved, float(np.log(scale).sum() + emission.max(axis=1).sum())


@dataclass
class Field:
    cuts: np.ndarray
    weights: np.ndarray  # binned feature by label
    move: np.ndarray
    curve: np.ndarray

    def evidence(self, texts: Texts) -> np.ndarray:
        """Length-weighted mean marginal of good lines, by text."""
        x, size, first = line_features(texts)
        m, _, _ = marginals(self.weights[_indices(x, first, self.cuts)].sum(axis=1), first, self.move)
        weight = size + 1.0
        return np.add.reduceat(m[:, 1] * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logit(self.evidence(texts)) @ self.curve, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p))], axis=1)


def fit(texts: list[bytes], labels: list[int], sizes: dict) -> Field | None:
    """Lines take their document's label; the curve then corrects for documents whose lines differ. None without both labels."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    column = texts_of(pa.array(texts, pa.binary()).cast(pa.string()))
    x, size, first = line_features(column)
    cuts = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) + 1e-12 for k in range(FEATURES)])
    index = _indices(x, first, cuts)
    n, width = len(x), (BINS + 1) * (FEATURES + 2 * NEAR)
    label = np.repeat(y, np.diff(first))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    observed = np.stack([np.bincount(index[label == k].ravel(), minlength=width) for k in (0, 1)], axis=1)
    w, move = np.zeros((width, 2)), np.zeros((2, 2))
    first_moment, second = np.zeros(width * 2 + 4), np.zeros(width * 2 + 4)
    for step in range(1, FIT_STEPS + 1):
        m, moved, _ = marginals(w[index].sum(axis=1), first, move)
        expected = np.stack([np.bincount(index.ravel(), np.repeat(m[:, k], index.shape[1]), minlength=width) for k in (0, 1)], axis=1)
        g = np.concatenate([((observed - expected) / n - PENALTY * w).ravel(), ((seen - moved) / n - PENALTY * move).ravel()])
        first_moment = 0.9 * first_moment + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        delta = 0.08 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w += delta[: 2 * width].reshape(width, 2)
        move += delta[2 * width :].reshape(2, 2)
    field = Field(cuts, w, move, np.array([0.0, 1.0]))
    z = _logit(field.evidence(column))
    prior = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    prior /= prior.mean()
    curve = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        s = prior * p * (1 - p) + 1e-9
        curve += np.linalg.solve((z * s[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (prior * (y - p)) - 1e-3 * curve)
    field.curve = curve
    return field


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Fitted on at most per_label rows of each value of labels.quality that aren't held out; without both values all scores are 0.5. Other labels than 0 and 1 are not learned. Texts are read whole, however long. Null and empty texts are one empty line.
    predicted is 1 if score >= 0.3. Null doc_ids aren't held out and stay null; repeated rows give repeated rows; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, "quality", per_label, [0, 1])))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch, texts in steps(batches):
            p = field.scores(texts) if field is not None else np.full(len(texts), 0.5)
            yield record(schema, batch.column(0), batch.column(2), p, (p >= 0.3).astype(np.int32))

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
