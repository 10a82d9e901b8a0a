"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read a clause's word classes. Two say what matches weigh: insults, more in a phrase of them, and threats, in full after a word of intent. Two say what the clause makes of them: negation,
whose effect fades after a few words, and reported speech, which lasts to the clause's end. The first two are joined and composed with the others into one deterministic transducer; a target (somebody addressed or
named) is read from both ends of the clause. A match's weight is that of its transitions times its word's own, and a text's score comes from its matched clauses' weights alone.
Insults and threats are seeded and, with their weights, learned from labelled rows; learned words and stems are insults. A logistic curve over the clause scores gives the probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import prefix_sums, span_hash
from .textbuf import Texts, held_out, record, steps, texts_of
from .training import sample

#: Rows fitted per label at most; least documents that a learned word needs, or a hundredth of the toxic ones; bytes of a learned stem.
PER_LABEL, SUPPORT, STEM = 1500, 3, 6
#: Labelled texts that are read together.
PART = 200

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = CLASSES = range(7)
#: Seed words of the grammar (fixed values), in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown dumb idiota idiotas estúpido dummkopf idiote imbécile",
    THREAT: "kill hurt destroy töten umbringen tuer matar",
    TARGET: "you your yours u he she they him his her their du dich dir ihr euch er sie tu toi te vous il ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never nor n't without nicht kein keine nie ohne pas jamais sans non nunca jamás sin",
    REPORT: "said says say wrote writes called quoted claimed sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó",
    INTENT: "will shall gonna going i'll we'll should must deserve deserves werde werden soll muss vais allons doit voy vamos debe",
}
#: A seed's weight before learning, and the least weight that a learned word, and a learned stem, must have.
SEED_WEIGHT, LEAST_WEIGHT, LEAST_STEM = 2.0, 1.0, 1.5
#: Multipliers: after a negation, in reported speech, with a target in the clause, of an insult right after another, of a threat without a word of intent; and the words after which a negation or an intent is over.
NEGATED, REPORTED, TARGETED, PHRASED, BARE, FADES = 0.3, 0.6, 1.25, 1.2, 0.5, 3
#: Score of a clause above which more counts no further.
MOST = 10.0


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word classes: the next state and the weight of each transition, by (state, class). The first state is 0."""

    to: dict[tuple, int]
    weight: dict[tuple, float]


def _transducer(states: int, to, weight) -> Transducer:
    every = list(product(range(states), CLASSES))
    return Transducer({(s, c): to(s, c) for s, c in every}, {(s, c): weight(s, c) for s, c in every})


def _fading(opens: int, c: int, s: int) -> int:
    return 1 if c == opens else 0 if s == 0 or s >= FADES else s + 1


#: What matches weigh: insults, more in a phrase of them; threats, in full after a word of intent.
INSULTS = _transducer(2, lambda s, c: int(c == INSULT), lambda s, c: (PHRASED if s else 1.0) if c == INSULT else 0.0)
THREATS = _transducer(FADES + 1, lambda s, c: _fading(INTENT, c, s), lambda s, c: (1.0 if s else BARE) if c == THREAT else 0.0)
#: What the clause around makes of a match.
NEGATIONS = _transducer(FADES + 1, lambda s, c: _fading(NEGATION, c, s), lambda s, c: NEGATED if s else 1.0)
REPORTS = _transducer(2, lambda s, c: int(s or c == REPORT), lambda s, c: REPORTED if s else 1.0)
#: Read from both ends: a target may stand before or after the match.
TARGETS = _transducer(2, lambda s, c: int(s or c == TARGET), lambda s, c: float(s))


def union(one: Transducer, two: Transducer) -> Transducer:
    """Both at once; weights are added."""
    return _joined(one, two, lambda a, b: a + b)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """Both at once; weights are multiplied."""
    return _joined(one, two, lambda a, b: a * b)


def _joined(one: Transducer, two: Transducer, weigh) -> Transducer:
    """The product of two, with only the states that can be reached, numbered in order."""
    number, todo, to, weight = {(0, 0): 0}, [(0, 0)], {}, {}
    while todo:
        a, b = todo.pop(0)
        for c in CLASSES:
            then = one.to[a, c], two.to[b, c]
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            to[number[a, b], c] = number[then]
            weight[number[a, b], c] = weigh(one.weight[a, c], two.weight[b, c])
    return Transducer(to, weight)


CLAUSE = compose(compose(union(INSULTS, THREATS), NEGATIONS), REPORTS)


def path_weights(tokens: list[tuple[int, float]], clause: Transducer = CLAUSE) -> list[float]:
    """What each of a clause's (class, weight) tokens adds: its weight times that of the composed transducer's transition, and of the targets' on either side."""
    out, state, before = [], 0, []
    target = 0
    for c, weight in tokens:
        out.append(clause.weight[state, c] * weight)
        before.append(target)
        state, target = clause.to[state, c], TARGETS.to[target, c]
    target = 0
    for k in range(len(tokens) - 1, -1, -1):
        if before[k] or target:
            out[k] *= TARGETED
        target = TARGETS.to[target, tokens[k][0]]
    return out


def clause_score(tokens: list[tuple[int, float]]) -> float:
    return sum(path_weights(tokens))


_KIND = np.zeros(256, np.uint8)  # 1: of a word, 2: ends a clause
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = 1
_KIND[list(b".,;:!?\n()\"")] = 2


@dataclass
class Tokens:
    """Lower-cased words of several texts: hashes of words and of the stems of longer ones, clause and text of each."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    clause: np.ndarray
    word: np.ndarray
    stem: np.ndarray


def tokens_of(texts: Texts) -> Tokens:
    buf = texts.buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    if len(buf) > 1:  # Latin-1 capitals
        upper[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    buf[upper] += 32
    kind = np.frombuffer(buf.tobytes().translate(_KIND.tobytes()), np.uint8)
    inside = kind == 1
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(buf):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = texts.off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    both = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts  # texts that touch in a word
    at = np.flatnonzero(edge)
    at = np.sort(np.concatenate([at, both, both])) if len(both) else at
    start, end = at[::2], at[1::2]
    text = np.searchsorted(texts.off, start, "right") - 1
    ends = np.concatenate([[0], np.cumsum(kind == 2)])
    sums = prefix_sums(buf)
    return Tokens(buf, start, end, text, ends[start] + text, span_hash(sums, start, end), span_hash(sums, start, np.minimum(end, start + STEM)) * (end - start > STEM))


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Grammar:
    """Word and stem hashes with class and weight, and the logistic curve over a text's clause scores."""

    classes: dict[int, tuple[int, float]]
    stems: dict[int, float]
    curve: np.ndarray
    clause: Transducer = CLAUSE

    def __post_init__(self):
        self.core = _Table([h for h, (c, _) in self.classes.items() if c in (INSULT, THREAT)])
        self.stem = _Table(list(self.stems))

    def features(self, texts: Texts) -> np.ndarray:
        """By text: the sum and the maximum of matched clauses' scores, and the sum of each different match's greatest path weight."""
        out = np.zeros((len(texts), 3))
        t = tokens_of(texts)
        hit = np.flatnonzero(self.core.has(t.word) | (self.stem.has(t.stem) if self.stems else False))
        if not len(hit):
            return out
        clauses = np.unique(t.clause[hit])
        lo, hi = np.searchsorted(t.clause, clauses), np.searchsorted(t.clause, clauses, "right")
        different: dict[int, dict] = {}
        for a, b in zip(lo.tolist(), hi.tolist()):
            doc, words = int(t.text[a]), t.word[a:b].tolist()
            path = [self.classes.get(w) or ((INSULT, self.stems[s]) if s in self.stems else (WORD, 0.0)) for w, s in zip(words, t.stem[a:b].tolist())]
            weights = path_weights(path, self.clause)
            score = sum(weights)
            out[doc, 0] += score
            out[doc, 1] = max(out[doc, 1], score)
            best = different.setdefault(doc, {})
            for w, x in zip(words, weights):
                if x:
                    best[w] = max(best.get(w, 0.0), x)
        for doc, best in different.items():
            out[doc, 2] = sum(best.values())
        return out

    def scores(self, texts: Texts) -> np.ndarray:
        x = _expanded(self.features(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


class _Table:
    """Membership of 64-bit hashes: a bitmap first, then a search."""

    def __init__(self, values: list[int]):
        self.values = np.sort(np.array(values, np.uint64))
        self.map = np.zeros(1 << 18, bool)
        self.map[(self.values & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.map[(h & np.uint64(0x3FFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
            out[at] = self.values[place] == h[at]
        return out


def _expanded(f: np.ndarray) -> np.ndarray:
    total, most, different = f.T
    return np.stack([np.ones(len(f)), np.sqrt(total), np.minimum(most, MOST), np.sqrt(different), (different > 0) * 1.0], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * len(y) * 0.01 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * len(y) * 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _frequencies(columns: list[Texts], y: np.ndarray, support: int) -> list[list[tuple[int, int, int]]]:
    """Of words, and of stems: (hash, toxic texts, other texts) for those in at least `support` toxic texts."""

    def distinct(label: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, column in enumerate(columns):
            t = tokens_of(column)
            keep = y[PART * k + t.text] == label
            row = t.text[keep].astype(np.uint64)
            yield tuple(_once(h[keep], row) for h in (t.word, t.stem))

    toxic = [np.unique(np.concatenate(x), return_counts=True) for x in zip(*distinct(1))]
    chosen = [(h[n >= support], n[n >= support]) for h, n in toxic]
    others = [np.zeros(len(h), np.int64) for h, _ in chosen]
    for found in distinct(0):
        for (h, _), count, seen in zip(chosen, others, found):
            if len(h):
                place = np.minimum(np.searchsorted(h, seen), len(h) - 1)
                count += np.bincount(place[h[place] == seen], minlength=len(h))
    return [[(int(a), int(b), int(c)) for a, b, c in zip(h, n, count) if a] for (h, n), count in zip(chosen, others)]


def _once(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes of each row, once a row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first]


def fit(texts: list[bytes], labels: list[int], sizes: dict, clause: Transducer = CLAUSE) -> Grammar:
    """Learned words are those whose document frequency among toxic rows exceeds what the others and their length lead one to expect."""
    classes = {_hash(w): (c, SEED_WEIGHT if c in (INSULT, THREAT) else 0.0) for c, words in SEEDS.items() for w in words.split()}
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Grammar(classes, {}, np.array([-3.0, 0.5, 0.5, 0.5, 0.0]))
    columns = [texts_of(pa.array(texts[i : i + PART], pa.binary()).cast(pa.string())) for i in range(0, len(texts), PART)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    words, stems = _frequencies(columns, y, max(SUPPORT, round(n1 / 100)))

    def weight(df1: int, df0: int) -> float:
        return math.log((df1 + 0.5) / (n1 + 1)) - math.log((df0 + 0.5) / (n0 + 1)) - 1.0 / math.sqrt(df1)

    learned = {h: w for h, k, other in words if (w := weight(k, other)) >= LEAST_WEIGHT}
    for h, w in learned.items():
        if classes.get(h, (INSULT,))[0] in (INSULT, THREAT):
            classes[h] = classes.get(h, (INSULT,))[0], w
    common = {h: w for h, k, other in stems if (w := weight(k, other)) >= LEAST_STEM}
    grammar = Grammar(classes, common, np.zeros(5), clause)
    x = _expanded(np.concatenate([grammar.features(c) for c in columns]))
    prior = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    grammar.curve = _logistic(x, y, prior / prior.mean())
    return grammar


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Fitted on at most per_label rows of each value of labels.toxic that aren't held out; without both values the seeds score alone. Other labels than 0 and 1 are not learned. Texts are read whole, however long. Null and empty texts score as texts without a match.
    predicted is 1 if score >= 0.5. Null doc_ids aren't held out and stay null; repeated rows give repeated rows; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, "toxic", per_label, [0, 1])))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = sent.value
        for batch, texts in steps(batches):
            p = grammar.scores(texts)
            yield record(schema, batch.column(0), batch.column(2), p, (p >= 0.5).astype(np.int32))

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
