"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

Two texts' kernel is the number of n-grams that both contain, blended over n = 1, 2 and 3 bytes and normalised by the sizes of their
n-gram sets. Landmark texts span the Nyström approximation; one ridge regression per language is fitted against the rest. Scoring a batch
is a presence matrix times the landmarks' matrix times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import Texts, fresh, held_out, quoted, record, steps, texts_of, with_carried
from .training import sample

#: Columns of a presence matrix, rows fitted per language at most, and landmarks per language at most.
DIMENSIONS, PER_LANGUAGE, LANDMARKS = 1 << 14, 250, 24
RIDGE, SHARPNESS, UNKNOWN = 1e-2, 4.0, "und"
#: Least share of the softmax with which a language is accepted.
LEAST = 0.4


def presence(texts: Texts) -> np.ndarray:
    """Which hashed n-grams each whole text has; column 0 stands for n-grams across texts and is empty."""
    n, bits = len(texts), DIMENSIONS.bit_length() - 1
    out = np.zeros(n * DIMENSIONS, np.uint8)
    buf = texts.buf
    lower = np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(texts.off))
    code = lower.copy()
    for width, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        if width > 1:
            code = code[:-1] | lower[width - 1 :] << np.uint32(8 * width - 8) if len(code) else code
        at = row[: len(code)] + ((code * np.uint32(factor)) >> np.uint32(32 - bits))
        for k in range(1, width):
            cross = texts.off[1:] - k
            cross = cross[(cross >= 0) & (cross < len(at))]
            at[cross] = row[cross]
        out[at] = 1
    out = out.reshape(n, DIMENSIONS)
    out[:, 0] = 0
    return out


def has_letter(raw: bytes) -> bool:
    return raw.upper() != raw.lower() or regex.search(r"\p{L}", raw.decode("utf-8", "replace")) is not None


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # a row a landmark, normalised
    weights: np.ndarray  # landmarks by languages

    def scores(self, texts: Texts) -> np.ndarray:
        x = presence(texts)
        norm = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))[:, None]
        return (x.astype(np.float32) @ self.landmarks.T / norm) @ self.weights


def fit(texts: list[bytes], labels: list[str]) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    x = presence(texts_of(pa.array(texts, pa.binary()).cast(pa.string())))
    norm = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))
    at = [i for name in languages for i in [k for k, v in enumerate(labels) if v == name][:LANDMARKS]]
    z = x[at].astype(np.float32) / norm[at, None].astype(np.float32)
    k_nm = np.concatenate([x[i : i + 128].astype(np.float32) @ z.T for i in range(0, len(x), 128)]) / norm[:, None]
    values, vectors = np.linalg.eigh(k_nm[at].astype(np.float64) + 1e-8 * np.eye(len(at)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = k_nm @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1 / np.array([labels.count(v) for v in labels], np.float64)
    share *= len(labels) / share.sum()
    w = np.linalg.solve((phi * share[:, None]).T @ phi + RIDGE * len(labels) / len(at) * np.eye(len(at)), (phi * share[:, None]).T @ y)
    return Model(languages, z, root @ w)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, carry: list[str] = (), prefix: str = "") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Texts are read whole, however long. Fitted on at most per_language rows a language, of the 256 most frequent ones, of `docs` that aren't held out and have a text and a lang; without any, all are `und`. Null texts and texts without
    a letter are `und` with score 0. Otherwise lang_pred is a learned value and score its share of the softmax; equal scores go to the first language in
    order. Null doc_ids aren't held out and stay null; repeated rows give repeated rows; an empty table gives an empty result. Columns named in carry follow; others are ignored.
    prefix goes before held_out, lang_pred and score, for tables with such columns of their own.
    """
    model = fit(*sample(docs, docs, "lang", per_language)[:2])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), (f"{prefix}held_out", pa.bool_()), (f"{prefix}lang_pred", pa.string()), (f"{prefix}score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, texts in steps(batches, 1):
            n = len(texts)
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None:
                known = np.array([has_letter(texts.raw(i)) for i in range(n)], bool)
                for a in range(0, n, 512):
                    part = Texts(texts.buf[texts.off[a] : texts.off[min(n, a + 512)]], texts.off[a : a + 513] - texts.off[a])
                    e = np.exp(SHARPNESS * model.scores(part))
                    best = e.argmax(axis=1)
                    names[a : a + 512] = np.array(model.languages, object)[best]
                    score[a : a + 512] = e.max(axis=1) / e.sum(axis=1)
                names[~known], score[~known] = UNKNOWN, 0.0
            made = record(schema, batch.column(0), batch.column(2), pa.array(names.tolist(), pa.string()), score)
            kept = [batch.column(1 if c == "text" else 3 + more.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*made.columns, *kept], names=[*made.schema.names, *carry])

    more = [c for c in carry if c != "text"]
    kept = [quoted(c).alias(f"c{k + 2}") for k, c in enumerate(more)]
    rows = docs.select(F.col("doc_id").alias("c0"), F.col("text").alias("c1"), held_out().alias("held"), *kept)
    columns = [("doc_id", "long"), (f"{prefix}held_out", "boolean"), (f"{prefix}lang_pred", "string"), (f"{prefix}score", "double")]
    return rows.mapInArrow(run, with_carried(columns, docs, carry))


def accepted(docs: DataFrame, per_language: int = PER_LANGUAGE, wanted: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """`docs` without the documents whose language is `und`, is not one of those wanted, or scores below `least`; all columns stay, whatever their names."""
    own = fresh(docs, "own_")
    judged = identify(docs, per_language, [c for c in docs.columns if c != "doc_id"], own)
    name, score = F.col(f"{own}lang_pred"), F.col(f"{own}score")
    kept = judged.filter((name != UNKNOWN) & (score >= least) & (name.isin(list(wanted)) if wanted is not None else F.lit(True)))
    return kept.select(*map(quoted, docs.columns))
