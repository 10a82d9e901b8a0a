"""Words and word shingles of many texts as positions in one flat, normalised buffer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbuf import Texts


@dataclass
class Words:
    """buf: texts with A-Z lower-cased and one space between words, each ended by a newline."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and at last the number of words


def words_of(texts: Texts) -> Words:
    """Words are runs of bytes other than the six ASCII white-space characters."""
    raw = texts.buf.tobytes()
    off = texts.off.tolist()
    joined = b"\n".join([b" ".join(raw[a:b].lower().split()) for a, b in zip(off, off[1:])] + [b""])
    buf = np.frombuffer(joined, np.uint8)
    end = np.flatnonzero(buf <= 32)
    end = end[(buf[end] == 32) | (buf[end] == 10)]
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    last = buf[end] == 10
    real = end > start
    count = np.concatenate([[0], np.cumsum(real)])
    first = np.concatenate([[0], count[np.flatnonzero(last) + 1]])
    return Words(buf, start[real], end[real], first)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and each text's first shingle. A shorter text has one, of all its words."""
    n = np.diff(words.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(n)), count)
    a = np.arange(first[-1]) - first[of] + words.first[of]
    return a, np.minimum(a + width, words.first[of + 1]) - 1, first
