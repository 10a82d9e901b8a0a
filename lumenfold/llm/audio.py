"""Media columns: lossless 8-bit audio, its log-mel features and its energy segments.

A payload is stored as a mono WAV file with 8-bit samples and read back from those bytes. The samples go through a polyphase FIR resampler, overlapped
windows, a mel filterbank and a logarithm; frames whose energy rises above a high threshold open a segment that lasts until it falls below a
low one. Every stretch of a fixed number of log-mel frames is stored as an Arrow tensor of one shape, with its time span, so texts of any length give tensors of one shape and lose no frame.
Each text is computed on its own, so equal texts have equal values wherever they stand.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import narrow, record, steps

BLOCK, RATE = 64, 8000
#: Added to a band's power, and the logarithm that silence then has.
FLOOR = 1e-6
SILENCE = np.log(np.float32(FLOOR))


@dataclass(frozen=True)
class Settings:
    """Resampling by up / down; window and hop in resampled samples; mel bands; frames of a tensor; segment thresholds in deviations from the mean."""

    up: int = 2
    down: int = 3
    taps: int = 16
    window: int = 256
    hop: int = 128
    bands: int = 16
    frames: int = 16
    high: float = 0.25
    low: float = -0.25


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file whose samples are the payload's bytes; of odd length there is one more byte, as the format asks for."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and sampling rate of an 8-bit mono WAV file; its chunks may stand in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data" and rate is not None:
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc by phase: row p holds every up-th coefficient from the p-th on, in reverse."""
    n = taps * up
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hanning(n + 2)[1:-1]
    return np.ascontiguousarray((h * up / h.sum()).reshape(taps, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Polyphase: only the samples that stay are computed, each from its own phase of the filter."""
    phases = _filter(s.up, s.down, s.taps)
    padded = np.concatenate([np.zeros(s.taps - 1, np.float32), x])
    seen = np.lib.stride_tricks.sliding_window_view(padded, s.taps)
    out = np.empty(-(-len(x) * s.up // s.down), np.float32)
    for r in range(s.up):  # every up-th sample comes from one phase
        own = out[r :: s.up]
        own[:] = seen[r * s.down // s.up :: s.down][: len(own)] @ phases[r * s.down % s.up]
    return out


@lru_cache
def _mel(rate: float, window: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the spectrum's bins."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    hz = np.arange(window // 2 + 1) * rate / window
    rise = (hz - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - hz) / (edges[2:] - edges[1:-1])[:, None]
    return np.ascontiguousarray(np.maximum(0, np.minimum(rise, fall)).T, np.float32)


@lru_cache
def _hann(window: int) -> np.ndarray:
    return np.hanning(window).astype(np.float32)


def log_mel(samples: bytes, rate: int, s: Settings) -> tuple[np.ndarray, float]:
    """Log-mel frames (frames, bands) and the seconds between them."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, s)
    new_rate = rate * s.up / s.down
    short = s.window - len(y) if len(y) < s.window else -(len(y) - s.window) % s.hop
    y = np.concatenate([y, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, s.window)[:: s.hop]
    spectrum = np.fft.rfft(frames * _hann(s.window), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(power @ _mel(new_rate, s.window, s.bands) + FLOOR), s.hop / new_rate


def segments(frames: np.ndarray, seconds: float, s: Settings) -> list[tuple[float, float]]:
    """Time spans with hysteresis: opened by energy of at least the high threshold, closed by energy below the low one."""
    e = frames.mean(axis=1)
    mid, spread = float(e.mean()), float(e.std())
    event = np.where(e >= mid + s.high * spread, 1, np.where(e < mid + s.low * spread, 0, -1))
    event[0] = max(0, event[0])
    on = event[np.maximum.accumulate(np.where(event >= 0, np.arange(len(e)), 0))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(a * seconds, b * seconds) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def stretches(frames: np.ndarray, seconds: float, s: Settings) -> list[dict]:
    """Tensors of s.frames frames each, with start and end in seconds and how many frames are real; the last is filled up with the logarithm of silence."""
    out = []
    for a in range(0, len(frames), s.frames):
        part = frames[a : a + s.frames]
        n = len(part)
        if n < s.frames:
            part = np.concatenate([part, np.full((s.frames - n, frames.shape[1]), SILENCE, np.float32)])
        out.append({"start": a * seconds, "end": (a + n) * seconds, "frames": n, "tensor": packed(part)})
    return out


def packed(values: np.ndarray) -> bytes:
    """An Arrow tensor message: type, shape and values."""
    sink = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(values, np.float32)), sink)
    return sink.getvalue().to_pybytes()


def unpacked(message: bytes) -> np.ndarray:
    return pa.ipc.read_tensor(pa.BufferReader(message)).to_numpy()


TENSOR = "struct<start:double,end:double,frames:int,tensor:binary>"
AUDIO = f"doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors array<{TENSOR}>, segments array<struct<start:double,end:double>>, feature string"


def audio(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: its audio file, what reads back from it, and its features.

    A text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, are the samples; null and empty texts have 64 of them. tensors holds the log-mel frames as Arrow tensors of shape (frames, bands) with their time spans,
    segments the energy segments, feature the mean of each band and the number and length of segments. Texts are read whole, however long. Repeated rows give repeated rows, null doc_ids
    stay null, other columns, whatever their names, are ignored, an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(AUDIO))

    def row(raw: bytes) -> tuple:
        media = encode_wav(raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)))
        samples, rate = decode_wav(media)
        frames, seconds = log_mel(samples, rate, settings)
        parts = segments(frames, seconds, settings)
        text = " ".join(f"{x:.3f}" for x in frames.mean(axis=0, dtype=np.float64).tolist()) + f" | {len(parts)} {sum(b - a for a, b in parts):.3f}"
        return len(raw), media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), stretches(frames, seconds, settings), [{"start": a, "end": b} for a, b in parts], text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            columns = list(zip(*(row(texts.raw(i)) for i in range(len(texts)))))
            yield record(schema, batch.column(0), *columns)

    return narrow(docs).mapInArrow(run, AUDIO)


def as_tensors(table: pa.Table, settings: Settings = Settings()) -> pa.Table:
    """(doc_id, start, end, frames, log_mel) of an Arrow table of audio() rows: a row per tensor, in a column of Arrow's fixed-shape tensor type."""
    rows = [(doc, t["start"], t["end"], t["frames"], unpacked(t["tensor"]).ravel()) for doc, tensors in zip(table["doc_id"].to_pylist(), table["tensors"].to_pylist()) for t in tensors]
    kind = pa.fixed_shape_tensor(pa.float32(), (settings.frames, settings.bands))
    values = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.float32)
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values, pa.float32()), settings.frames * settings.bands))
    types = (pa.int64(), pa.float64(), pa.float64(), pa.int32())
    return pa.table({**{n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("doc_id", "start", "end", "frames"), types))}, "log_mel": tensor})


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "tensors", "segments")
