"""XXH64 of many byte spans at once, with NumPy columns for registers."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _views(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer read as uint64 and uint32 at every byte."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    n = len(padded) - 7
    return padded, np.ndarray((n,), "<u8", padded, 0, (1,)), np.ndarray((n,), "<u4", padded, 0, (1,))


#: Spans hashed together; their registers then stay in the processor's cache.
BLOCK = 32_768


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[starts[i]:ends[i]] for every i, as uint64."""
    views = _views(buf)
    parts = [_block(views, starts[a : a + BLOCK], ends[a : a + BLOCK], seed) for a in range(0, len(starts), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _block(views: tuple, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    n = len(starts)
    with np.errstate(over="ignore"):
        bytes_, w8, w4 = views
        size = (ends - starts).astype(np.int64)
        order = np.argsort(size.astype(np.uint16) if size.max() < 65536 else size, kind="stable")
        pos, size = starts[order].astype(np.int64), size[order]
        s = np.uint64(seed)
        h = np.full(n, s + P5, np.uint64)
        first = int(np.searchsorted(size, 32))
        if first < n:
            p, z = pos[first:], size[first:]
            acc = [np.full(n - first, x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes = z >> 5
            for j in range(int(stripes[-1])):
                a = int(np.searchsorted(stripes, j + 1))
                for k in range(4):
                    acc[k][a:] = _round(acc[k][a:], w8[p[a:] + (32 * j + 8 * k)])
            big = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                big = (big ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[first:] = big
            pos[first:] += stripes << 5
        h += size.astype(np.uint64)
        rest = size.copy()
        rest[first:] &= 31
        for _ in range(3):
            m = np.flatnonzero(rest >= 8)
            if not len(m):
                break
            k = _round(np.zeros(len(m), np.uint64), w8[pos[m]])
            h[m] = _rotl(h[m] ^ k, 27) * P1 + P4
            pos[m] += 8
            rest[m] -= 8
        m = np.flatnonzero(rest >= 4)
        if len(m):
            h[m] = _rotl(h[m] ^ (w4[pos[m]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[m] += 4
            rest[m] -= 4
        for _ in range(3):
            m = np.flatnonzero(rest >= 1)
            if not len(m):
                break
            h[m] = _rotl(h[m] ^ (bytes_[pos[m]].astype(np.uint64) * P5), 11) * P1
            pos[m] += 1
            rest[m] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        out = np.empty(n, np.uint64)
        out[order] = h
        return out


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of uint64 values, another for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {0: np.ones(1, np.uint64), 1: np.ones(1, np.uint64)}


def _powers(n: int, inverse: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n, kept for the next call."""
    if len(_POWERS[inverse]) < n:
        with np.errstate(over="ignore"):
            table = np.full(1 << (n - 1).bit_length(), _BASE_INVERSE if inverse else _BASE, np.uint64)
            table[0] = 1
            _POWERS[inverse] = np.multiply.accumulate(table)
    return _POWERS[inverse][:n]


_SYMBOLS = mix64(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums from which any span's hash follows in constant time."""
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_SYMBOLS[buf] * _powers(len(buf), 0), out=out[1:]) if len(buf) else None
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they stand in a buffer."""
    with np.errstate(over="ignore"):
        return mix64((sums[ends] - sums[starts]) * _powers(len(sums), 1)[starts] + (ends - starts).astype(np.uint64))
