"""Lossless JPEG frames (ITU-T T.81, the lossless sequential process with Huffman codes): decoding with any predictor, encoding with any one (COD-3).

The DCT processes are not here. Huffman codes are read sample by sample; prediction works on whole rows where the predictor allows it.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np

from .p10 import Broken

LOSSLESS, FIRST_ORDER = "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70"
#: Markers (fixed values of the public standard).
EOI, SOF3, DHT, SOS, DRI = 0xD9, 0xC3, 0xC4, 0xDA, 0xDD
#: Samples whose codes are packed at a time.
STEP = 1 << 18


class _Codes:
    """A Huffman table as (length, category) of every 16-bit prefix; length 0 where no code fits."""

    def __init__(self, counts: bytes, values: bytes):
        self.length, self.category = [0] * 65536, [0] * 65536
        code = at = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                a, b = code << 16 - size, (code + 1) << 16 - size
                if b > 65536 or at >= len(values) or values[at] > 16:
                    raise Broken("a Huffman table is wrong")
                self.length[a:b], self.category[a:b] = [size] * (b - a), [values[at]] * (b - a)
                code, at = code + 1, at + 1
            code <<= 1


def _differences(data: bytes, tables: list[_Codes], count: int) -> np.ndarray:
    """count differences of one restart interval, whose components take turns."""
    data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8  # ones fill the end
    out, held, bits, at, limit, turn, n = array("i", bytes(4 * count)), 0, 0, 0, len(data), 0, len(tables)
    for k in range(count):
        while bits < 32:
            if at >= limit:
                raise Broken("a JPEG frame is cut off")
            held, bits, at = (held & (1 << bits) - 1) << 8 | data[at], bits + 8, at + 1
        table = tables[turn]
        turn = turn + 1 if turn + 1 < n else 0
        prefix = held >> bits - 16 & 0xFFFF
        size, category = table.length[prefix], table.category[prefix]
        if not size:
            raise Broken("no Huffman code fits")
        bits -= size
        if category == 16:
            out[k] = 32768
        elif category:
            bits -= category
            v = held >> bits & (1 << category) - 1
            out[k] = v if v >> category - 1 else v - (1 << category) + 1
    if 8 * at - bits > 8 * (limit - 8):
        raise Broken("a JPEG frame is cut off")
    return np.frombuffer(out, np.int32)


def _rebuilt(d: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Samples of one component's rows from their differences, modulo 65,536; the first row is predicted from the left, the first column from above."""
    x = np.empty(d.shape, np.int64)
    x[0] = (start + np.cumsum(d[0])) & 0xFFFF
    for i in range(1, len(d)):
        up, row = x[i - 1], d[i].astype(np.int64)
        row[0] += up[0]
        if predictor == 1:
            row = np.cumsum(row)
        elif predictor == 2:
            row[1:] += up[1:]
        elif predictor == 3:
            row[1:] += up[:-1]
        elif predictor == 4:
            row[1:] += up[1:] - up[:-1]
            row = np.cumsum(row)
        elif predictor == 5:
            row[1:] += up[1:] - up[:-1] >> 1
            row = np.cumsum(row)
        else:
            values, above = row.tolist(), up.tolist()
            values[0] &= 0xFFFF
            for j in range(1, len(values)):
                left = values[j - 1]
                guess = above[j] + (left - above[j - 1] >> 1) if predictor == 6 else left + above[j] >> 1
                values[j] = values[j] + guess & 0xFFFF
            row = np.array(values, np.int64)
        x[i] = row & 0xFFFF
    return x


def _scan(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of entropy-coded data from `at`, and where the next marker stands."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[start:])
            return parts, len(data)
        if data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            at = start = at + 2
        else:
            parts.append(data[start:at])
            return parts, at


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as rows x columns x components, precision) of a lossless frame; Broken for other processes, cut or wrong data."""
    tables: dict[int, _Codes] = {}
    frame, planes, interval, at = None, {}, 0, data.find(b"\xff\xd8") + 2
    if at < 2:
        raise Broken("no JPEG frame")
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise Broken("a JPEG marker is missing")
        marker, at = data[at + 1], at + 1
        if marker == 0xFF:
            continue
        at += 1
        if marker == EOI:
            break
        if at + 2 > len(data):
            raise Broken("a JPEG frame is cut off")
        (size,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + size], at + size
        if size < 2 or len(body) != size - 2:
            raise Broken("a JPEG frame is cut off")
        if marker == DHT:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise Broken("a Huffman table is cut off")
                tables[body[0]], body = _Codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == DRI:
            (interval,) = struct.unpack(">H", body)
        elif marker == SOF3:
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * k], body[7 + 3 * k]) for k in range(n)]
            if not rows or not columns or not 2 <= precision <= 16 or any(sampling != 0x11 for _, sampling in frame):
                raise Broken("a JPEG frame without a size, or with sampling that differs")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Broken(f"JPEG process {marker:02X} has no decoder")
        elif marker == SOS:
            if frame is None:
                raise Broken("a JPEG scan without a frame")
            chosen = [(body[1 + 2 * k], tables.get(body[2 + 2 * k] >> 4)) for k in range(body[0])]
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            if not 1 <= predictor <= 7 or shift >= precision or any(t is None or c not in dict(frame) for c, t in chosen):
                raise Broken("a JPEG scan that doesn't suit its frame")
            parts, at = _scan(data, at)
            if interval % columns:
                raise Broken("a restart inside a row")
            deep, left = interval // columns or rows, rows
            pieces = []
            for part in parts:
                if left > 0:
                    here = min(deep, left)
                    d = _differences(part, [t for _, t in chosen], here * columns * len(chosen)).reshape(here, columns, -1)
                    pieces.append(np.stack([_rebuilt(d[:, :, k], predictor, 1 << precision - shift - 1) for k in range(len(chosen))], 2))
                    left -= here
            if left:
                raise Broken("a JPEG frame is cut off")
            whole = np.concatenate(pieces) << shift
            planes |= {c: whole[:, :, k] for k, (c, _) in enumerate(chosen)}
    if frame is None or any(c not in planes for c, _ in frame):
        raise Broken("a JPEG frame without all its scans")
    return np.stack([planes[c] for c, _ in frame], 2) & 0xFFFF, precision


def decoded(data: bytes, at) -> bytes:
    """Interleaved little-endian samples that suit the record's layout; signed ones get their sign from the stream's precision."""
    x, precision = decode(data)
    if x.shape != (at.rows, at.columns, at.samples) or precision > at.bits:
        raise Broken(f"a JPEG frame of {x.shape} samples of {precision} bits in a record of {at.rows} x {at.columns} x {at.samples} of {at.bits}")
    if at.signed:
        x = np.where(x >> precision - 1 & 1, x - (1 << precision), x)
    return x.astype(f"<{at.kind}").tobytes()


def _guesses(x: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """What each sample of rows x columns x components is predicted to be."""
    out = np.empty_like(x)
    out[0, 0], out[0, 1:], out[1:, 0] = start, x[0, :-1], x[:-1, 0]
    left, up, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    rules = {1: left, 2: up, 3: corner, 4: left + up - corner, 5: left + (up - corner >> 1), 6: up + (left - corner >> 1), 7: left + up >> 1}
    out[1:, 1:] = rules[predictor]
    return out


def _packed(d: np.ndarray) -> np.ndarray:
    """The bits of differences from -32,767 to 32,768: five for the category, then as many as it says."""
    category = np.where(d == 0, 0, np.frexp(np.abs(d).astype(float))[1])
    extra = np.where(category == 16, 0, category)
    word = category << extra | np.where(d < 0, d + (1 << extra) - 1, np.where(category == 16, 0, d))
    size = 5 + extra
    ends = np.cumsum(size)
    place = np.repeat(ends, size) - 1 - np.arange(ends[-1])  # a bit's distance from its word's end
    return (np.repeat(word, size) >> place & 1).astype(np.uint8)


def encode(x: np.ndarray, precision: int, predictor: int = 1) -> bytes:
    """A lossless frame of unsigned samples (rows x columns x components) below 2 ** precision. Codes are five bits for each of 17 categories."""
    if x.ndim != 3 or not 2 <= precision <= 16 or predictor not in range(1, 8) or not all(0 < n < 65536 for n in x.shape[:2]) or not 0 < x.shape[2] < 5:
        raise Broken("samples that a lossless JPEG frame can't hold")
    x = x.astype(np.int64)
    if x.min() < 0 or x.max() >> precision:
        raise Broken(f"samples beyond {precision} bits")
    d = (x - _guesses(x, predictor, 1 << precision - 1) & 0xFFFF).ravel()
    d = np.where(d > 32768, d - 65536, d)
    rest, parts = np.zeros(0, np.uint8), []
    for at in range(0, len(d), STEP):
        bits = np.concatenate([rest, _packed(d[at : at + STEP])])
        whole = len(bits) // 8 * 8
        rest = bits[whole:]
        parts.append(np.packbits(bits[:whole]).tobytes())
    parts.append(np.packbits(np.concatenate([rest, np.ones(-len(rest) % 8, np.uint8)])).tobytes())
    body = b"".join(parts).replace(b"\xff", b"\xff\x00")
    rows, columns, n = x.shape
    segment = lambda marker, content: struct.pack(">BBH", 0xFF, marker, len(content) + 2) + content
    head = struct.pack(">BHHB", precision, rows, columns, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    codes = bytes([0, *(17 if k == 5 else 0 for k in range(1, 17)), *range(17)])
    scan = bytes([n, *(v for k in range(n) for v in (k + 1, 0)), predictor, 0, 0])
    return b"\xff\xd8" + segment(SOF3, head) + segment(DHT, codes) + segment(SOS, scan) + body + b"\xff\xd9"
