"""Lossless JPEG against an encoder written sample by sample from the public standard."""

import struct

import numpy as np
import pytest

from lumenfold.sources import frames, jpeg, p10


def plain_encoder(x, precision, predictor, shift=0, restart_rows=0):
    """Loops over samples; code lengths differ between categories (1, 3 and 6 bits), unlike the library's encoder."""
    codes = {0: "0", 1: "100", 2: "101", 3: "110"} | {k: format(56 + k - 4, "06b") for k in range(4, 11)}
    codes |= {k: "111111" + format(k - 11, "03b") for k in range(11, 17)}
    rows, columns, n = x.shape
    parts, bits = [], ""

    def close(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    x = x.astype(int) >> shift
    for i in range(rows):
        first = i == 0 or (restart_rows and i % restart_rows == 0)
        if first and i:
            parts.append(close(bits))
            bits = ""
        for j in range(columns):
            for c in range(n):
                a = x[i, j - 1, c] if j else 0
                b = x[i - 1, j, c] if not first else 0
                cc = x[i - 1, j - 1, c] if j and not first else 0
                if first:
                    guess = a if j else 1 << precision - shift - 1
                elif not j:
                    guess = b
                else:
                    guess = [a, b, cc, a + b - cc, a + ((b - cc) >> 1), b + ((a - cc) >> 1), (a + b) >> 1][predictor - 1]
                d = (int(x[i, j, c]) - int(guess)) % 65536
                d = d - 65536 if d > 32768 else d
                k = abs(d).bit_length()
                bits += codes[k]
                if 0 < k < 16:
                    bits += format(d if d > 0 else d + (1 << k) - 1, f"0{k}b")
    parts.append(close(bits))
    segment = lambda m, body: struct.pack(">BBH", 255, m, len(body) + 2) + body
    counts = [1, 0, 3, 0, 0, 7, 0, 0, 6] + [0] * 7
    head = segment(0xC3, struct.pack(">BHHB", precision, rows, columns, n) + b"".join(bytes([9 + k, 17, 0]) for k in range(n)))
    table = segment(0xC4, bytes([1, *counts, *range(17)]))
    restart = segment(0xDD, struct.pack(">H", restart_rows * columns)) if restart_rows else b""
    scan = segment(0xDA, bytes([n, *(v for k in range(n) for v in (9 + k, 16)), predictor, 0, shift]))
    body = parts[0] + b"".join(bytes([255, 0xD0 + k % 8]) + p for k, p in enumerate(parts[1:]))
    return b"\xff\xd8" + segment(0xFE, b"note") + table + head + restart + scan + body + b"\xff\xd9\0"


def images(precision, n):
    rng, top = np.random.default_rng(precision * 10 + n), (1 << precision) - 1
    yield rng.integers(0, top, (9, 7, n), endpoint=True)
    yield np.clip(np.add.outer(np.arange(12), np.arange(10))[:, :, None] * (top // 30 or 1) + np.zeros(n, int), 0, top)
    yield np.full((1, 5, n), top)
    yield np.array([0, top] * 6).reshape(6, 2, 1).repeat(n, 2)  # greatest differences
    yield rng.integers(0, top, (4, 1, n), endpoint=True)


@pytest.mark.parametrize("precision", [2, 8, 12, 16])
@pytest.mark.parametrize("n", [1, 3])
def test_decodes_what_the_standard_says(precision, n):
    for x in images(precision, n):
        for predictor in range(1, 8):
            found, bits = jpeg.decode(plain_encoder(x, precision, predictor))
            assert bits == precision and (found == x).all(), predictor
            assert (jpeg.decode(plain_encoder(x, precision, predictor, restart_rows=2))[0] == x).all(), predictor
            assert (jpeg.decode(jpeg.encode(x, precision, predictor))[0] == x).all(), predictor
            assert precision == 2 or (jpeg.decode(plain_encoder(x, precision, predictor, shift=2))[0] == x >> 2 << 2).all(), predictor


def test_packing_in_steps(monkeypatch):
    x = np.random.default_rng(1).integers(0, 65536, (40, 30, 1))
    whole = jpeg.encode(x, 16, 4)
    monkeypatch.setattr(jpeg, "STEP", 7)
    assert jpeg.encode(x, 16, 4) == whole and (jpeg.decode(whole)[0] == x).all()


def test_broken_frames_are_errors():
    data = plain_encoder(np.arange(200).reshape(20, 10, 1), 8, 1)
    for k in range(len(data) - 4):
        with pytest.raises((p10.Broken, struct.error, IndexError)):
            jpeg.decode(data[:k])
    with pytest.raises(p10.Broken, match="process"):
        jpeg.decode(data.replace(b"\xff\xc3", b"\xff\xc0", 1))
    for bad in (np.array([[[256]]]), np.array([[[-1]]])):
        with pytest.raises(p10.Broken):
            jpeg.encode(bad, 8)


@pytest.mark.parametrize(("bits", "signed", "samples"), [(8, 0, 3), (16, 1, 1), (16, 0, 1)])
def test_records(spark, bits, signed, samples):
    kind = f"<{'i' if signed else 'u'}{bits // 8}"
    x = np.random.default_rng(bits + signed).integers(-30000 if signed else 0, 30000 if bits == 16 else 255, (2, 6, 5, samples)).astype(kind)
    body = [(0x00280002, "US", [samples]), (0x00280004, "CS", "RGB" if samples == 3 else "MONOCHROME2"), (0x00280008, "IS", "2"), (0x00280010, "US", [6]), (0x00280011, "US", [5])]
    body += [(0x00280100, "US", [bits]), (0x00280101, "US", [bits]), (0x00280102, "US", [bits - 1]), (0x00280103, "US", [signed])]
    native = p10.write([*body, (p10.PIXELS, "OW", x.tobytes())], p10.EXPLICIT)
    rows = [(s, frames.transcode(native, s)) for s in (jpeg.LOSSLESS, jpeg.FIRST_ORDER)]
    rows.append(("again", frames.transcode(rows[0][1], frames.RLE)))
    found = frames.frames(spark.createDataFrame(rows, "instance_id string, content binary")).collect()
    assert len(found) == 6 and all(r.error is None and r.samples == x[r.frame].tobytes() for r in found)
