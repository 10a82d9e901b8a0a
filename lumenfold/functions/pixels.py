"""Sample transforms on arrays (PIX)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(samples: Column, slope: Column, intercept: Column) -> Column:
    """stored * slope + intercept for each sample, in double precision."""
    return F.transform(samples, lambda v: v.cast("double") * slope + intercept)


def rescale_frames(frames: Column, pairs: Column) -> Column:
    """One (slope, intercept) pair for each frame; null unless there are as many."""
    done = F.transform(F.arrays_zip(frames.alias("f"), pairs.alias("p")), lambda x: rescale(x["f"], x["p"]["slope"], x["p"]["intercept"]))
    return F.when(F.size(frames) == F.size(pairs), done)


def lut(value: Column, table: Column, first: Column) -> Column:
    """The table's entry for value - first, clamped to its ends."""
    return F.get(table, F.least(F.greatest(value - first, F.lit(0)), F.size(table) - 1).cast("int"))


def lut_entries(count: Column) -> Column:
    return F.when(count == 0, 65536).otherwise(count)


def palette(value: Column, red: Column, green: Column, blue: Column, first: Column, alpha: Column | None = None) -> Column:
    """The colour of an index, with alpha where there is a table for it."""
    tables = {"r": red, "g": green, "b": blue} | ({} if alpha is None else {"a": alpha})
    return F.struct(*(lut(value, table, first).alias(n) for n, table in tables.items()))


def voi_lut(value: Column, table: Column, first: Column, bits: Column) -> Column:
    """(v, kind): the table's entry, masked to its bits, and the kind of sample that holds it."""
    entry = lut(value, table, first).cast("long").bitwiseAND((F.pow(F.lit(2), bits) - 1).cast("long"))
    return F.struct(entry.cast("int").alias("v"), F.when(bits <= 8, "uint8").otherwise("uint16").alias("kind"))


def table_entries(raw: bytes, entries: int, bits: int) -> list[int]:
    """A discrete table's entries, masked to their bits, from single bytes or little-endian pairs of them; ValueError for too few bytes."""
    if len(raw) >= 2 * entries:
        values = np.frombuffer(raw[: 2 * entries], "<u2")
    elif len(raw) >= entries and bits <= 8:
        values = np.frombuffer(raw[:entries], np.uint8)
    else:
        raise ValueError(f"{len(raw)} bytes for {entries} entries")
    return (values.astype(np.int64) & (1 << bits) - 1).tolist()


def window(value: Column, center: Column, width: Column, function: str = "linear", top: int = 255) -> Column:
    """Truncated display value; null for a width below 1 (linear) or not above 0."""
    x = value.cast("double")
    if function == "linear":
        low, high, ok = center - 0.5 - (width - 1) / 2, center - 0.5 + (width - 1) / 2, width >= 1
        y = F.when(x <= low, 0.0).when(x > high, 1.0).otherwise((x - (center - 0.5)) / (width - 1) + 0.5)
    elif function == "linear_exact":
        low, high, ok = center - width / 2, center + width / 2, width > 0
        y = F.when(x <= low, 0.0).when(x > high, 1.0).otherwise((x - center) / width + 0.5)
    elif function == "sigmoid":
        ok, y = width > 0, 1 / (1 + F.exp(-4 * (x - center) / width))
    else:
        raise ValueError(f"no window function {function}")
    return F.when(ok, (F.nanvl(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * top).cast("int"))


def unpack_bits(value: Column, bits: int) -> Column:
    """0 or 1 for each bit, the least significant first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def min_max(samples: Column) -> Column:
    """Samples scaled to 0..255, 0 if all are equal."""
    low, high = F.array_min(samples), F.array_max(samples)
    return F.transform(samples, lambda v: F.when(high > low, ((v - low) / (high - low) * 255).cast("int")).otherwise(0))


def interleaved(planar: Column, channels: int) -> Column:
    n = F.size(planar) / channels
    return F.transform(F.sequence(F.lit(0), F.size(planar) - 1), lambda i: F.get(planar, ((i % channels) * n + F.floor(i / channels)).cast("int")))


def planar(samples: Column, channels: int) -> Column:
    n = (F.size(samples) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(samples) - 1), lambda i: F.get(samples, ((i % n) * channels + F.floor(i / n)).cast("int")))


def packed_frame_bytes(rows: Column, columns: Column, samples: Column, bits: Column) -> Column:
    return rows.cast("long") * columns * samples * F.ceil(bits / 8)


def lut_descriptor(values: Column, signed: Column) -> Column:
    """(entries, first, bits) of a descriptor's three numbers: 0 entries are 65536; null unless there are three and 1 to 16 bits."""
    first = F.when(signed & (values[1] > 32767), values[1] - 65536).otherwise(values[1])
    right = (F.size(values) == 3) & F.get(values, F.lit(2)).between(1, 16)
    return F.when(right, F.struct(lut_entries(values[0]).alias("entries"), first.alias("first"), values[2].alias("bits")))


def expand_segments(data: list[int], bits: int) -> list[int]:
    """A segmented lookup table's entries: discrete, linear and indirect segments; ValueError for a broken one.

    Work waiting is a stack of (position, segments left, reader is nested), so a chain of references needs no recursion.
    """
    mask, wide, out = (1 << bits) - 1, bits > 8, []
    stack: list[list] = [[0, None]]
    budget = 65536 * 4
    while stack:
        at, left = stack[-1]
        budget -= 1
        if budget < 0 or len(out) > 65536:
            raise ValueError("segments don't end")
        if at + 1 >= len(data) or left == 0:
            stack.pop()
            continue
        kind, n = data[at], data[at + 1]
        at += 2
        body = n if kind == 0 else 1 if kind == 1 else (2 if wide else 4) if kind == 2 else None
        if body is None:
            raise ValueError(f"no segment kind {kind}")
        if at + body > len(data):
            raise ValueError("a segment is cut off")
        part = data[at : at + body]
        stack[-1] = [at + body, None if left is None else left - 1]
        if kind == 0:
            out += [v & mask for v in part]
            continue
        if not out:
            raise ValueError("no entry to go on from")
        if kind == 1:
            y, end = out[-1], part[0] & mask
            out += [int(y + (end - y) / n * k + 0.5) & mask for k in range(1, n + 1)]
            continue
        to = sum(v << (16 if wide else 8) * i for i, v in enumerate(part))
        if to >= len(data):
            raise ValueError("a reference leads out")
        if n:
            stack.append([to, n])
        elif to + 1 < len(data):
            stack.append([to, None])
    return out


def ybr_to_rgb(y: Column, cb: Column, cr: Column, partial: bool = False) -> Column:
    """Truncated 8-bit red, green and blue; partial range expands luma first."""
    b, r = cb - 128.0, cr - 128.0
    if partial:
        luma = 1.16438356 * (y - 16.0)
        parts = (luma + 1.59602678 * r, luma - 0.39176229 * b - 0.81296764 * r, luma + 2.01723214 * b)
    else:
        luma = y.cast("double")
        parts = (luma + 1.402 * r, luma - 0.344136 * b - 0.714136 * r, luma + 1.772 * b)
    return F.struct(*(F.least(F.greatest(p, F.lit(0.0)), F.lit(255.0)).cast("int").alias(n) for p, n in zip(parts, "rgb")))


def display(samples: Column, photometric: Column, center: Column, width: Column, function: str = "linear", voi: Column | None = None, voi_first: Column | None = None, voi_bits: Column | None = None) -> Column:
    """Monochrome samples as 0..255: the window where there is one, else the VOI table, else minimum to maximum; MONOCHROME1 is inverted."""
    shown = min_max(samples)
    if voi is not None:
        top = F.pow(F.lit(2), voi_bits) - 1
        shown = F.when(voi.isNotNull(), F.transform(samples, lambda v: (lut(v, voi, voi_first) * 255.0 / top).cast("int"))).otherwise(shown)
    shown = F.when(center.isNotNull() & width.isNotNull(), F.transform(samples, lambda v: window(v, center, width, function))).otherwise(shown)
    return F.when(photometric == "MONOCHROME1", F.transform(shown, lambda v: 255 - v)).otherwise(shown)


def integer_kind(low: Column, high: Column) -> Column:
    """The smallest integer kind for a range, unsigned ones first."""
    kind = F.when(low.isNull() | high.isNull(), F.lit(None))
    for bits in (8, 16, 32):
        kind = kind.when((low >= 0) & (high < 2**bits), f"uint{bits}")
    kind = kind.when(low >= 0, "uint64")
    for bits in (8, 16, 32):
        kind = kind.when((low >= -(2 ** (bits - 1))) & (high < 2 ** (bits - 1)), f"int{bits}")
    return kind.otherwise("int64")


def keeps_integers(slope: Column, intercept: Column, tolerance: float = 1e-6) -> Column:
    return (F.abs(slope - 1) <= tolerance) & (F.abs(intercept - F.round(intercept)) <= tolerance)
