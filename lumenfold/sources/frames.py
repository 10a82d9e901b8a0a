"""Frames of pixel data: layout, offset tables, decoding, transcoding (SRC-10/14, SNK-3/5, COD-1/2/8..13, API-1/6..9)."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.pixels import expand_segments, table_entries
from . import jpeg, p10
from .batches import batched

RLE = "1.2.840.10008.1.2.5"
NATIVE = (p10.IMPLICIT, p10.EXPLICIT, p10.DEFLATED, p10.BIG_ENDIAN)
#: Pixel elements and the type of samples that aren't integers.
PIXEL_TAGS = {0x7FE00008: "f4", 0x7FE00009: "f8", 0x7FE00010: None}
FRAMES = "instance_id string, frame int, n_frames int, n_rows int, n_columns int, samples_per_pixel int, photometric string, sample_type string, samples binary, error string"
#: Where a frame of a video or still codec starts or ends within fragments (fixed values).
MARKERS = {"jpeg_end": b"\xff\xd9", "h264_start": b"\0\0\1", "mpeg2_sequence": b"\0\0\1\xb3", "jxl_start": b"\xff\x0a"}


@dataclass
class Layout:
    rows: int
    columns: int
    samples: int
    bits: int
    signed: bool
    planar: bool
    frames: int
    photometric: str
    kind: str

    @property
    def frame_bytes(self) -> int:
        n = self.rows * self.columns * self.samples
        return (n + 7) // 8 if self.bits == 1 else n * (self.bits // 8)


def layout(found: dict[int, p10.Element], pixels: int) -> Layout:
    """Of root elements by tag. Missing rows, columns or bits are errors; other parts have the standard's defaults."""

    def number(tag: int, default: int | None) -> int:
        e = found.get(tag)
        if e is None or not e.raw:
            if default is None:
                raise p10.Broken(f"no {tag:08X}")
            return default
        if e.vr == "IS":
            return int(e.raw.strip(b"\0 "))
        return int(p10.numbers(e.raw, e.vr)[0])

    special = PIXEL_TAGS[pixels]
    bits = number(0x00280100, None) if special is None else int(special[1]) * 8
    if special is None and bits not in (1, 8, 16, 32, 64):
        raise p10.Broken(f"{bits} bits a sample")
    signed = bool(number(0x00280103, 0))
    photometric = (found[0x00280004].raw or b"").decode("latin-1").strip("\0 ") if 0x00280004 in found else "MONOCHROME2"
    kind = special or ("u1" if bits == 1 else f"{'i' if signed else 'u'}{bits // 8}")
    return Layout(number(0x00280010, None), number(0x00280011, None), number(0x00280002, 1), bits, signed, bool(number(0x00280006, 0)), max(1, number(0x00280008, 1)), photometric, kind)


def split_fragments(fragments: list[bytes], frames: int, marker: bytes | None = MARKERS["jpeg_end"]) -> list[bytes]:
    """Frames of fragments, the first of which is the basic offset table.

    The table decides where there is one; else there is one frame, or a fragment is a frame, or frames end with the fragment that ends in the marker.
    """
    table, body = struct.unpack(f"<{len(fragments[0]) // 4}I", fragments[0][: len(fragments[0]) // 4 * 4]), fragments[1:]
    if table:
        if any(a >= b for a, b in zip(table, table[1:])):
            raise p10.Broken("offsets fall")
        starts, at = [], 0
        for f in body:
            starts.append(at)
            at += 8 + len(f)
        if not set(table) <= set(starts):
            raise p10.Broken("an offset is not a fragment's")
        edges = [starts.index(o) for o in table] + [len(body)]
        return [b"".join(body[a:b]) for a, b in zip(edges, edges[1:])]
    if frames == 1:
        return [b"".join(body)]
    if len(body) == frames:
        return body
    out: list[list[bytes]] = [[]]
    for f in body:
        out[-1].append(f)
        if marker is not None and f.rstrip(b"\0").endswith(marker):
            out.append([])
    done = [b"".join(x) for x in out if x]
    if len(done) != frames:
        raise p10.Broken(f"{len(body)} fragments don't make {frames} frames")
    return done


def _native(frame: bytes, at: Layout) -> bytes:
    """Interleaved little-endian samples; single bits become bytes."""
    n = at.rows * at.columns * at.samples
    if at.bits == 1:
        return np.unpackbits(np.frombuffer(frame, np.uint8), bitorder="little")[:n].tobytes()
    if len(frame) < at.frame_bytes:
        raise p10.Broken(f"a frame has {len(frame)} of {at.frame_bytes} bytes")
    x = np.frombuffer(frame[: at.frame_bytes], f"<{at.kind}")
    return (x.reshape(at.samples, -1).T if at.planar and at.samples > 1 else x).tobytes()


def _rle(frame: bytes, at: Layout) -> bytes:
    planes = np.frombuffer(p10.rle_decode(frame, at.rows * at.columns, at.bits // 8), f"<{at.kind}")
    return planes.reshape(at.samples, -1).T.tobytes()


#: Decoders of encapsulated frames by transfer syntax; others can be registered: (frame, layout) to interleaved samples.
DECODERS: dict[str, Callable[[bytes, Layout], bytes]] = {RLE: _rle, jpeg.LOSSLESS: jpeg.decoded, jpeg.FIRST_ORDER: jpeg.decoded}


def register(uid: str, decode: Callable[[bytes, Layout], bytes] | None) -> None:
    """Sets or, with None, removes the decoder of a transfer syntax."""
    if decode is None:
        DECODERS.pop(uid, None)
    else:
        DECODERS[uid] = decode


def frames_of(content: bytes, decoders: dict | None = None) -> Iterator[tuple[int, Layout, bytes]]:
    """(frame, layout, samples) of a record; Broken if it has no pixels, is cut off or its syntax has no decoder."""
    parser = p10.Parser(content)
    root = {e.tag: e for e in parser.elements() if not e.depth}
    pixels = next((t for t in PIXEL_TAGS if t in root), None)
    if pixels is None:
        raise p10.Broken(parser.error or "no pixel data")
    at, e = layout(root, pixels), root[pixels]
    if e.fragments:
        decode = (DECODERS if decoders is None else decoders).get(parser.syntax)
        parts = split_fragments(e.fragments, at.frames)
        if decode is None and parser.syntax == "1.2.840.10008.1.2.1.98":
            decode = _native
        if decode is None:
            raise p10.Broken(f"no decoder for {parser.syntax}")
        for k, part in enumerate(parts):
            yield k, at, decode(part, at)
        return
    raw = e.raw or b""
    if at.bits == 1:  # frames of single bits follow without padding
        n, every = at.rows * at.columns * at.samples, np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        if len(every) < n * at.frames:
            raise p10.Broken("pixel data is short")
        for k in range(at.frames):
            yield k, at, every[k * n : (k + 1) * n].tobytes()
        return
    for k in range(at.frames):
        yield k, at, _native(raw[k * at.frame_bytes : (k + 1) * at.frame_bytes], at)


def frames(records: DataFrame) -> DataFrame:
    """A row per frame of (instance_id, content), with interleaved little-endian samples. A record that can't be decoded gives one row with its error.

    Frames leave the worker in batches of a few MB, so memory holds one record and these.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, decoders = to_arrow_schema(StructType.fromDDL(FRAMES)), dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (row for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1)) for row in rows(instance, content)))

    def rows(instance: str, content: pa.Scalar) -> Iterator[tuple]:
        try:
            for k, at, samples in frames_of(content.as_py() or b"", decoders):
                yield instance, k, at.frames, at.rows, at.columns, at.samples, at.photometric, at.kind, samples, None
        except (p10.Broken, ValueError, struct.error, KeyError, IndexError) as e:
            yield instance, *[None] * 8, str(e)

    return records.select("instance_id", "content").mapInArrow(run, FRAMES)


def sample_array(row_samples: bytes, sample_type: str, rows: int, columns: int, samples: int) -> np.ndarray:
    """A frame's samples as (rows, columns) or (rows, columns, samples)."""
    x = np.frombuffer(row_samples, f"<{sample_type}")
    return x.reshape(rows, columns) if samples == 1 else x.reshape(rows, columns, samples)


def transcode(content: bytes, syntax: str) -> bytes:
    """The record written anew with another transfer syntax: native ones, RLE and lossless JPEG. Lossy history stays; RLE has separate colour planes."""
    parser = p10.Parser(content)
    found = list(parser.elements())
    if parser.error:
        raise p10.Broken(parser.error)
    packed = (RLE, jpeg.LOSSLESS, jpeg.FIRST_ORDER)
    if syntax not in (*NATIVE, *packed):
        raise p10.Broken(f"no encoder for {syntax}")
    rows = [r for r in p10.nested(found) if r[0] >> 16 != 2]
    at = {e.tag: e for e in found if not e.depth}
    pixels = at.get(p10.PIXELS)
    if pixels is None or (not pixels.fragments and syntax not in packed):
        return p10.write(rows, syntax)
    decoded = list(frames_of(content))
    how = decoded[0][1]
    rows = [r for r in rows if r[0] not in (p10.PIXELS, 0x00280006, 0x7FE00001, 0x7FE00002)]
    if how.samples > 1:
        rows.append((0x00280006, "US", [int(syntax == RLE)]))
    if syntax not in packed:
        body = b"".join(s for _, _, s in decoded)
        return p10.write([*rows, (p10.PIXELS, "OB" if how.bits <= 8 else "OW", body)], syntax)
    if how.bits == 1:
        raise p10.Broken("single bits have no encapsulated form")
    if syntax != RLE:
        if how.bits > 16:
            raise p10.Broken(f"lossless JPEG holds no {how.bits} bits a sample")
        made = [jpeg.encode(np.frombuffer(s, f"<u{how.bits // 8}").reshape(how.rows, how.columns, how.samples), how.bits) for _, _, s in decoded]
        return p10.write([*rows, (p10.PIXELS, "OB", p10.Fragments(made))], syntax)
    planes = [np.frombuffer(s, f"<{how.kind}").reshape(-1, how.samples).T for _, _, s in decoded]
    return p10.write([*rows, (p10.PIXELS, "OB", p10.Fragments([p10.rle_encode([c.view(f"<u{c.itemsize}") for c in map(np.ascontiguousarray, x)]) for x in planes]))], RLE)


def transcoded(records: DataFrame, syntax: str) -> DataFrame:
    """(instance_id, content, error): records in another transfer syntax; those that can't be written keep a null content and their error."""
    schema = pa.schema([("instance_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (made(instance, content) for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1))))

    def made(instance: str, content: pa.Scalar) -> tuple:
        try:
            return instance, transcode(content.as_py() or b"", syntax), None
        except (p10.Broken, ValueError, struct.error, KeyError, IndexError) as e:
            return instance, None, str(e)

    return records.select("instance_id", "content").mapInArrow(run, "instance_id string, content binary, error string")


def boundaries(data: bytes, marker: bytes) -> list[int]:
    """Positions of a codec's marker in joined fragments."""
    return [m.start() for m in re.finditer(re.escape(marker), data)]


def extended_offsets(frames: list[bytes]) -> tuple[list[int], list[int]]:
    """(offsets, lengths) of an extended offset table for one fragment a frame: lengths without padding, offsets from the first item."""
    offsets, at = [], 0
    for f in frames:
        offsets.append(at)
        at += 8 + len(f) + len(f) % 2
    return offsets, [len(f) for f in frames]


def check_extended(offsets: list[int], lengths: list[int], size: int) -> str | None:
    """What is wrong with an extended offset table over `size` bytes of items, or null."""
    if len(offsets) != len(lengths):
        return "as many offsets as lengths are needed"
    fallen = next((k for k in range(1, len(offsets)) if offsets[k] <= offsets[k - 1]), None)
    if fallen is not None:
        return f"offset {fallen} does not rise"
    for k, (o, n) in enumerate(zip(offsets, lengths)):
        end = offsets[k + 1] if k + 1 < len(offsets) else size
        if o + 8 + n + n % 2 > end:
            return f"frame {k} goes past {end}"
    return None


#: Palette descriptors and tables of the three colours and of alpha, plain and segmented (fixed values of the public standard).
PALETTES = {"r": (0x00281101, 0x00281201, 0x00281221), "g": (0x00281102, 0x00281202, 0x00281222), "b": (0x00281103, 0x00281203, 0x00281223), "a": (0x00281104, 0x00281204, 0x00281224)}
PALETTE = "instance_id string, first int, bits int, r array<int>, g array<int>, b array<int>, a array<int>, error string"


def palette_of(content: bytes) -> tuple | None:
    """(first, bits, red, green, blue, alpha) of a record's palette, expanded; null without one, alpha null where there is none. Broken for tables that don't suit their descriptors."""
    parser = p10.Parser(content, wanted={t: {} for x in PALETTES.values() for t in x} | {0x00280103: {}})
    root = {e.tag: e for e in parser.elements() if not e.depth}
    if parser.error:
        raise p10.Broken(parser.error)
    if PALETTES["r"][0] not in root:
        return None
    signed = 0x00280103 in root and bool(p10.numbers(root[0x00280103].raw, "US")[0])
    tables, heads = [], set()
    for name, (head, plain, segmented) in PALETTES.items():
        if head not in root:
            if name != "a":
                raise p10.Broken(f"no descriptor {head:08X}")
            tables.append(None)
            continue
        count, first, bits = (int(v) for v in p10.numbers(root[head].raw, "US"))
        count, first = count or 65536, first - 65536 if signed and first > 32767 else first
        if bits not in range(1, 17):
            raise p10.Broken(f"{bits} bits an entry")
        if plain in root:
            entries = table_entries(root[plain].raw or b"", count, bits)
        elif segmented in root:
            raw = root[segmented].raw or b""
            entries = expand_segments(np.frombuffer(raw, "<u2" if bits > 8 else np.uint8).tolist(), bits)
        else:
            raise p10.Broken(f"no table for {head:08X}")
        if len(entries) != count:
            raise p10.Broken(f"{len(entries)} entries, the descriptor says {count}")
        tables.append(entries)
        heads.add((first, bits))
    if len(heads) != 1:
        raise p10.Broken("descriptors differ")
    return *heads.pop(), *tables


def palettes(records: DataFrame) -> DataFrame:
    """A row per record of (instance_id, content) that has a palette, its segmented tables expanded; a broken one gives a row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PALETTE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (row for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1)) for row in rows(instance, content.as_py())))

    def rows(instance: str, content: bytes | None) -> list[tuple]:
        try:
            found = palette_of(content or b"")
            return [] if found is None else [(instance, *found, None)]
        except (p10.Broken, ValueError, struct.error, TypeError) as e:
            return [(instance, *[None] * 6, str(e))]

    return records.select("instance_id", "content").mapInArrow(run, PALETTE)


def set_pixel_data(content: bytes, frames: list[bytes], rows: int, columns: int, samples: int, sample_type: str, photometric: str) -> bytes:
    """The record with other pixels: interleaved little-endian frames. Attributes that describe them follow; tables of frame offsets and float pixels go."""
    parser = p10.Parser(content)
    found = p10.nested(list(parser.elements()))
    if parser.error:
        raise p10.Broken(parser.error)
    bits = int(sample_type[1:]) * 8
    if sample_type[0] not in "ui" or bits not in (8, 16, 32, 64):
        raise p10.Broken(f"{sample_type} is no kind of pixel sample")
    if not frames or any(len(f) != rows * columns * samples * bits // 8 for f in frames):
        raise p10.Broken("frames don't have the size that rows, columns and samples give")
    if (samples == 3) != (photometric in ("RGB", "YBR_FULL")):
        raise p10.Broken(f"{samples} samples a pixel don't suit {photometric}")
    new = [(0x00280002, "US", [samples]), (0x00280004, "CS", photometric), (0x00280010, "US", [rows]), (0x00280011, "US", [columns]), (0x00280100, "US", [bits]), (0x00280101, "US", [bits]), (0x00280102, "US", [bits - 1])]
    new.append((0x00280103, "US", [int(sample_type[0] == "i")]))
    new += [(0x00280006, "US", [0])] * (samples > 1) + [(0x00280008, "IS", str(len(frames)))] * (len(frames) > 1)
    gone = {t for t, *_ in new} | {0x00280006, 0x00280008, 0x7FE00001, 0x7FE00002, *PIXEL_TAGS}
    kept = [e for e in found if e[0] not in gone and e[0] >> 16 != 2]
    syntax = parser.syntax if parser.syntax in NATIVE else p10.EXPLICIT
    return p10.write([*kept, *new, (p10.PIXELS, "OB" if bits == 8 else "OW", b"".join(frames))], syntax)


def with_pixels(records: DataFrame, pixels: DataFrame) -> DataFrame:
    """(instance_id, content, error): records with the pixels of (instance_id, frames array<binary>, n_rows, n_columns, samples, sample_type, photometric); records without such a row stay as they are."""
    schema = pa.schema([("instance_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    names = ["frames", "n_rows", "n_columns", "samples", "sample_type", "photometric"]
    joined = records.select("instance_id", "content").join(pixels.select("instance_id", *names), "instance_id", "left").select("instance_id", "content", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (made(*(c[k].as_py() for c in batch.columns)) for batch in batches for k in range(batch.num_rows)))

    def made(instance: str, content: bytes | None, frames: list[bytes] | None, *how) -> tuple:
        if frames is None:
            return instance, content, None
        try:
            return instance, set_pixel_data(content or b"", frames, *how), None
        except (p10.Broken, ValueError, struct.error, TypeError) as e:
            return instance, None, str(e)

    return joined.mapInArrow(run, "instance_id string, content binary, error string")
