"""Binary records to element rows and back (SRC-1..11, SNK-1/2, COE-5/6, COD-1/2, TXT-1..3).

The parser keeps what it has read when a record is broken, and says why in `error`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.tags import BINARY_VRS, STRING_VRS, lookup

LONG_VRS = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
KNOWN_VRS = frozenset([*STRING_VRS, *BINARY_VRS, "SQ"])
NUMBERS = {"US": "u2", "SS": "i2", "UL": "u4", "SL": "i4", "UV": "u8", "SV": "i8", "FL": "f4", "FD": "f8"}
SWAPPED = {"US": 2, "SS": 2, "OW": 2, "AT": 2, "UL": 4, "SL": 4, "FL": 4, "OF": 4, "OL": 4, "FD": 8, "OD": 8, "OV": 8, "SV": 8, "UV": 8}
UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END, PIXELS = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010
IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
#: Defined terms and Python's codecs for them (fixed values).
CHARSETS = {
    "": "ascii", "ISO_IR 6": "ascii", "ISO_IR 100": "iso8859-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5",
    "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9", "ISO_IR 203": "iso8859-15", "ISO_IR 166": "tis-620",
    "ISO_IR 13": "shift_jis", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk",
}


@dataclass
class Element:
    path: str
    parent: str
    depth: int
    item: int | None
    tag: int
    vr: str
    length: int
    raw: bytes | None
    charset: str = ""
    fragments: list[bytes] = field(default_factory=list)

    @property
    def tag_hex(self) -> str:
        return f"{self.tag:08X}"


class Broken(ValueError):
    pass


@dataclass
class Fragments:
    """Encapsulated frames to be written: one fragment each, after a basic offset table."""

    frames: list[bytes]


def nested(found: list[Element]) -> list[tuple]:
    """(tag, vr, value) rows as `write` takes them, from elements in preorder: the value of a sequence is its items' rows."""
    root: list[tuple] = []
    items: dict[str, list[tuple]] = {"": root}
    values: dict[str, list] = {}
    for e in found:
        if e.parent not in items:
            owner, _, number = e.parent.rpartition(".")
            while len(values[owner]) <= int(number):
                values[owner].append([])
            items[e.parent] = values[owner][int(number)]
        value: object = e.raw
        if e.vr == "SQ":
            value = values[e.path] = []
        elif e.fragments:
            value = Fragments(e.fragments[1:])
        items[e.parent].append((e.tag, e.vr, value if value is not None else b""))
    return root


def decode_text(raw: bytes, charset: str, policy: str = "strict") -> str | None:
    """strict: null on a bad byte; replace_fffd; replace_hex_escape: each bad byte as (0xHH)."""
    codec = CHARSETS.get(charset.strip())
    if codec is None:
        return None
    if policy == "replace_fffd":
        return raw.decode(codec, "replace")
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        if policy != "replace_hex_escape":
            return None
    out, at = "", 0
    while at < len(raw):
        try:
            return out + raw[at:].decode(codec)
        except UnicodeDecodeError as e:
            out += raw[at : at + e.start].decode(codec) + f"(0x{raw[at + e.start]:02X})"
            at += e.start + 1
    return out


def numbers(raw: bytes, vr: str) -> np.ndarray | None:
    """Little-endian values; null if the length is no multiple of the width, empty for no bytes."""
    if vr == "AT":
        pairs = np.frombuffer(raw, "<u2") if len(raw) % 4 == 0 else None
        return None if pairs is None else pairs[::2].astype(np.int64) << 16 | pairs[1::2]
    kind = NUMBERS.get(vr)
    if kind is None or len(raw) % int(kind[1]):
        return None
    return np.frombuffer(raw, "<" + kind)


class Parser:
    """Elements of one record in preorder, by recursive descent over the bytes."""

    def __init__(self, data: bytes, load_until: int | None = None, wanted: dict | None = None):
        """wanted: a tree of tags; other elements are skipped over, not decoded, at every depth."""
        self.data, self.load_until, self.wanted, self.syntax, self.error = data, load_until, wanted, IMPLICIT, None

    def elements(self) -> Iterator[Element]:
        try:
            start = 132 if self.data[128:132] == b"DICM" else 0
            at, meta = start, []
            while self.data[at : at + 2] == b"\x02\x00":
                e, at = self._element(at, len(self.data), True, "", "", 0, None, "")
                meta += e
                if e[0].tag == 0x00020010:
                    self.syntax = e[0].raw.rstrip(b"\0 ").decode("ascii", "replace")
            yield from meta if self.wanted is None else (e for e in meta if e.tag in self.wanted)
            body = self.data[at:]
            if not meta:
                self.syntax = EXPLICIT if body[4:6].decode("latin-1") in KNOWN_VRS else IMPLICIT
            if self.syntax == DEFLATED:
                body = zlib.decompress(body, -15)
            self.data, self.big = body, self.syntax == BIG_ENDIAN
            yield from self._dataset(0, len(body), self.syntax != IMPLICIT, "", 0, None, "", self.wanted)
        except (Broken, zlib.error, struct.error, UnicodeDecodeError) as e:
            self.error = str(e)

    big = False

    def _u(self, at: int, size: int) -> int:
        if at + size > len(self.data):
            raise Broken(f"ends at byte {len(self.data)} within an element")
        return int.from_bytes(self.data[at : at + size], "big" if self.big else "little")

    def _tag(self, at: int) -> int:
        return self._u(at, 2) << 16 | self._u(at + 2, 2)

    def _dataset(self, at: int, end: int, explicit: bool, parent: str, depth: int, item: int | None, charset: str, wanted: dict | None = None) -> Iterator[Element]:
        last = -1
        self.at = at
        while self.at + 8 <= end:
            if not any(self.data[self.at : self.at + 8]):
                return  # a tail of zeros
            tag = self._tag(self.at)
            if tag in (ITEM_END, SEQUENCE_END) or depth and tag < last:
                return
            if self.load_until is not None and not depth and tag > self.load_until:
                return
            known = wanted is None or tag in wanted
            if not known and tag != 0x00080005 and (beyond := self._beyond(self.at, end, explicit)) is not None:
                self.at, last = beyond, tag
                continue
            found, self.at = self._element(self.at, end, explicit, parent, f"{parent}{tag:08X}", depth, item, charset, None if wanted is None else wanted.get(tag, {}))
            last = tag
            if tag == 0x00080005:
                charset = found[0].raw.decode("latin-1").strip("\0 ")
            if known:
                yield from found

    def _beyond(self, at: int, end: int, explicit: bool) -> int | None:
        """Where the next element begins, from this one's head alone; null if its length is not defined."""
        vr = self.data[at + 4 : at + 6].decode("latin-1") if explicit else ""
        wide = explicit and (vr in LONG_VRS or vr not in KNOWN_VRS)
        length, head = (self._u(at + 8, 4), 12) if wide else (self._u(at + 6, 2), 8) if explicit else (self._u(at + 4, 4), 8)
        if length == UNDEFINED:
            return None
        if at + head + length > end:
            raise Broken(f"{self._tag(at):08X} has {length} bytes, {end - at - head} are left")
        return at + head + length

    def _element(self, at: int, end: int, explicit: bool, parent: str, path: str, depth: int, item: int | None, charset: str, wanted: dict | None = None) -> tuple[list[Element], int]:
        tag = self._tag(at)
        vr, head = "UN", 8
        if explicit:
            vr = self.data[at + 4 : at + 6].decode("latin-1")
            if vr in LONG_VRS or vr not in KNOWN_VRS:
                length, head = self._u(at + 8, 4), 12
            else:
                length = self._u(at + 6, 2)
        else:
            vr = (lookup(f"{tag:08X}") or ("", "UN"))[1]
            length = self._u(at + 4, 4)
        at += head
        own = Element(path or f"{tag:08X}", parent.rstrip("."), depth, item, tag, vr, length, None, charset)
        if length == UNDEFINED and tag == PIXELS:
            while (t := self._tag(at)) == ITEM:
                n = self._u(at + 4, 4)
                own.fragments.append(self.data[at + 8 : at + 8 + n])
                at += 8 + n
            return [own], at + 8 if t == SEQUENCE_END else at
        if vr == "SQ" or length == UNDEFINED:
            own.vr = "SQ"
            stop = end if length == UNDEFINED else min(end, at + length)
            out, k = [own], 0
            while at + 8 <= stop and (t := self._tag(at)) == ITEM:
                n = self._u(at + 4, 4)
                inner = stop if n == UNDEFINED else min(stop, at + 8 + n)
                out += self._dataset(at + 8, inner, explicit and vr != "UN", f"{own.path}.{k}.", depth + 1, k, charset, wanted)
                at = inner
                if n == UNDEFINED:
                    at = self.at + 8 if self.at + 8 <= len(self.data) and self._tag(self.at) == ITEM_END else self.at
                k += 1
            if length == UNDEFINED and at + 8 <= stop and self._tag(at) == SEQUENCE_END:
                at += 8
            return out, at
        if at + length > end:
            raise Broken(f"{own.tag_hex} has {length} bytes, {end - at} are left")
        own.raw = self.data[at : at + length]
        if self.big and vr in SWAPPED and length % SWAPPED[vr] == 0:
            own.raw = np.frombuffer(own.raw, f">u{SWAPPED[vr]}").astype(f"<u{SWAPPED[vr]}").tobytes()
        return [own], at + length


def is_record(head: bytes) -> bool:
    """Whether up to 1024 bytes look like a record: at least three elements of even groups with tags that don't fall."""
    for explicit in (True, False):
        p = Parser(head[132:1024] if head[128:132] == b"DICM" else head[:1024])
        at, last, n = 0, -1, 0
        try:
            while n < 3:
                found, at = p._element(at, 1 << 40, explicit, "", "", 0, None, "")
                tag = found[0].tag
                if tag <= last or tag >> 16 & 1 or explicit and found[0].vr not in KNOWN_VRS or not explicit and found[0].vr == "UN":
                    break
                last, n = tag, n + 1
            if n == 3:
                return True
        except (Broken, UnicodeDecodeError):
            continue
    return False


def write(elements: list[tuple[int, str, object]], syntax: str = EXPLICIT, preamble: bool = True) -> bytes:
    """A record of (tag, vr, value) rows: bytes, text, numbers, or for SQ a list of such lists. Group 0002 is built anew."""
    body = b"".join(_encode(*e, explicit=syntax != IMPLICIT, big=syntax == BIG_ENDIAN) for e in sorted(elements, key=lambda e: e[0]) if e[0] >> 16 != 2)
    if syntax == DEFLATED:
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(body) + packer.flush()
    by_tag = {e[0]: e[2] for e in elements}
    meta = [(0x00020001, "OB", b"\0\1"), (0x00020002, "UI", by_tag.get(0x00080016, "")), (0x00020003, "UI", by_tag.get(0x00080018, "")), (0x00020010, "UI", syntax)]
    rest = b"".join(_encode(*e, explicit=True, big=False) for e in meta)
    return (bytes(128) + b"DICM") * preamble + _encode(0x00020000, "UL", [len(rest)], True, False) + rest + body


def _encode(tag: int, vr: str, value: object, explicit: bool, big: bool) -> bytes:
    order = ">" if big else "<"
    if vr == "SQ":
        raw = b"".join(struct.pack(order + "HHI", 0xFFFE, 0xE000, len(x)) + x for x in (b"".join(_encode(*e, explicit=explicit, big=big) for e in sorted(item, key=lambda e: e[0])) for item in value))
    elif isinstance(value, Fragments):
        padded = [f + b"\0" * (len(f) % 2) for f in value.frames]
        starts = np.cumsum([0, *(8 + len(f) for f in padded)])[:-1].astype("<u4").tobytes()
        raw = b"".join(struct.pack(order + "HHI", 0xFFFE, 0xE000, len(x)) + x for x in (starts, *padded)) + struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0)
        return struct.pack(order + "HH", tag >> 16, tag & 0xFFFF) + vr.encode() + b"\0\0" + struct.pack(order + "I", UNDEFINED) + raw
    elif isinstance(value, bytes):
        raw = value
        if big and vr in SWAPPED and len(raw) % SWAPPED[vr] == 0:
            raw = np.frombuffer(raw, f"<u{SWAPPED[vr]}").astype(f">u{SWAPPED[vr]}").tobytes()
    elif isinstance(value, str):
        raw = value.encode()
    else:
        if vr not in NUMBERS:
            raise Broken(f"{vr} of {tag:08X} holds bytes only")
        raw = np.asarray(value, order + NUMBERS[vr]).tobytes()
    raw += (b"\0" if vr in BINARY_VRS or vr == "UI" else b" ") * (len(raw) % 2)
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack(order + "I", len(raw)) + raw
    if vr in LONG_VRS:
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", len(raw)) + raw
    if len(raw) > 0xFFFE:
        raise Broken(f"{vr} of {tag:08X} holds at most 65534 bytes, not {len(raw)}")
    return head + vr.encode() + struct.pack(order + "H", len(raw)) + raw


def rle_decode(frame: bytes, samples: int, width: int) -> bytes:
    """One frame of little-endian samples, channel after channel, from its byte segments (most significant first)."""
    head = struct.unpack("<16I", frame[:64])
    count, offsets = head[0], [*head[1 : head[0] + 1], len(frame)]
    if not 1 <= count <= 15 or offsets[0] < 64 or any(a > b for a, b in zip(offsets, offsets[1:])):
        raise Broken("bad RLE header")
    planes = []
    for a, b in zip(offsets, offsets[1:]):
        out, at = bytearray(), a
        while at < b and len(out) < samples:
            n = frame[at]
            if n < 128:
                out += frame[at + 1 : at + 2 + n]
                at += n + 2
            elif n > 128:
                out += frame[at + 1 : at + 2] * (257 - n)
                at += 2
            else:
                at += 1
        if len(out) < samples:
            raise Broken("short RLE segment")
        planes.append(np.frombuffer(bytes(out[:samples]), np.uint8))
    if len(planes) % width:
        raise Broken("segments don't make samples")
    return b"".join(np.stack(planes[k : k + width][::-1], axis=1).tobytes() for k in range(0, len(planes), width))


def rle_encode(channels: list[np.ndarray]) -> bytes:
    """The inverse, for one array of unsigned samples a channel."""
    segments = []
    for x in channels:
        planes = np.frombuffer(x.astype(f"<u{x.itemsize}").tobytes(), np.uint8).reshape(-1, x.itemsize)
        for k in range(x.itemsize - 1, -1, -1):
            plane, out = planes[:, k].tobytes(), bytearray()
            at = 0
            while at < len(plane):
                run = 1
                while run < 128 and at + run < len(plane) and plane[at + run] == plane[at]:
                    run += 1
                if run > 1:
                    out += bytes((257 - run, plane[at]))
                    at += run
                else:
                    end = at + 1
                    while end < len(plane) and end - at < 128 and not plane[end] == plane[min(end + 1, len(plane) - 1)] == plane[end - 1]:
                        end += 1
                    out += bytes((end - at - 1,)) + plane[at:end]
                    at = end
            segments.append(bytes(out) + b"\0" * (len(out) % 2))
    offsets, at = [], 64
    for s in segments:
        offsets.append(at)
        at += len(s)
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)
