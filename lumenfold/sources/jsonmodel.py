"""Whole records as the JSON model and back (SRC-13, SNK-7, JSN-1..16)."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import UID_PATTERN
from ..functions.tags import CHARSET_VRS, STRING_VRS, lookup
from . import charset as text
from . import p10
from .batches import batched, spread

BULK_VRS = frozenset("OB OD OF OL OV OW UN".split())
GROUPS = ("Alphabetic", "Ideographic", "Phonetic")
#: Media types of pixel data by the start of a transfer syntax (fixed values); the longest match counts.
MEDIA = {
    "1.2.840.10008.1.2.5": "image/dicom-rle", "1.2.840.10008.1.2.4.5": "image/jpeg", "1.2.840.10008.1.2.4.6": "image/jpeg", "1.2.840.10008.1.2.4.7": "image/jpeg", "1.2.840.10008.1.2.4.80": "image/jls",
    "1.2.840.10008.1.2.4.81": "image/jls", "1.2.840.10008.1.2.4.90": "image/jp2", "1.2.840.10008.1.2.4.91": "image/jp2", "1.2.840.10008.1.2.4.92": "image/jpx", "1.2.840.10008.1.2.4.93": "image/jpx",
    "1.2.840.10008.1.2.4.100": "video/mpeg", "1.2.840.10008.1.2.4.101": "video/mpeg", "1.2.840.10008.1.2.4.102": "video/mp4", "1.2.840.10008.1.2.4.103": "video/mp4", "1.2.840.10008.1.2.4.104": "video/mp4",
    "1.2.840.10008.1.2.4.105": "video/mp4", "1.2.840.10008.1.2.4.106": "video/mp4", "1.2.840.10008.1.2.4.107": "video/mp4", "1.2.840.10008.1.2.4.108": "video/mp4",
    "1.2.840.10008.1.2.4.11": "image/jxl", "1.2.840.10008.1.2.4.20": "image/jphc",
}


def media_type(syntax: str, pixels: bool) -> str:
    found = max((k for k in MEDIA if syntax.startswith(k)), key=len, default=None) if pixels else None
    return MEDIA[found] if found else "application/octet-stream"


def uri_of(template: str, names: dict[str, str | None]) -> str:
    """The template with `{study}`, `{series}`, `{instance}` and `{tag}` filled in; Broken for other names, missing UIDs and unmatched braces."""
    out = re.sub(r"\{([^{}]*)\}", lambda m: "\0" + m[1] + "\0", template)
    if "{" in out or "}" in out:
        raise p10.Broken("unmatched brace")

    def fill(m: re.Match) -> str:
        if m[1] not in names or names[m[1]] is None:
            raise p10.Broken(f"no {m[1]} for the template")
        return names[m[1]]

    return re.sub("\0([^\0]*)\0", fill, out)


def _name(value: str) -> dict | None:
    parts = dict(zip(GROUPS, value.split("=")))
    return {k: v for k, v in parts.items() if v} or None


def _number(token: str):
    try:
        return int(token)
    except ValueError:
        try:
            x = float(token)
        except ValueError:
            return token
        return x if math.isfinite(x) else token


def write(content: bytes, mode: str = "inline", threshold: int = 1024, template: str | None = None, pixel_template: str | None = None) -> tuple[str, list[tuple]]:
    """(JSON text, bulk parts) of a record: parts are (path, frame, uri, media type, bytes).

    mode `inline` keeps all bytes as base64, `uri` moves values of at least `threshold` bytes to a templated URI, `omit` leaves their bytes out. Group
    lengths and group 0002 are left out. Encapsulated pixels have a part for each fragment. A URI given twice is an error.
    """
    parser = p10.Parser(content)
    found = list(parser.elements())
    if parser.error:
        raise p10.Broken(parser.error)
    uid = {n: next(((e.raw or b"").decode("latin-1").strip("\0 ") for e in found if not e.depth and e.tag == t and e.raw), None) for n, t in (("study", 0x0020000D), ("series", 0x0020000E), ("instance", 0x00080018))}
    parts: list[tuple] = []
    root: dict = {}
    at: dict[str, dict] = {"": root}
    sequences: dict[str, list] = {}
    for e in found:
        if e.tag & 0xFFFF == 0 or e.tag >> 16 == 2:
            continue
        if e.parent not in at:
            owner, _, number = e.parent.rpartition(".")
            while len(sequences[owner]) <= int(number):
                sequences[owner].append({})
            at[e.parent] = sequences[owner][int(number)]
        out = at[e.parent][e.tag_hex] = {"vr": e.vr}
        if e.vr == "SQ":
            sequences[e.path] = out["Value"] = []
        elif e.vr in BULK_VRS:
            blocks = e.fragments[1:] if e.fragments else [e.raw or b""]
            size = sum(map(len, blocks))
            if not size:
                continue
            if mode == "inline" or size < threshold and not e.fragments:
                out["InlineBinary"] = base64.b64encode(b"".join(blocks)).decode()
            elif mode == "uri":
                pixels = e.tag in (0x7FE00008, 0x7FE00009, 0x7FE00010)
                uri = uri_of((pixels and pixel_template) or template or "", uid | {"tag": e.path})
                out["BulkDataURI"] = uri
                kind = media_type(parser.syntax, pixels)
                parts += [(e.path, k, f"{uri}/frames/{k + 1}", kind, b) for k, b in enumerate(blocks)] if e.fragments else [(e.path, None, uri, kind, blocks[0])]
        elif e.vr in STRING_VRS:
            value = text.decode(e.raw or b"", e.charset, "replace_fffd", b"\\^=" if e.vr == "PN" else b"\\") if e.vr in CHARSET_VRS else (e.raw or b"").decode("latin-1")
            if value is None:
                value = (e.raw or b"").decode("latin-1")
            tokens = [value.rstrip("\0 ")] if e.vr in ("LT", "ST", "UT", "UR") else [v.strip("\0 ") for v in value.split("\\")]
            if tokens != [""]:
                out["Value"] = [None if v == "" else _name(v) if e.vr == "PN" else _number(v) if e.vr in ("DS", "IS") else v for v in tokens]
        elif (values := p10.numbers(e.raw or b"", e.vr)) is not None and len(values):
            out["Value"] = [f"{v:08X}" for v in values.tolist()] if e.vr == "AT" else [v if not isinstance(v, float) or math.isfinite(v) else str(v) for v in values.tolist()]
    uris = [p[2] for p in parts]
    if len(set(uris)) != len(uris):
        raise p10.Broken("a URI is given twice")
    return json.dumps({k: v for k, v in sorted(root.items())}, ensure_ascii=False, separators=(",", ":")), parts


def inferred(tag_hex: str, node: dict) -> str:
    """A node's VR: its own, the dictionary's, or what its values look like."""
    if node.get("vr"):
        return node["vr"]
    if known := lookup(tag_hex):
        return known[1]
    some = [v for v in node.get("Value") or [] if v is not None]
    first = some[0] if some else None
    if "InlineBinary" in node or "BulkDataURI" in node:
        return "UN"
    if some and all(isinstance(v, str) and len(v) <= 64 and re.fullmatch(UID_PATTERN, v) for v in some):
        return "UI"
    if isinstance(first, dict):
        return "PN" if set(first) <= set(GROUPS) and first else "SQ"
    if int(tag_hex[3], 16) % 2:
        return "UN"
    return "LO" if isinstance(first, str) else "FD" if isinstance(first, float) else "SL" if isinstance(first, int) and not isinstance(first, bool) else "UN"


def read(body: str) -> list[tuple[list[tuple], list[tuple]]]:
    """[(rows as `p10.write` takes them, bulk references)] of a JSON object or an array of them; references are (path, frame, uri).

    The last of equal keys counts. A list of URIs is a list of frames; an encapsulated value whose NumberOfFrames is over 1 gets a reference a frame.
    """
    data = json.loads(body)
    return [_dataset(d, "", d) for d in (data if isinstance(data, list) else [data])]


def _dataset(node: dict, prefix: str, root: dict) -> tuple[list[tuple], list[tuple]]:
    if not isinstance(node, dict):
        raise p10.Broken("a dataset is an object")
    rows, refs = [], []
    for key in sorted(node):
        if not re.fullmatch(r"[0-9A-Fa-f]{8}", key):
            raise p10.Broken(f"bad tag {key}")
        vr, value, tag_hex = inferred(key.upper(), node[key]), node[key].get("Value") or [], key.upper()
        path = prefix + tag_hex
        if vr == "SQ":
            items = []
            for k, item in enumerate(value):
                below, more = _dataset(item or {}, f"{path}.{k}.", root)
                items.append(below)
                refs += more
            rows.append((int(key, 16), vr, items))
            continue
        if "BulkDataURI" in node[key]:
            uri = node[key]["BulkDataURI"]
            if isinstance(uri, list):
                refs += [(path, k, u) for k, u in enumerate(uri)]
            else:
                n = (root.get("00280008", {}).get("Value") or [1])[0]
                refs += [(path, k, f"{uri}/frames/{k + 1}") for k in range(int(n))] if tag_hex == "7FE00010" and int(n) > 1 else [(path, None, uri)]
            rows.append((int(key, 16), vr, b""))
        elif "InlineBinary" in node[key]:
            rows.append((int(key, 16), vr, base64.b64decode(node[key]["InlineBinary"], validate=True)))
        elif vr == "AT":
            rows.append((int(key, 16), vr, b"".join(int(v[k : k + 4], 16).to_bytes(2, "little") for v in value for k in (0, 4))))
        elif vr in p10.NUMBERS:
            rows.append((int(key, 16), vr, _packed(vr, value, path)))
        elif vr == "PN":
            rows.append((int(key, 16), vr, "\\".join("=".join((v or {}).get(g, "") for g in GROUPS).rstrip("=") if not isinstance(v, str) else v for v in value)))
        else:
            rows.append((int(key, 16), vr, "\\".join("" if v is None else v if isinstance(v, str) else repr(v) for v in value)))
    return rows, refs


def _packed(vr: str, value: list, path: str) -> bytes:
    kind = np.dtype("<" + p10.NUMBERS[vr])
    if kind.kind == "f":
        return np.array([float(v) for v in value], kind).tobytes()
    low, high = np.iinfo(kind).min, np.iinfo(kind).max
    if any(isinstance(v, (bool, float)) and not float(v).is_integer() or not low <= int(v) <= high for v in value):
        raise p10.Broken(f"{path} has a number out of range")
    return np.array([int(v) for v in value], kind).tobytes()


def to_json(records: DataFrame, **options) -> DataFrame:
    """(instance_id, json, parts, error) of (instance_id, content); a record that can't be written has a null text and its error."""
    kind = "instance_id string, json string, parts array<struct<path:string,frame:int,uri:string,media_type:string,content:binary>>, error string"
    return records.select("instance_id", "content").mapInArrow(_worker(kind, lambda content: _written(content, options)), kind)


def _written(content: bytes, options: dict) -> list[tuple]:
    body, parts = write(content, **options)
    return [(body, [dict(zip(("path", "frame", "uri", "media_type", "content"), p)) for p in parts])]


def from_json(texts: DataFrame) -> DataFrame:
    """(instance_id, item, content, refs, error) of (instance_id, json): each dataset as an explicit little-endian record with its open bulk references."""
    kind = "instance_id string, item int, content binary, refs array<struct<path:string,frame:int,uri:string>>, error string"
    out = texts.select("instance_id", F.col("json").cast("binary").alias("content"))
    return spread(out).mapInArrow(_worker(kind, _read), kind)


def _read(content: bytes) -> list[tuple]:
    return [(k, p10.write([*rows, (0x00080005, "CS", "ISO_IR 192")] if not any(r[0] == 0x00080005 for r in rows) else [(t, v, "ISO_IR 192") if t == 0x00080005 else (t, v, x) for t, v, x in rows]), [dict(zip(("path", "frame", "uri"), r)) for r in refs]) for k, (rows, refs) in enumerate(read(content.decode()))]


def _worker(kind: str, make):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, (row for batch in batches for instance, content in zip(batch.column(0).to_pylist(), batch.column(1)) for row in rows(instance, content)))

    def rows(instance: str, content: pa.Scalar) -> list[tuple]:
        try:
            return [(instance, *r, None) for r in make(content.as_py() or b"")]
        except (p10.Broken, ValueError, KeyError, TypeError, AttributeError) as e:
            return [(instance, *[None] * (len(schema) - 2), str(e))]

    return run


def with_bulk(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """References (instance_id, path, frame, uri) with the content of the part of the same path and frame, else null."""
    p = parts.select("instance_id", "path", F.col("frame").alias("_frame"), "content")
    same = (F.col("r.instance_id") == F.col("p.instance_id")) & (F.col("r.path") == F.col("p.path")) & F.col("r.frame").eqNullSafe(F.col("p._frame"))
    return refs.alias("r").join(p.alias("p"), same, "left").select("r.*", "p.content")
