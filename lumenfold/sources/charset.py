"""Text of several character sets with escape sequences, and text back to bytes (TXT-1..6)."""

from __future__ import annotations

import re

from .p10 import CHARSETS, decode_text

#: Escape sequences of the public standard: code element, Python codec, bytes a character (fixed values).
ESCAPES = {
    b"\x1b(B": ("G0", "ascii", 1), b"\x1b(J": ("G0", "ascii", 1), b"\x1b-A": ("G1", "iso8859-1", 1), b"\x1b-B": ("G1", "iso8859-2", 1), b"\x1b-C": ("G1", "iso8859-3", 1),
    b"\x1b-D": ("G1", "iso8859-4", 1), b"\x1b-L": ("G1", "iso8859-5", 1), b"\x1b-G": ("G1", "iso8859-6", 1), b"\x1b-F": ("G1", "iso8859-7", 1), b"\x1b-H": ("G1", "iso8859-8", 1),
    b"\x1b-M": ("G1", "iso8859-9", 1), b"\x1b-b": ("G1", "iso8859-15", 1), b"\x1b)I": ("G1", "shift_jis", 1), b"\x1b-T": ("G1", "tis-620", 1),
    b"\x1b$B": ("G0", "jisx0208", 2), b"\x1b$(D": ("G0", "jisx0212", 2), b"\x1b$)C": ("G1", "euc_kr", 2), b"\x1b$)A": ("G1", "gb2312", 2),
}
#: Escape sequence of each defined term (fixed values).
TERMS = {
    "ISO 2022 IR 6": b"\x1b(B", "ISO 2022 IR 100": b"\x1b-A", "ISO 2022 IR 101": b"\x1b-B", "ISO 2022 IR 109": b"\x1b-C", "ISO 2022 IR 110": b"\x1b-D", "ISO 2022 IR 144": b"\x1b-L",
    "ISO 2022 IR 127": b"\x1b-G", "ISO 2022 IR 126": b"\x1b-F", "ISO 2022 IR 138": b"\x1b-H", "ISO 2022 IR 148": b"\x1b-M", "ISO 2022 IR 203": b"\x1b-b", "ISO 2022 IR 13": b"\x1b)I",
    "ISO 2022 IR 166": b"\x1b-T", "ISO 2022 IR 87": b"\x1b$B", "ISO 2022 IR 159": b"\x1b$(D", "ISO 2022 IR 149": b"\x1b$)C", "ISO 2022 IR 58": b"\x1b$)A",
}
_SPLIT = re.compile(rb"(\x1b(?:\$[()][A-Z]|\$[A-Z]|[()\-][A-Za-z]))")
_RUNS = re.compile(rb"[\x80-\xff]+|[\x00-\x7f]+")
_CONTROL = re.compile(rb"[\r\n\f\t]")


def terms_of(charset: str) -> list[str] | None:
    """The terms of a SpecificCharacterSet value; null for an unknown one, or for several of which one has no escape sequence.

    An empty term is the default repertoire, and is allowed only first where there are several.
    """
    terms = [t.strip(" \0") for t in charset.split("\\")]
    if len(terms) == 1:
        return terms if terms[0] in CHARSETS or terms[0] in TERMS else None
    return terms if all(t in TERMS or not k and not t for k, t in enumerate(terms)) else None


def _double(chunk: bytes, codec: str) -> str:
    if codec in ("jisx0208", "jisx0212"):
        return (b"\x1b$B" + chunk if codec == "jisx0208" else b"\x1b$(D" + chunk).decode("iso2022_jp" if codec == "jisx0208" else "iso2022_jp_2")
    return chunk.decode(codec)


def decode(raw: bytes, charset: str, policy: str = "strict", delimiters: bytes = b"\\") -> str | None:
    """Text of bytes in one or several character sets; null for an unknown set, or for bad bytes under the strict policy.

    Delimiters (for person names also ^ and =), line ends, form feeds and tabs put the first set back.
    """
    terms = terms_of(charset)
    if terms is None:
        return None
    if len(terms) == 1 and terms[0] in CHARSETS:
        return decode_text(raw, terms[0], policy)
    ends = re.compile(b"[" + re.escape(delimiters) + rb"\r\n\f\t]")
    initial = {"G0": "ascii", "G1": None}
    if terms[0] in TERMS:
        element, codec, width = ESCAPES[TERMS[terms[0]]]
        initial |= {element: codec} if width == 1 or element == "G1" else {}
    known = {TERMS[t] for t in terms if t in TERMS} | {b"\x1b(B", b"\x1b(J"}
    bad = {"replace_fffd": lambda b: "\ufffd", "replace_hex_escape": lambda b: "".join(f"(0x{x:02X})" for x in b)}.get(policy)
    state, out = dict(initial), []

    def part(chunk: bytes, codec: str | None) -> None:
        try:
            if codec is None:
                raise UnicodeDecodeError("none", chunk, 0, 1, "no set")
            out.append(_double(chunk, codec))
        except UnicodeDecodeError:
            if bad is None:
                raise
            out.extend(bad(chunk[k : k + 1]) for k in range(len(chunk)))

    try:
        for piece in _SPLIT.split(raw):
            if piece[:1] == b"\x1b":
                if piece in known:
                    state[ESCAPES[piece][0]] = ESCAPES[piece][1]
                else:
                    part(piece, None)
            elif state["G0"] in ("jisx0208", "jisx0212"):
                lines = _CONTROL.split(piece, maxsplit=1)
                part(lines[0], state["G0"])
                if len(lines) > 1:
                    state = dict(initial)
                    out.append(decode(piece[len(lines[0]) :], charset, policy, delimiters) or "")
            else:
                for run in _RUNS.findall(piece):
                    if run[0] >= 0x80:
                        part(run, state["G1"])
                    else:
                        part(run, "ascii")
                        if ends.search(run):
                            state["G1"] = initial["G1"]
    except UnicodeDecodeError:
        return None
    return "".join(out)


def encode(text: str, charset: str, policy: str = "strict") -> bytes | None:
    """Bytes of text: characters outside the set make it null (strict), `?` (replace_qmark) or `(U+XXXX)` (replace_unicode_escape)."""
    terms = terms_of(charset)
    if terms is None:
        return None
    sets = [CHARSETS[terms[0]]] if terms[0] in CHARSETS else ["ascii"]
    out = b""
    active = None
    for c in text:
        try:
            raw, escape = c.encode(sets[0]), None
        except UnicodeEncodeError:
            raw, escape = _escaped(c, terms)
        if raw is None:
            if policy == "strict":
                return None
            raw, escape = (b"?" if policy == "replace_qmark" else f"(U+{ord(c):04X})".encode()), None
        in_g0 = active is not None and ESCAPES[active][0] == "G0"
        if escape is None and in_g0:
            out, active = out + b"\x1b(B", None
        if escape is not None and escape != active:
            out, active = out + (b"\x1b(B" if in_g0 and ESCAPES[escape][0] == "G1" else b"") + escape, escape
        if c in "\\\r\n\f\t^=" and active is not None:
            active = None
        out += raw
    return out + (b"\x1b(B" if active is not None and ESCAPES[active][0] == "G0" else b"")


def _escaped(c: str, terms: list[str]) -> tuple[bytes | None, bytes | None]:
    for escape in (TERMS[t] for t in terms if t in TERMS):
        _, codec, width = ESCAPES[escape]
        try:
            if codec in ("jisx0208", "jisx0212"):
                raw = c.encode("iso2022_jp" if codec == "jisx0208" else "iso2022_jp_2")
                if raw.startswith(escape):
                    return raw[len(escape) : len(escape) + 2], escape
            elif len(raw := c.encode(codec)) == width and raw[0] >= 0x80:
                return raw, escape
        except UnicodeEncodeError:
            continue
    return None, None
