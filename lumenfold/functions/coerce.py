"""Text and number coercion of multi-valued elements; a failure is null, never a partial value (COE, TXT, FLT-5/6, AGG-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = " \0"
UID_PATTERN = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"


def padded_trim(text: Column, lead: bool = True) -> Column:
    """Spaces and NULs off the end, and off the start if lead."""
    return F.btrim(text, F.lit(PAD)) if lead else F.rtrim(text, F.lit(PAD))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tokens(text: Column, one) -> Column:
    r"""one(token) of every non-empty token between `\` or `/`; null if there is none or one is null."""
    tokens = F.filter(F.transform(F.split(text, r"[\\/]"), lambda t: padded_trim(t)), lambda t: t != "")
    return bound(F.transform(tokens, one), lambda v: F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v))


def _numbers(text: Column, kind: str) -> Column:
    return _tokens(text, lambda t: t.try_cast(kind))


def to_doubles(text: Column) -> Column:
    r"""All values between `\` or `/`; empty tokens are skipped, a bad one makes the whole null."""
    return _numbers(text, "double")


#: How far a decimal may be from the integer that it is taken for.
WHOLE = 1e-9


def _whole(text: Column, kind: str) -> Column:
    def one(t: Column) -> Column:
        near = bound(t.try_cast("double"), lambda d: F.when(F.abs(d - F.rint(d)) <= WHOLE, F.rint(d).try_cast(kind)))
        return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast(kind)).otherwise(near)

    return _tokens(text, one)


def to_longs(text: Column) -> Column:
    """Integers and decimals within 1e-9 of one; any other value makes the whole null."""
    return _whole(text, "bigint")


def to_ints(text: Column) -> Column:
    """As `to_longs`; a value beyond 32 bits makes the whole null."""
    return _whole(text, "int")


def to_double(text: Column) -> Column:
    return F.get(to_doubles(text), F.lit(0))


def to_long(text: Column) -> Column:
    return F.get(to_longs(text), F.lit(0))


def value_or(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def to_strings(text: Column, lead: bool = True) -> Column:
    r"""Values between `\`, empty ones included, each without padding."""
    return F.transform(F.split(text, r"\\", -1), lambda t: padded_trim(t, lead))


def to_string(text: Column, lead: bool = True) -> Column:
    return padded_trim(F.substring_index(text, "\\", 1), lead)


def multiplicity(text: Column) -> Column:
    """0 of an empty value, else the delimiters and one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\\"), F.lit(""))) + 1)


def binary_multiplicity(length: Column, width: int) -> Column:
    return F.floor(length / width)


def uid_strict(text: Column) -> Column:
    """At most 64 characters; numbers without leading zeros between dots."""
    return (F.length(text) <= 64) & text.rlike(UID_PATTERN)


def uid_loose(text: Column) -> Column:
    return (F.length(text) <= 64) & text.rlike(r"^[0-9.]+$")


def uid_normal(text: Column) -> Column:
    return F.rtrim(F.ltrim(text), F.lit(PAD))


def person_name(text: Column) -> Column:
    """Arrays of components by group; null with over three groups or over five components in one; an empty group is null."""
    groups = F.split(text, "=", -1)
    parts = F.transform(groups, lambda g: F.when(g != "", F.split(g, r"\^", -1)))
    right = (F.size(groups) <= 3) & ~F.exists(parts, lambda p: F.coalesce(F.size(p) > 5, F.lit(False)))
    return F.when(right, F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("alphabetic", "ideographic", "phonetic")))))


def person_name_text(name: Column) -> Column:
    """Groups joined again, without empty groups at the end. Components that were written stay, empty ones at the end too."""
    joined = F.concat_ws("=", *(F.coalesce(F.array_join(name[n], "^"), F.lit("")) for n in ("alphabetic", "ideographic", "phonetic")))
    return F.when(name.isNotNull(), F.regexp_replace(joined, "=+$", ""))


def person_name_empty(name: Column) -> Column:
    """No component of any group has text."""
    return ~F.greatest(*(F.coalesce(F.exists(name[n], lambda c: c != ""), F.lit(False)) for n in ("alphabetic", "ideographic", "phonetic")))


def shown_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def shown_text(text: Column, limit: int) -> Column:
    """Control characters escaped, longer texts cut with three dots."""
    clean = F.regexp_replace(text, r"[\r\n\t]", " ")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean)


def dump_escaped(text: Column) -> Column:
    """Backslashes and quotes with a backslash before them, control characters as \\xHH, in quotes."""
    marked = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    for code in (*range(32), 127):
        marked = F.replace(marked, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.concat(F.lit("'"), marked, F.lit("'"))


def dump_value(text: Column, limit: int) -> Column:
    """Quoted and escaped; over `limit` characters cut before the closing quote, with three dots."""
    shown = dump_escaped(text)
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, limit - 4), F.lit("...'"))).otherwise(shown)


def dump_line(tag_hex: Column, vr: Column, length: Column, vm: Column, value: Column, keyword: Column, limit: int = 40) -> Column:
    return F.concat_ws("\t", tag_hex, vr, length.cast("string"), vm.cast("string"), shown_text(value, limit), keyword)


#: Longest value in characters by VR, and the shape that a value must have (fixed values of the public standard).
LONGEST = {"AE": 16, "AS": 4, "CS": 16, "DA": 8, "DS": 16, "DT": 26, "IS": 12, "LO": 64, "LT": 10240, "PN": 64, "SH": 16, "ST": 1024, "TM": 14, "UI": 64}
SHAPES = {
    "AS": r"[0-9]{3}[DWMY]", "CS": r"[A-Z0-9 _]*", "DA": r"[0-9]{8}", "DS": r" *[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)? *", "DT": r"[0-9]{4,14}(\.[0-9]{1,6})?([+-][0-9]{4})?",
    "IS": r" *[+-]?[0-9]+ *", "TM": r"[0-9]{2}([0-9]{2}([0-9]{2}(\.[0-9]{1,6})?)?)?", "UI": r"[0-9.]*",
}
#: Text that is one value, backslashes included.
WHOLE_VRS = frozenset("LT ST UT UR".split())


def fits(text: Column, vr: str) -> Column:
    """Whether a single text value has its VR's shape, length and range; true for an empty one, null for a null."""
    right = F.lit(True)
    if vr == "PN":
        right = ~F.exists(F.split(text, "=", -1), lambda g: F.length(g) > LONGEST["PN"])
    elif vr in LONGEST:
        right = F.length(text) <= LONGEST[vr]
    if vr in SHAPES:
        right = right & (text.rlike(f"^({SHAPES[vr]})$") | (text == ""))
    if vr not in WHOLE_VRS:
        right = right & ~text.contains("\\")
    if vr == "IS":
        right = right & F.coalesce(F.btrim(text).try_cast("bigint").between(-(2**31), 2**31 - 1), text == "")
    return F.when(text.isNotNull(), right)


def text_or_raw(text: Column, raw: Column) -> Column:
    """(text, raw): the decoded value, or the bytes where they could not be decoded."""
    return F.struct(text.alias("text"), F.when(text.isNull(), raw).alias("raw"))
