"""The JSON model of records: writing, reading, bulk decisions (JSN, SRC-13, SNK-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import uid_strict

THRESHOLD = 1024


def attribute(tag_hex: str, vr: str, values: Column) -> Column:
    """`"GGGGEEEE":{"vr":..,"Value":[..]}` of an array of values; without values only the vr."""
    some = F.when(F.size(values) > 0, F.concat(F.lit(',"Value":'), F.to_json(values))).otherwise("")
    return F.concat(F.lit(f'"{tag_hex}":{{"vr":"{vr}"'), some, F.lit("}"))


def record(*attributes: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *attributes), F.lit("}"))


def value(text: Column, tag_hex: str, index: int = 0) -> Column:
    """One value of a record's JSON text, or null."""
    return F.get_json_object(text, f"$.{tag_hex}.Value[{index}]")


def vr_of(text: Column, tag_hex: str) -> Column:
    return F.get_json_object(text, f"$.{tag_hex}.vr")


def inferred_vr(kind: Column, text: Column, private: Column) -> Column:
    """A value's representation from its JSON kind (`object`, `string`, `double`, `int`, ..): valid UIDs are UI, other strings LO."""
    return _inferred(kind, uid_strict(text), private)


def inferred_vr_of_all(kind: Column, texts: Column, private: Column) -> Column:
    """As `inferred_vr`, of an array of values: UI only if there are some and all are valid UIDs."""
    return _inferred(kind, (F.size(texts) > 0) & F.forall(texts, lambda t: F.coalesce(uid_strict(t), F.lit(False))), private)


def _inferred(kind: Column, uid: Column, private: Column) -> Column:
    return (
        F.when((kind == "string") & uid, "UI").when(kind == "object", "SQ").when(private, "UN").when(kind == "string", "LO").when(kind == "double", "FD").when(kind == "int", "SL").otherwise("UN")
    )


def bulk_mode(size: Column, eligible: Column, mode: str = "uri", threshold: int = THRESHOLD) -> Column:
    """inline below the threshold or if not eligible, else the mode."""
    return F.when(eligible & (size >= threshold), mode).otherwise("inline")


def bulk_uri(template: str, study: Column, series: Column, instance: Column, tag: Column) -> Column:
    """A template's URI; null if a UID that it names is missing. Unknown names and unmatched braces are errors."""
    parts, rest = [], template
    names = {"study": study, "series": series, "instance": instance, "tag": tag}
    while rest:
        before, brace, after = rest.partition("{")
        if "}" in before:
            raise ValueError("unmatched brace")
        parts.append(F.lit(before))
        if not brace:
            break
        name, close, rest = after.partition("}")
        if not close or name not in names:
            raise ValueError(f"unknown name {name}")
        parts.append(names[name])
    return F.concat(*parts)
