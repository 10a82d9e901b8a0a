"""Operators on element tables: lookups, paths, traversal, inheritance, overlays (PRJ, TRV, JON, SET, SRT, SNK-4/9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tags import lookup, tag_of


def by_keyword(elements: DataFrame, keyword: str) -> DataFrame:
    """Root elements of a keyword or written tag."""
    return elements.filter((F.col("tag_hex") == F.lit(tag_of(keyword))) & (F.col("depth") == 0))


def full_path(path: str) -> str:
    """`Sequence.item.Tag...` of keywords or written tags, items from 0, as the column `path` has it."""
    parts = path.split(".")
    if len(parts) % 2 == 0 or any(not p.isdigit() for p in parts[1::2]):
        raise ValueError(f"bad path {path}")
    tags = [tag_of(p) for p in parts[::2]]
    if None in tags:
        raise ValueError(f"unknown tag in {path}")
    return ".".join(x for pair in zip(tags, [*parts[1::2], ""]) for x in pair if x != "")


def at_path(elements: DataFrame, path: str) -> DataFrame:
    """Elements at `Sequence.item.Tag...`; keywords or written tags, items from 0."""
    return elements.filter(F.col("path") == full_path(path))


def wide(elements: DataFrame, keywords: list[str], value: str = "text") -> DataFrame:
    """One row per instance with a column for each keyword: a fixed pivot, one pre-aggregated shuffle."""
    tags = {k: tag_of(k) for k in keywords}
    found = elements.filter((F.col("depth") == 0) & F.col("tag_hex").isin([t for t in tags.values() if t]))
    return found.groupBy("instance_id").agg(*(F.max(F.when(F.col("tag_hex") == F.lit(t), F.col(value))).alias(k) for k, t in tags.items()))


def selection(tree: dict) -> dict:
    """A projection tree in canonical form: tags as hex, sorted, merged; SpecificCharacterSet and SOPClassUID always at the root."""

    def canonical(node: dict) -> dict:
        out: dict = {}
        for k, v in node.items():
            tag = tag_of(k)
            if tag is None or tag == "00000000":
                raise ValueError(f"bad tag {k}")
            below = canonical(v or {})
            out[tag] = canonical(out.get(tag, {}) | below) if tag in out else below
        return dict(sorted(out.items()))

    return canonical({"SpecificCharacterSet": {}, "SOPClassUID": {}} | tree)


def wanted_tree(tree: dict) -> dict:
    """A canonical tree with numbers for tags, as the parser takes it."""

    def numbers(node: dict) -> dict:
        return {int(tag, 16): numbers(below) for tag, below in node.items()}

    return numbers(selection(tree))


def until(elements: DataFrame, tag: int) -> DataFrame:
    return elements.filter((F.col("tag") <= tag) | (F.col("depth") > 0))


def item_path(*pairs: tuple[Column, Column]) -> Column:
    """`TTTTTTTT.i.TTTTTTTT.i` of (tag, item) columns."""
    return F.concat_ws(".", *(x for tag, item in pairs for x in (F.lpad(F.hex(tag), 8, "0"), item.cast("string"))))


def under(prefix: str) -> Column:
    """Whether an element lies under a path."""
    return F.startswith(F.col("path"), F.lit(prefix + "."))


def skip_under(elements: DataFrame, prefix: str) -> DataFrame:
    """A traversal that doesn't enter what lies under a path."""
    return elements.filter(~under(prefix))


def before(condition: Column) -> Column:
    """Whether a row of a traversal comes before the first that meets the condition, by instance."""
    stop = F.min(F.when(condition, F.col("ordinal"))).over(W.partitionBy("instance_id"))
    return stop.isNull() | (F.col("ordinal") < stop)


def stop_before(elements: DataFrame, condition: Column) -> DataFrame:
    """Rows of a traversal before the first that meets the condition, by instance."""
    return elements.withColumn("_before", before(condition)).filter("_before").drop("_before")


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], value: str, deleted: str) -> DataFrame:
    """base with changes: their values win, rows marked deleted drop out, new keys come in."""
    c = changes.select(*keys, F.col(value).alias("_new"), F.col(deleted).alias("_gone"), F.lit(True).alias("_changed"))
    joined = base.join(c, keys, "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
    return joined.withColumn(value, F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_gone", "_changed")


def layered(frames: DataFrame, shared: DataFrame, root: DataFrame, frame_key: list[str], shared_key: list[str], value: str) -> DataFrame:
    """Per-frame value, else the shared one, else the root's."""
    s = shared.select(*shared_key, F.col(value).alias("_s"))
    r = root.select(F.col(value).alias("_r"))
    joined = frames.join(s, shared_key, "left").join(F.broadcast(r.limit(1)), F.lit(True), "left")  # one row at most
    return joined.withColumn(value, F.coalesce(value, "_s", "_r")).drop("_s", "_r")


def split_payload(rows: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: all but the payload, and the payload by key."""
    return rows.drop(payload), rows.select(key, payload)


def join_payload(meta: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    return meta.join(payload, key, "left")


def private(elements: DataFrame, group: int, element: int, creator: str) -> DataFrame:
    """Elements `gggg,xxee` of a private creator: those in the block that the creator's element (gggg,00bb) reserves in the same dataset.

    A group of an even number is an error; an unknown creator gives no rows. The lowest block counts where there are several.
    """
    if group % 2 == 0:
        raise ValueError(f"group {group:04X} is not private")
    base = group << 16
    same = ["instance_id", "parent_path"]
    named = elements.filter(F.col("tag").between(base + 0x10, base + 0xFF) & (F.btrim(F.col("text"), F.lit(" \0")) == creator))
    blocks = named.groupBy(*same).agg((F.min("tag") % 256).alias("_block"))
    wanted = elements.filter((F.shiftright("tag", 16) == group) & (F.col("tag") % 256 == element) & (F.shiftright("tag", 8) % 256 >= 0x10))
    return wanted.join(blocks, same).filter(F.shiftright("tag", 8) % 256 == F.col("_block")).drop("_block").select(*elements.columns)


def with_value(elements: DataFrame, tag: str, value: Column, vr: str | None = None) -> DataFrame:
    """Root elements with a text of their own set in every instance: replaced where the tag is there, else added; VR from the dictionary."""
    code = _known(tag)
    kind = vr or (lookup(code) or (None, "UN"))[1]
    return add_missing(elements, code, kind).withColumns(_reset(elements, (F.col("tag_hex") == code) & (F.col("depth") == 0), value, kind))


def _known(tag: str) -> str:
    code = tag_of(tag)
    if code is None:
        raise ValueError(f"unknown tag {tag}")
    return code


def _reset(elements: DataFrame, here: Column, value: Column, vr: str) -> dict[str, Column]:
    new = {"text": value, "vr": F.lit(vr), "length": F.length(value).cast("bigint"), "vm": F.when(F.length(value) > 0, 1).otherwise(0), "strings": F.array(value)}
    return {c: F.when(here, new[c].cast(t) if c in new else F.lit(None).cast(t)).otherwise(F.col(c)) for c, t in elements.dtypes if c in new or c in ("raw", "longs", "doubles")}


def add_missing(elements: DataFrame, tag: str, vr: str | None = None) -> DataFrame:
    """The same elements, and an empty root element in instances without it; ordinal is null for new rows, tags give the order."""
    code = _known(tag)
    kind = vr or (lookup(code) or (None, "UN"))[1]
    has = F.max((F.col("tag_hex") == code) & (F.col("depth") == 0)).alias("_has")
    without = elements.groupBy("instance_id").agg(has).filter("NOT coalesce(_has, false)").select("instance_id")
    fixed = {"path": F.lit(code), "depth": F.lit(0), "parent_path": F.lit(""), "tag": F.lit(int(code, 16)), "tag_hex": F.lit(code), "keyword": F.lit((lookup(code) or (None,))[0]), "vr": F.lit(kind), "vm": F.lit(0), "length": F.lit(0), "present": F.lit(True)}
    new = without.select("instance_id", *(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in elements.dtypes if c != "instance_id"))
    return elements.unionByName(new)


def without(elements: DataFrame, path: str) -> DataFrame:
    """No element at a path, nor anything below it."""
    return elements.filter(~((F.col("path") == path) | F.startswith(F.col("path"), F.lit(path + "."))))


def nearest_charset(elements: DataFrame) -> DataFrame:
    """elements with the SpecificCharacterSet of their own dataset or of the nearest one around it (`charset`), null without any.

    Each row looks its ancestors up in a map of its instance's character sets, which has an entry for each dataset that names one.
    """
    sets = elements.filter("tag_hex = '00080005'").groupBy("instance_id").agg(F.map_from_entries(F.collect_list(F.struct("parent_path", "text"))).alias("_sets"))
    parts = F.split(F.col("parent_path"), r"\.")
    levels = F.when(F.col("parent_path") == "", F.lit(0)).otherwise(F.size(parts) / 2).cast("int")
    above = F.transform(F.sequence(levels, F.lit(0), F.lit(-1)), lambda n: F.try_element_at(F.col("_sets"), F.array_join(F.slice(parts, F.lit(1), n * 2), ".")))
    return elements.join(sets, "instance_id", "left").withColumn("charset", F.get(F.filter(above, lambda c: c.isNotNull()), F.lit(0))).drop("_sets")


def duplicates_last(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row of equal keys."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")
