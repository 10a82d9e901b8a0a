"""UIDs: construction and persistent one-to-one remapping (UID-4/7, REM, JON-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import uid_strict
from ..functions.tags import tag_of

#: Tags that each option rewrites (fixed values of the public standard).
INSTANCE_TAGS = ["00020003", "00020033", "00041511", "00080018", "00081155", "00081167", "00200242"]
STUDY_TAGS, SERIES_TAGS = ["0020000D"], ["0020000E"]
#: By keyword where the dictionary must be extended first (`tags.load`).
FRAME_OF_REFERENCE_KEYWORDS = ["TargetFrameOfReferenceUID"]
FRAME_OF_REFERENCE_TAGS = ["00200052", "00200200", "00209312", "00209313", "00640003", "30060024", "300600C2", "300A0675"]


def with_suffix(root: Column, number: Column) -> Column:
    """root.number if that is a valid UID, else null."""
    uid = F.concat(root, F.lit("."), number.cast("string"))
    return F.when(uid_strict(uid), uid)


def from_key(root: str, key: Column) -> Column:
    """A UID derived from a key: the first 96 bits of its SHA-256 as a decimal number, the same in every run."""
    digest = F.sha2(key.cast("string"), 256)
    return F.concat(F.lit(root + "."), _decimal(digest))


def mapping(uids: DataFrame, uid: str, root: str, known: DataFrame | None = None) -> DataFrame:
    """(source_uid, target_uid) for each distinct valid UID: known targets are reused, others derived from the source."""
    new = uids.select(F.col(uid).alias("source_uid")).filter(uid_strict(F.col("source_uid"))).distinct()
    fresh = new.withColumn("target_uid", from_key(root, F.col("source_uid")))
    if known is None:
        return fresh
    return known.unionByName(fresh.join(known, "source_uid", "left_anti"))


def rewrite(rows: DataFrame, uid: str, pairs: DataFrame) -> DataFrame:
    """rows with mapped UIDs and a column `rewritten`."""
    joined = rows.join(pairs, F.col(uid) == F.col("source_uid"), "left")
    return joined.withColumn("rewritten", F.col("target_uid").isNotNull() & (F.col("target_uid") != F.col(uid))).withColumn(uid, F.coalesce("target_uid", uid)).drop("source_uid", "target_uid")


def conflicts(pairs: DataFrame) -> DataFrame:
    """Targets with several sources and sources with several targets: rows that break the bijection."""
    a = pairs.groupBy("source_uid").agg(F.countDistinct("target_uid").alias("n")).filter("n > 1").select(F.col("source_uid").alias("uid"), F.lit("source").alias("side"))
    b = pairs.groupBy("target_uid").agg(F.countDistinct("source_uid").alias("n")).filter("n > 1").select(F.col("target_uid").alias("uid"), F.lit("target").alias("side"))
    return a.unionByName(b)



def append(base: Column, number: Column) -> Column:
    """base.number if it fits; else 30 characters of base and 96 bits of a hash of both, the same in every run. Null for a base that isn't a UID."""
    prefix = F.rtrim(F.substring(base, 1, 30), F.lit("."))
    digest = F.sha2(F.concat_ws("/", base, number.cast("string")), 256)
    return F.when(uid_strict(base), F.coalesce(with_suffix(base, number), F.concat(prefix, F.lit("."), _decimal(digest))))


def _decimal(digest: Column) -> Column:
    high, low = (F.conv(F.substring(digest, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13))
    return (high * F.lit(2**48).cast("decimal(16,0)") + low).cast("decimal(38,0)").cast("string")


def rewrite_elements(elements: DataFrame, root: str, known: DataFrame | None = None, study: bool = True, series: bool = True, instances: bool = True, frames_of_reference: bool = False, more_tags: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(elements with mapped UIDs and `rewritten`, all pairs). Only single, non-empty UI values of the chosen tags change; the mapping joins by UID, once."""
    by_keyword = [t for t in map(tag_of, FRAME_OF_REFERENCE_KEYWORDS) if t]
    chosen = STUDY_TAGS * study + SERIES_TAGS * series + INSTANCE_TAGS * instances + (FRAME_OF_REFERENCE_TAGS + by_keyword) * frames_of_reference + [tag_of(t) or t for t in more_tags]
    wanted = F.col("tag_hex").isin(chosen) & (F.col("vr") == "UI") & (F.col("vm") == 1)
    keyed = elements.withColumn("_uid", F.when(wanted, F.rtrim(F.col("text"), F.lit(" \0"))))
    pairs = mapping(keyed.filter("_uid IS NOT NULL"), "_uid", root, known)
    out = keyed.join(pairs, F.col("_uid") == F.col("source_uid"), "left")
    changed = F.col("target_uid").isNotNull() & (F.col("target_uid") != F.col("_uid"))
    fresh = {"text": F.col("target_uid"), "strings": F.array("target_uid"), "raw": F.col("target_uid").cast("binary"), "length": (F.length("target_uid") + F.length("target_uid") % 2).cast("bigint")}
    out = out.withColumn("rewritten", changed).withColumns({c: F.when(F.col("rewritten"), v).otherwise(F.col(c)) for c, v in fresh.items() if c in elements.columns})
    return out.select(*elements.columns, "rewritten"), pairs


def save(pairs: DataFrame, known: DataFrame | None, path: str) -> None:
    """Appends the pairs that `known` doesn't have to the mapping table at path. Replays add nothing; rows that break the bijection are an error and nothing is written."""
    fresh = pairs if known is None else pairs.join(known, ["source_uid", "target_uid"], "left_anti")
    every = fresh if known is None else known.unionByName(fresh)
    if conflicts(every).limit(1).count():
        raise ValueError("the mapping is not one to one")
    fresh.write.mode("append").parquet(path)
