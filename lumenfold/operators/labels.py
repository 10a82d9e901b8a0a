"""Segments and label volumes held as voxel rows (SEG, AGG-7..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SET, MAX_CODE = 128, 65535


def stats(voxels: DataFrame, label: str, axes: list[str]) -> DataFrame:
    """Voxels, bounds and centroid by label: one pre-aggregated shuffle of a row per label and task."""
    each = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))]
    out = voxels.groupBy(label).agg(F.count("*").alias("voxels"), *each)
    return out.withColumns({f"centroid_{a}": F.col(f"sum_{a}") / F.col("voxels") for a in axes})


def label_sets(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The distinct labels of each key, in order. A set has at most 128 labels."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(label)).alias("labels"))


def set_codes(sets: DataFrame) -> DataFrame:
    """(labels, code): dense codes from 1 in order of the sets. Codes end at 65,535, so only as many sets in order, and one more, are numbered; others have no row."""
    from pyspark.sql import Window as W

    first = sets.select("labels").distinct().orderBy("labels").limit(MAX_CODE + 1)
    return first.withColumn("code", F.row_number().over(W.orderBy("labels")))


def has_label(labels: Column, label) -> Column:
    return F.array_contains(labels, label)


def mask(sample: Column, kind: str, threshold: float = 0.5, most: Column | None = None, label: int | None = None) -> Column:
    """Binary samples as they are; fractional ones at a share of the maximum, 0 meaning any; label maps by equality."""
    if kind == "BINARY":
        return sample != 0
    if kind == "FRACTIONAL":
        return sample > 0 if threshold == 0 else sample / most >= threshold
    return sample == F.lit(label)


def catalogue_errors(segments: DataFrame, number: str) -> DataFrame:
    """Segment numbers that occur more than once."""
    return segments.groupBy(number).agg(F.count("*").alias("n")).filter("n > 1")


def undefined(frames: DataFrame, segments: DataFrame, number: str) -> DataFrame:
    """Frames whose segment number no segment has: errors of a segmentation."""
    return frames.join(segments.select(number).distinct(), number, "left_anti")


def segment_frames(segments: DataFrame, frames: DataFrame, number: str, frame: str) -> DataFrame:
    """(number, n_frames, frames in order) of every segment, with 0 and an empty list for one without frames."""
    counted = frames.groupBy(number).agg(F.count("*").alias("n_frames"), F.sort_array(F.collect_list(frame)).alias("frames"))
    kind = dict(counted.dtypes)["frames"]
    out = segments.select(number).distinct().join(counted, number, "left")
    return out.select(number, F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("frames", F.array().cast(kind)).alias("frames"))


def set_bits(frames: DataFrame, samples: str, label: str, slice_index: str, columns: Column) -> DataFrame:
    """A voxel row (label, x, y, z) for each set byte of single-bit frames; an array of bytes goes no further than its row."""
    order = F.posexplode(F.transform(F.sequence(F.lit(1), F.length(samples)), lambda i: F.substring(F.col(samples), i, F.lit(1)) != F.lit(b"\0"))).alias("i", "on")
    flat = frames.filter(F.length(samples) > 0).select(label, F.col(slice_index).alias("z"), columns.alias("_n"), order).filter("on")
    return flat.select(label, (F.col("i") % F.col("_n")).alias("x"), F.floor(F.col("i") / F.col("_n")).cast("int").alias("y"), "z")


def volume(voxels: DataFrame, keys: list[str], label: str, overlap: str = "maybe", paint: list[str] = (), first: list[str] = ()) -> DataFrame:
    """A row per voxel: keys, labels (sorted distinct), code. Codes number the distinct sets from 1 in order; 0 is the background, which has no row.

    overlap `no` makes a voxel of several labels keep the last painted: by the columns `paint` (say the source frame), or without them the largest label; `maybe` and `yes` keep all.
    Of labels painted last at once the largest stays, or with the columns `first` (say the place in a file) the one that comes first by them; `paint` are numbers then.
    A code beyond 65,535 (null beyond 65,536) or a set beyond 128 labels is `over_limit`: sets are bounded by that format, voxels are not.
    """
    if overlap == "no":
        last = F.min_by(label, F.struct(*(-F.col(p) for p in paint), *first, label)) if first else F.max_by(label, F.struct(*paint, label))
        sets = voxels.groupBy(*keys).agg(F.array(last).alias("labels"))
    else:
        sets = label_sets(voxels, keys, label)
    out = sets.join(F.broadcast(set_codes(sets)), "labels", "left")  # 65,536 sets at most
    return out.select(*keys, "labels", "code", ((F.size("labels") > MAX_SET) | F.coalesce(F.col("code") > MAX_CODE, F.lit(True))).alias("over_limit"))


def restored(painted: DataFrame, label) -> DataFrame:
    """The voxels of one label: those of the codes whose sets have it."""
    return painted.filter(F.array_contains("labels", label))


def codes_of(sets: DataFrame, label) -> DataFrame:
    return set_codes(sets).filter(F.array_contains("labels", label)).select("code")


def colours(codes: DataFrame, table: DataFrame, label: str) -> DataFrame:
    """(code, r, g, b, a): a set takes the mean colour of its labels' rows (label, r, g, b, a), rounded down; labels without a colour don't count."""
    each = codes.select("code", F.explode("labels").alias(label)).join(table, label, "left")
    return each.groupBy("code").agg(*(F.coalesce(F.floor(F.avg(c)).cast("int"), F.lit(0)).alias(c) for c in ("r", "g", "b", "a")))


def write_errors(segmentation_type: Column, bits: Column, photometric: Column, samples: Column, lossy_target: Column) -> Column:
    """Why segmentation pixels may not be written, or null: BINARY has single bits, FRACTIONAL 8 bits, LABELMAP 8 or 16; one sample; lossless targets only."""
    right = F.when(segmentation_type == "BINARY", bits == 1).when(segmentation_type == "FRACTIONAL", bits == 8).when(segmentation_type == "LABELMAP", bits.isin(8, 16))
    return F.when(right.isNull(), "unknown segmentation type").when(~right, "bits don't suit the type").when(samples != 1, "one sample a pixel is needed").when(~photometric.isin("MONOCHROME2", "PALETTE COLOR"), "photometric interpretation").when(lossy_target, "lossy target")
