"""Series of single-frame slices: order, main orientation, volumes, folder lists (SRC-15/16, AGG-1/2/13, WIN-6..9, PIX-13/15, SRT-4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import geometry as G
from .elements import wide

#: What a folder list shows of each file (fixed values).
LISTED = "StudyDescription SeriesDescription StudyDate PatientID PatientName Modality Rows Columns BitsAllocated NumberOfFrames".split()


def folder_list(elements: DataFrame, probed: DataFrame) -> DataFrame:
    """A row per file of (instance_id, is_record), with what can be read of it; files that are no records or broken stay, with nulls.

    Sorted by name without case by `listed_order`; frames are 1 where there is no number.
    """
    shown = wide(elements, LISTED)
    numeric = elements.filter(F.col("depth") == 0).withColumn("_n", F.get("longs", F.lit(0)))
    sizes = wide(numeric, ["Rows", "Columns", "BitsAllocated", "NumberOfFrames"], "_n")
    text = shown.select("instance_id", *(F.btrim(k).alias(k) for k in LISTED[:6])).withColumn("StudyDate", coerce.shown_date(F.col("StudyDate")))
    out = probed.join(text, "instance_id", "left").join(sizes, "instance_id", "left")
    return out.withColumn("NumberOfFrames", F.when(F.col("is_record"), F.coalesce(F.when(F.col("NumberOfFrames") > 0, F.col("NumberOfFrames")), F.lit(1))))


def listed_order() -> list[Column]:
    name = F.element_at(F.split("instance_id", "/"), -1)
    return [F.lower(name), name]


def only_series(instances: DataFrame, series: str = "series_uid") -> DataFrame:
    """instances, if all are of one series; ValueError with the counts otherwise. Only up to ten counts come to the driver."""
    counts = instances.groupBy(series).count().orderBy(F.col("count").desc(), F.col(series).asc_nulls_last()).limit(10).collect()
    if len(counts) != 1:
        raise ValueError(f"{len(counts)} series: " + ", ".join(f"{r[series]} ({r['count']})" for r in counts))
    return instances


def instance_order(position: str = "position_along", number: str = "instance_number", name: str = "instance_id") -> list[Column]:
    return [F.col(position).asc_nulls_last(), F.col(number).asc_nulls_last(), F.col(name)]


def main_orientation(slices: DataFrame, keys: list[str], axis_x: str, axis_y: str, order: str, tolerance: float = G.ORIENTATION) -> DataFrame:
    """Slices of each series' largest orientation group. A slice joins the first group whose first member is within tolerance; the first group wins ties.

    Groups depend on order, so a series is worked on whole, with its two axes and order only; pixels don't pass.
    """
    kind = ", ".join(f"{k} {t}" for k, t in slices.select(*keys, order).dtypes)

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        axes = np.hstack([np.array(frame[c].tolist(), float).reshape(-1, 3) for c in ("_x", "_y")])
        anchors: list[np.ndarray] = []
        at = np.empty(len(axes), int)
        for k, a in enumerate(axes):
            near = [i for i, b in enumerate(anchors) if max(np.abs(a - b)) <= tolerance]
            if not near:
                anchors.append(a)
            at[k] = near[0] if near else len(anchors) - 1
        return frame.loc[at == np.bincount(at).argmax(), [*keys, order]]

    wanted = slices.filter(F.col(axis_x).isNotNull() & F.col(axis_y).isNotNull())
    kept = wanted.select(*keys, order, F.col(axis_x).alias("_x"), F.col(axis_y).alias("_y")).groupBy(*keys).applyInPandas(keep, kind)
    return slices.join(kept, [*keys, order], "left_semi")


def along_normal(slices: DataFrame, keys: list[str], origin: str, normal: str, order: str) -> DataFrame:
    """Adds position_along and residual (distance off the axis) against the first slice in order, not the lowest."""
    from pyspark.sql import Window as W

    first = F.first(F.struct(F.col(origin).alias("o"), F.col(normal).alias("n"))).over(W.partitionBy(*keys).orderBy(order))
    out = slices.withColumn("_first", first)
    d = G.minus(F.col(origin), F.col("_first.o"))
    out = out.withColumn("position_along", G.dot(d, F.col("_first.n")))
    return out.withColumn("residual", G.norm(G.minus(d, G.scaled(F.col("_first.n"), F.col("position_along"))))).drop("_first")


def multiframe_order(frames: DataFrame, keys: list[str], origin: str, axes: tuple[str, str], order: str, tolerance: float = 1e-4, off_axis: float = 1e-2) -> DataFrame:
    """Adds position_along, frame_ordinal (from 0: by position along the first frame's normal, frames without a position last, ties in order) and order_error.

    A record whose frames' axes differ by more than tolerance in any part, or whose positions lie further than off_axis from the normal through the first, is no stack: all its frames have the
    error, and no ordinal. Without a first position frames stay in order and have no positions. Axes that are null count as those of the first frame.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    first = F.first(F.struct(F.col(origin).alias("o"), F.col(axes[0]).alias("x"), F.col(axes[1]).alias("y")))
    out = frames.withColumns({"_0": first.over(w.orderBy(order)), "_at": F.row_number().over(w.orderBy(order))})
    # numbers in columns of their own, step by step: nothing is computed again for each of its uses, and all of it is compiled
    o, x, y = (F.col(f"_0.{c}") for c in "oxy")
    three, n, u, d = range(3), *([F.col(f"_{c}{k}") for k in range(3)] for c in "nud")
    out = out.withColumns({f"_n{k}": x[(k + 1) % 3] * y[(k + 2) % 3] - x[(k + 2) % 3] * y[(k + 1) % 3] for k in three} | {f"_d{k}": F.col(origin)[k] - o[k] for k in three})
    out = out.withColumn("_n", F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]))
    out = out.withColumns({f"_u{k}": F.when(F.col("_n") <= G.EPSILON, 0.0).otherwise(n[k] * (1 / F.col("_n"))) for k in three})
    out = out.withColumn("position_along", F.when(o.isNotNull() & F.col(origin).isNotNull(), d[0] * u[0] + d[1] * u[1] + d[2] * u[2]))
    out = out.withColumns({f"_r{k}": d[k] - u[k] * F.col("position_along") for k in three})
    turned = F.greatest(*(F.abs(F.col(a)[k] - f[k]) for a, f in zip(axes, (x, y)) for k in three)) > tolerance
    aside = F.sqrt(sum((F.col(f"_r{k}") * F.col(f"_r{k}") for k in (1, 2)), F.col("_r0") * F.col("_r0"))) > off_axis
    out = out.withColumn("_wrong", F.when(o.isNotNull() & turned, 1).when(o.isNotNull() & aside, 2))
    out = out.select(*frames.columns, "position_along", "_wrong", "_at").withColumn("_wrong", F.min("_wrong").over(w))
    ordinal = F.row_number().over(w.orderBy(F.col("position_along").isNull(), "position_along", "_at")) - 1
    error = F.when(F.col("_wrong") == 1, "orientations vary").when(F.col("_wrong") == 2, "positions are off the axis")
    out = out.withColumn("frame_ordinal", ordinal).withColumns({"order_error": error, "frame_ordinal": F.when(F.col("_wrong").isNull(), F.col("frame_ordinal"))})
    return out.select(*frames.columns, "position_along", "order_error", "frame_ordinal")


def issues(slices: DataFrame, keys: list[str], order: str, frame: str, size: tuple[str, str], spacing: tuple[str, str], axes: tuple[str, str]) -> DataFrame:
    """A row (keys, order, issue) for each way in which a slice differs from the first in order. A flipped axis differs, too."""
    from pyspark.sql import Window as W

    names = [frame, *size, *spacing, *axes]
    first = F.first(F.struct(*names)).over(W.partitionBy(*keys).orderBy(order))
    s = slices.withColumn("_0", first)
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_0.{c}"))
    found = F.array(
        F.when(differs(frame), "frame_of_reference_mismatch"), F.when(differs(size[0]) | differs(size[1]), "size_mismatch"),
        F.when((F.abs(F.col(spacing[0]) - F.col(f"_0.{spacing[0]}")) > G.SPACING) | (F.abs(F.col(spacing[1]) - F.col(f"_0.{spacing[1]}")) > G.SPACING), "spacing_mismatch"),
        F.when((1 - G.dot(F.col(axes[0]), F.col(f"_0.{axes[0]}")) > G.ORIENTATION) | (1 - G.dot(F.col(axes[1]), F.col(f"_0.{axes[1]}")) > G.ORIENTATION), "orientation_mismatch"),
    )
    return s.select(*keys, order, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def placements(slices: DataFrame, keys: list[str], position: str, ties: list[str], spacing: str) -> DataFrame:
    """Adds k (0 for the lowest position) and the volume's step along its normal for stacks of uniform spacing."""
    from pyspark.sql import Window as W

    return slices.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(position, *ties)) - 1).withColumn("step", F.col(spacing))


def volumes(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row per series: n_slices, sizes, sample type and slices in order as an array of binaries; error where shapes or types differ.

    A volume is one row by nature; keep `frames` as rows for series whose pixels don't fit a row (2 GB).
    """
    shape = F.struct("n_rows", "n_columns", "samples_per_pixel", "sample_type")
    out = frames.groupBy(*keys).agg(
        F.count("*").alias("n_slices"), F.min(shape).alias("_low"), F.max(shape).alias("_high"), F.transform(F.sort_array(F.collect_list(F.struct(*order, "samples"))), lambda s: s["samples"]).alias("slices")
    )
    return out.select(*keys, "n_slices", "_low.*", F.when(F.col("_low") != F.col("_high"), "slices differ in shape or type").alias("error"), F.when(F.col("_low") == F.col("_high"), F.col("slices")).alias("slices"))


def rescale_plan(frames: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """(keys, n_pairs, integers, kind): whether a series' rescale keeps integers, and the smallest kind that holds them, else float32."""
    from ..functions import pixels

    out = frames.groupBy(*keys).agg(
        F.countDistinct("slope", "intercept").alias("n_pairs"), F.bool_and(pixels.keeps_integers(F.col("slope"), F.col("intercept"))).alias("integers"),
        (F.min(low) + F.min(F.round("intercept")).cast("bigint")).alias("_a"), (F.max(high) + F.max(F.round("intercept")).cast("bigint")).alias("_b"),
    )
    return out.select(*keys, "n_pairs", "integers", F.when(F.col("integers"), pixels.integer_kind(F.col("_a"), F.col("_b"))).otherwise("float32").alias("kind"))


def image_rows(frames: DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """(instance_id, array) of decoded frames, one at a time, for use at the edge."""
    from ..sources.frames import sample_array

    for r in frames.filter("error IS NULL").toLocalIterator():
        yield r.instance_id, sample_array(bytes(r.samples), r.sample_type, r.n_rows, r.n_columns, r.samples_per_pixel)
