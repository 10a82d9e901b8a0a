"""Functional groups of multi-frame records: per frame, else shared, else root (JON-3/4/7, PIX-10, GEO-6/10/11, AGG-3, WIN-12, SEG-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tags import tag_of

PER_FRAME, SHARED = "52009230", "52009229"
#: Attributes that mark an image cut into tiles (fixed values).
TILED = ["00480006", "00480007"]


def resolved(elements: DataFrame, attributes: dict[str, tuple[str, str, str]], root: bool = True) -> DataFrame:
    """A row per frame of (instance_id, frame, n_frames, and a column for each attribute); attributes: name to (group sequence, keyword, value column).

    One shuffle by instance: frames' values meet in a map, so a record's frames are the largest group. With root=False the root's own value doesn't
    count, as where a group is compulsory. Frames are 0 to NumberOfFrames - 1 (1 without it).
    """
    path, root_tag = F.col("path"), (F.col("depth") == 0)
    aggregates: list[Column] = [F.coalesce(F.max(F.when(root_tag & (F.col("tag_hex") == "00280008"), F.get("longs", F.lit(0)))), F.lit(1)).cast("int").alias("n_frames")]
    wanted = [path == "00280008"]
    for name, (group, keyword, value) in attributes.items():
        g, t = tag_of(group), tag_of(keyword)
        if g is None or t is None:
            raise ValueError(f"unknown {group} or {keyword}")
        per = path.rlike(f"^{PER_FRAME}\\.[0-9]+\\.{g}\\.0\\.{t}$")
        frame = F.split_part(path, F.lit("."), F.lit(2)).cast("int")
        shared, own = path == f"{SHARED}.0.{g}.0.{t}", path == t
        wanted += [per, shared, own]
        aggregates += [
            F.map_from_entries(F.collect_list(F.when(per & F.col(value).isNotNull(), F.struct(frame.alias("f"), F.col(value).alias("v"))))).alias(f"_f_{name}"),
            F.max(F.when(shared, F.struct(F.col(value).alias("v")))).alias(f"_s_{name}"), F.max(F.when(own, F.struct(F.col(value).alias("v")))).alias(f"_r_{name}"),
        ]
    any_wanted = wanted[0]
    for w in wanted[1:]:
        any_wanted = any_wanted | w
    one = elements.groupBy("instance_id").agg(*(F.max(F.lit(True)).alias("_any"), *aggregates)) if not attributes else elements.filter(any_wanted).groupBy("instance_id").agg(*aggregates)
    rows = one.withColumn("frame", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames"), F.lit(1)) - 1)))
    found = {n: F.coalesce(F.try_element_at(F.col(f"_f_{n}"), F.col("frame")), F.col(f"_s_{n}")["v"], *([F.col(f"_r_{n}")["v"]] if root else [])) for n in attributes}
    return rows.select("instance_id", "frame", "n_frames", *(c.alias(n) for n, c in found.items()))


GEOMETRY = {
    "position": ("PlanePositionSequence", "ImagePositionPatient", "doubles"), "orientation": ("PlaneOrientationSequence", "ImageOrientationPatient", "doubles"),
    "spacing": ("PixelMeasuresSequence", "PixelSpacing", "doubles"), "n_rows": ("PixelMeasuresSequence", "Rows", "longs"), "n_columns": ("PixelMeasuresSequence", "Columns", "longs"),
}


def planes(elements: DataFrame) -> DataFrame:
    """(instance_id, frame, status, plane): each frame's plane, null unless the status is ok.

    The first spacing is between rows, so it belongs to the plane's second axis. Missing parts have statuses of their own.
    """
    r = resolved(elements, GEOMETRY)
    o, s = F.col("orientation"), F.col("spacing")
    axis = lambda k: F.array(*(F.get(o, F.lit(k + i)) for i in range(3)))
    origin = F.array(*(F.get("position", F.lit(i)) for i in range(3)))
    size = (F.get("n_columns", F.lit(0)), F.get("n_rows", F.lit(0)))
    steps = (F.get(s, F.lit(1)), F.get(s, F.lit(0)))
    missing = F.when(F.coalesce(F.size("position"), F.lit(0)) != 3, "missing_position").when(F.coalesce(F.size(o), F.lit(0)) != 6, "missing_orientation").when(F.coalesce(F.size(s), F.lit(0)) != 2, "missing_spacing")
    status = F.coalesce(missing, G.grid_status(size, steps, (axis(0), axis(3)), origin))
    return r.withColumn("status", status).select("instance_id", "frame", "status", F.when(F.col("status") == "ok", G.plane(origin, (axis(0), axis(3)), steps, size)).alias("plane"))


def transforms(elements: DataFrame) -> DataFrame:
    """(instance_id, frame, slope, intercept, center, width, status): the first pairs; slope 1 and intercept 0 without any, and an incomplete pair is `incomplete`."""
    r = resolved(elements, {
        "slopes": ("PixelValueTransformationSequence", "RescaleSlope", "doubles"), "intercepts": ("PixelValueTransformationSequence", "RescaleIntercept", "doubles"),
        "centers": ("FrameVOILUTSequence", "WindowCenter", "doubles"), "widths": ("FrameVOILUTSequence", "WindowWidth", "doubles"),
    })
    first = {n: F.get(f"{n}s", F.lit(0)) for n in ("slope", "intercept", "center", "width")}
    r = r.select("instance_id", "frame", *(c.alias(n) for n, c in first.items()))
    broken = (F.col("slope").isNull() != F.col("intercept").isNull()) | (F.col("center").isNull() != F.col("width").isNull())
    out = r.withColumn("status", F.when(broken, "incomplete").otherwise("ok"))
    return out.withColumns({"slope": F.coalesce("slope", F.lit(1.0)), "intercept": F.coalesce("intercept", F.lit(0.0))})


def stack_keys(elements: DataFrame) -> DataFrame:
    """(instance_id, frame, stack_id, in_stack_position, dimension_values) of each frame."""
    return resolved(elements, {
        "stack_id": ("FrameContentSequence", "StackID", "text"), "positions": ("FrameContentSequence", "InStackPositionNumber", "longs"), "dimension_values": ("FrameContentSequence", "DimensionIndexValues", "longs"),
    }, root=False).withColumn("in_stack_position", F.get("positions", F.lit(0))).drop("positions")


def references(elements: DataFrame) -> DataFrame:
    """(instance_id, frame, source_uid): source images of each frame; a frame without its own takes the shared ones, one row each."""
    tail = r"[0-9]+\.00089124\.[0-9]+\.00082112\.[0-9]+\.00081155$"
    own = elements.filter(F.col("path").rlike(f"^{PER_FRAME}\\.{tail}")).select("instance_id", F.split_part("path", F.lit("."), F.lit(2)).cast("int").alias("frame"), F.col("text").alias("source_uid"))
    shared = elements.filter(F.col("path").rlike(f"^{SHARED}\\.{tail}")).select("instance_id", F.col("text").alias("source_uid"))
    bare = resolved(elements, {"_": ("FrameContentSequence", "StackID", "text")}).select("instance_id", "frame").join(own.select("instance_id", "frame").distinct(), ["instance_id", "frame"], "left_anti")
    return own.unionByName(bare.join(shared, "instance_id"))


def tiled(elements: DataFrame) -> DataFrame:
    """Instances that are cut into tiles: they have no slice stack."""
    return elements.filter((F.col("depth") == 0) & F.col("tag_hex").isin(TILED)).select("instance_id").distinct()


def slice_vector_origin(origin: Column, normal: Column, value: Column, first: Column, spacing: Column) -> Column:
    """The origin of a frame whose place in the stack is a slice vector."""
    return G.plus(origin, G.scaled(normal, (value - first) * spacing))
