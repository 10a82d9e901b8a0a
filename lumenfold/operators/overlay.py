"""Whether one plane or volume can be laid over another (GEO-5/7/8, JON-8). Grids are structs of `functions.geometry`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.batches import spread

#: Names of the outcomes, as text (fixed values).
STATUSES = "compatible missing_frame_of_reference different_frame_of_reference non_parallel_planes opposite_orientation out_of_plane different_spacing different_extent requires_resampling".split()


def _overlaps(low: Column, high: Column, size: Column, slack: Column) -> Column:
    return (high >= -0.5 - slack) & (low < size - 0.5 + slack)


def _inside(low: Column, high: Column, size: Column, slack: Column) -> Column:
    return (low >= -0.5 - slack) & (high <= size - 0.5 + slack)


def _along(points: str, axis: int) -> Column:
    return F.transform(points, lambda p: p[axis])


def check(
    rows: DataFrame, source: str, target: str, source_frame: str, target_frame: str, source_flat: bool, target_flat: bool,
    same_grid_only: bool = False, orientation: float = G.ORIENTATION, spacing: float = G.SPACING, position: float = G.POSITION, distance: float = G.POSITION,
) -> DataFrame:
    """rows with a struct `overlay`: status, same_grid, overlaps, inside, requires_resampling, can_transform, can_direct, k_range.

    source and target name grid columns, source_frame and target_frame the UIDs of their frames of reference (null or empty: missing).
    Steps are columns of their own, so that no expression is evaluated for each of its uses. Without a common frame nothing else is decided. Rows of narrow tables are dealt to all cores.
    """
    rows = spread(rows)
    s, t = F.col(source), F.col(target)
    flat = 2 if source_flat or target_flat else 3  # axes whose extents must agree
    volume_source = target_flat and not source_flat
    frame, points = (s, t) if volume_source else (t, s)  # bounds are those of `points` in the indexes of `frame`
    axes = 2 if source_flat and target_flat else 3
    slack = [F.lit(position) / F.col("_f")["spacing"][k] for k in range(2)] + [F.lit(distance if flat == 2 else position) / F.col("_f")["spacing"][2]]
    step = rows.withColumns({"_f": frame, "_dots": F.array(*(G.dot(s["axes"][k], t["axes"][k]) for k in range(3)))})
    step = step.withColumns({
        "_i": F.transform(G.corners(points, target_flat if volume_source else source_flat), lambda c: G.grid_to_index(F.col("_f"), c)),
        "_other": F.transform(G.corners(s, source_flat), lambda c: G.grid_to_index(t, c)),
        "_o": G.grid_to_index(F.col("_f"), (t if volume_source else s)["origin"]), "_d": G.minus(t["origin"], s["origin"]),
    })
    for name, of in (("", "_i"), ("other_", "_other")):
        step = step.withColumns({f"_{name}low": F.array(*(F.array_min(_along(of, k)) for k in range(3))), f"_{name}high": F.array(*(F.array_max(_along(of, k)) for k in range(3)))})
    low, high, dots, o = F.col("_low"), F.col("_high"), F.col("_dots"), F.col("_o")
    every = lambda f, n: F.forall(F.array(*(f(k) for k in range(n))), lambda x: x)
    inner = 2 if target_flat else 3
    other_slack = [F.lit(position) / t["spacing"][k] for k in range(2)] + [F.lit(distance if flat == 2 else position) / t["spacing"][2]]
    away = F.abs(G.dot(F.col("_d"), s["axes"][2]))
    if axes == 2:
        at_origin = (F.abs(G.dot(F.col("_d"), s["axes"][0])) <= position) & (F.abs(G.dot(F.col("_d"), s["axes"][1])) <= position)
    else:
        mm = [F.abs(o[k] * F.col("_f")["spacing"][k]) for k in range(3)]
        third = F.abs((o[2] - F.signum(o[2]) * F.floor(F.abs(o[2]) + 0.5)) * F.col("_f")["spacing"][2]) <= distance if flat == 2 else mm[2] <= position
        at_origin = (mm[0] <= position) & (mm[1] <= position) & third
    step = step.withColumns({
        "_overlaps": every(lambda k: _overlaps(low[k], high[k], F.col("_f")["size"][k], slack[k]), axes),
        "_inside": every(lambda k: _inside(F.col("_other_low")[k], F.col("_other_high")[k], t["size"][k], other_slack[k]), inner),
        "_spacing": every(lambda k: F.abs(s["spacing"][k] - t["spacing"][k]) <= spacing, flat), "_size": every(lambda k: s["size"][k] == t["size"][k], flat),
        "_turned": 1 - F.abs(dots[2]) > orientation if flat == 2 else F.exists(dots, lambda d: 1 - F.abs(d) > orientation),
        "_axes_off": F.greatest(1 - F.abs(dots[0]), 1 - F.abs(dots[1])) > orientation, "_flipped": F.exists(dots, lambda d: d < 0),
        "_origin": at_origin, "_away": away > distance,
        "_range": F.when(F.lit(axes == 3), G.index_range(low[2], high[2], F.col("_f")["size"][2], slack[2])),
    })
    one_slice = F.coalesce(F.col("_range.end") == F.col("_range.start") + 1, F.lit(False)) if axes == 3 and flat == 2 else F.lit(True)
    step = step.withColumn("_same", ~F.col("_turned") & ~F.col("_axes_off") & ~F.col("_flipped") & F.col("_spacing") & F.col("_size") & F.col("_origin") & one_slice & (~F.col("_away") & F.col("_overlaps") if axes == 2 else F.lit(True)))
    a, b = F.col(source_frame), F.col(target_frame)
    missing = F.coalesce(a == "", F.lit(True)) | F.coalesce(b == "", F.lit(True))
    direct = F.col("_same") & F.col("_overlaps")
    status = F.when(missing, "missing_frame_of_reference").when(a != b, "different_frame_of_reference").when(F.col("_turned"), "non_parallel_planes").when(F.col("_flipped"), "opposite_orientation")
    if axes == 2:
        status = status.when(F.col("_away"), "out_of_plane")
    status = status.when(~F.col("_overlaps"), "different_extent")
    if axes == 2:
        status = status.when(F.col("_same"), "compatible")
    status = status.when(~F.col("_spacing"), "different_spacing").when(~F.col("_size"), "different_extent")
    if axes == 3 and flat == 2:
        status = status.when(F.col("_axes_off"), "requires_resampling")
    step = step.withColumn("_status", (status if axes == 2 else status.when(direct, "compatible")).otherwise("requires_resampling"))
    st = F.col("_status")
    resample = st.isin("different_spacing", "requires_resampling") | (st.isin("non_parallel_planes", "opposite_orientation") & F.col("_overlaps"))
    framed = ~st.isin("missing_frame_of_reference", "different_frame_of_reference")
    kept = F.col("_same") | F.lit(not same_grid_only)
    seen = framed & (st != "out_of_plane")
    out = F.struct(
        st.alias("status"), (framed & F.col("_same")).alias("same_grid"), (seen & F.col("_overlaps")).alias("overlaps"), (seen & F.col("_inside")).alias("inside"), resample.alias("requires_resampling"),
        (framed & kept).alias("can_transform"), (framed & direct & kept).alias("can_direct"), F.when(framed & F.col("_overlaps") & F.lit(not target_flat), F.col("_range")).alias("k_range"),
    )
    return step.withColumn("overlay", out).select(*rows.columns, "overlay")
