"""Vectors, planes and overlay statuses (GEO, FLT-9/10). Vectors are arrays of three doubles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON, ORIENTATION, SPACING, POSITION = 1e-12, 1e-4, 1e-3, 1e-3


def vector(x, y, z) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)))


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, k: Column) -> Column:
    return F.array(a[0] * k, a[1] * k, a[2] * k)


def minus(a: Column, b: Column) -> Column:
    return F.array(a[0] - b[0], a[1] - b[1], a[2] - b[2])


def plus(a: Column, b: Column) -> Column:
    return F.array(a[0] + b[0], a[1] + b[1], a[2] + b[2])


def unit(a: Column) -> Column:
    """The vector at length 1, or zero if it has next to none."""
    n = norm(a)
    return F.when(n <= EPSILON, vector(0, 0, 0)).otherwise(scaled(a, 1 / n))


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def plane_status(rows: Column, columns: Column, row_spacing: Column, column_spacing: Column, row_axis: Column, column_axis: Column, origin: Column | None = None) -> Column:
    """What keeps a plane from being built, or `ok`. Axes need not be of length 1."""
    return grid_status((columns, rows), (row_spacing, column_spacing), (row_axis, column_axis), origin)


def grid_status(size: tuple, spacing: tuple, axes: tuple, origin: Column | None = None) -> Column:
    """The same for two axes (a plane) or three (a volume, whose axes must be right-handed); null parts are invalid."""
    u = [unit(a) for a in axes]
    pairs = [(a, b) for i, a in enumerate(u) for b in u[i + 1 :]]
    bad_size = reduce(or_, (F.coalesce(n <= 0, F.lit(True)) for n in size))
    bad_spacing = reduce(or_, (~finite(F.array(s.cast("double"))) | (s <= 0) for s in spacing))
    bad_axes = reduce(or_, (~finite(a) | (norm(a) <= EPSILON) for a in axes)) | reduce(or_, (F.abs(dot(a, b)) > ORIENTATION for a, b in pairs))
    status = F.when(bad_size, "invalid_size")
    if origin is not None:
        status = status.when(~finite(origin), "invalid_value")
    status = status.when(reduce(or_, (~finite(a) for a in axes)), "invalid_orientation").when(bad_spacing, "invalid_spacing").when(bad_axes, "invalid_orientation")
    if len(axes) == 3:
        status = status.when(F.abs(dot(cross(u[0], u[1]), u[2]) - 1) > ORIENTATION, "invalid_orientation")
    return status.otherwise("ok")


def volume(origin: Column, axes: tuple, spacing: tuple, size: tuple) -> Column:
    """A grid: origin, three unit axes, spacing and size along each."""
    number = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(origin.alias("origin"), F.array(*(unit(a) for a in axes)).alias("axes"), F.array(*map(number, spacing)).alias("spacing"), F.array(*map(number, size)).alias("size"))


def plane(origin: Column, axes: tuple, spacing: tuple, size: tuple) -> Column:
    """A grid of one slice whose third axis is the normal, in steps of 1 mm."""
    return volume(origin, (*axes, cross(*axes)), (*spacing, 1.0), (*size, 1.0))


def grid_to_world(grid: Column, index: Column) -> Column:
    """Numbers alone, no loops over arrays, so that it is compiled."""
    step = lambda k, c: grid["axes"][k][c] * index[k] * grid["spacing"][k]
    return F.array(*(grid["origin"][c] + (step(0, c) + (step(1, c) + step(2, c))) for c in range(3)))


def grid_to_index(grid: Column, world: Column) -> Column:
    d = minus(world, grid["origin"])
    return F.when(grid.isNotNull(), F.array(*(dot(d, grid["axes"][k]) / grid["spacing"][k] for k in range(3))))


def grid_to_grid(source: Column, target: Column, index: Column) -> Column:
    """An index of one grid as an index of another: any pair of planes and volumes."""
    return grid_to_index(target, grid_to_world(source, index))


def grid_matrix(grid: Column) -> Column:
    """Index to world as 16 numbers, row by row."""
    column = lambda k: F.transform(grid["axes"][k], lambda v: v * grid["spacing"][k])
    rows = [x for r in range(3) for x in (*(column(k)[r] for k in range(3)), grid["origin"][r])]
    return F.array(*rows, *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def grid_contains(grid: Column, index: Column) -> Column:
    """Half-voxel edges in each direction."""
    return F.forall(F.arrays_zip(index.alias("i"), grid["size"].alias("n")), lambda x: contains_index(x["i"], x["n"]))


def corners(grid: Column, flat: bool) -> Column:
    """World points of the outer corners: four of a plane, eight of a volume."""
    ends = [(F.lit(-0.5), grid["size"][k] - 0.5) for k in range(2)] + [(F.lit(0.0),) if flat else (F.lit(-0.5), grid["size"][2] - 0.5)]
    return F.array(*(grid_to_world(grid, F.array(i, j, k)) for k in ends[2] for j in ends[1] for i in ends[0]))


def index_range(low: Column, high: Column, size: Column, tolerance: Column) -> Column:
    """Whole indexes within bounds as [start, end), or null."""
    start, end = (F.least(F.greatest(F.ceil(v), F.lit(0)), size.cast("long")) for v in (low - tolerance - 0.5, high + tolerance + 0.5))
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def volumetric_status(value: Column) -> Column:
    """Whether a frame with these volumetric properties is a regular plane."""
    return (
        F.when(value == "VOLUME", "ok").when(value == "SAMPLED", "sampled_frame_geometry").when(value == "DISTORTED", "distorted_frame_geometry")
        .when(value == "MIXED", "mixed_volumetric_properties").otherwise("unknown_volumetric_properties")
    )


def index_to_world(origin: Column, row_axis: Column, column_axis: Column, spacing: Column, i: Column, j: Column) -> Column:
    return plus(origin, plus(scaled(row_axis, i * spacing), scaled(column_axis, j * spacing)))


def world_to_index(origin: Column, row_axis: Column, column_axis: Column, spacing: Column, world: Column) -> Column:
    d = minus(world, origin)
    return F.array(dot(d, row_axis) / spacing, dot(d, column_axis) / spacing)


def normal_distance(origin: Column, normal: Column, world: Column) -> Column:
    return dot(minus(world, origin), normal)


def contains_index(index: Column, size: Column) -> Column:
    """Half-voxel edges: from -0.5 to below size - 0.5."""
    return (index >= -0.5) & (index < size - 0.5)


def overlay_status(dot_normals: Column, distance: Column, overlap: Column, direct: Column, same_spacing: Column, same_size: Column) -> Column:
    """The plane to plane ladder, in its order."""
    return (
        F.when(F.abs(dot_normals) < 1 - ORIENTATION, "non_parallel").when(dot_normals < 0, "opposite_normal").when(F.abs(distance) > POSITION, "out_of_plane").when(~overlap, "different_extent")
        .when(direct, "compatible").when(~same_spacing, "different_spacing").when(~same_size, "different_extent").otherwise("requires_resampling")
    )
