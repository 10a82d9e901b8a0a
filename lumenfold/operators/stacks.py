"""Ordered slice stacks: gaps, duplicates, uniform runs, statuses (WIN, AGG-3..6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 1e-3


def gaps(slices: DataFrame, keys: list[str], position: str, ties: list[str] = ()) -> DataFrame:
    """Adds ordinal (from 0) and gap (to the slice before; null for the first). A stack is one group, bounded by its number of slices."""
    w = W.partitionBy(*keys).orderBy(position, *ties)
    return slices.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("gap", F.col(position) - F.lag(position).over(w))


def analysis(slices: DataFrame, keys: list[str], position: str, ties: list[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """One row per stack: n_slices, first_gap (positive), n_duplicates, n_uneven, uniform, status. A duplicate outranks uneven spacing."""
    g = gaps(slices, keys, position, ties)
    first = F.min_by(F.when(F.col("gap") > tolerance, F.col("gap")), F.when(F.col("gap") > tolerance, F.col("ordinal")))
    anchored = g.withColumn("anchor", first.over(W.partitionBy(*keys)))
    out = anchored.groupBy(*keys).agg(
        F.count("*").alias("n_slices"),
        F.max("anchor").alias("first_gap"),
        F.sum((F.col("gap") <= tolerance).cast("long")).alias("n_duplicates"),
        F.sum(((F.col("gap") > tolerance) & (F.abs(F.col("gap") - F.col("anchor")) > tolerance)).cast("long")).alias("n_uneven"),
    ).fillna(0, ["n_duplicates", "n_uneven"])
    status = F.when(F.col("n_duplicates") > 0, "duplicate_position").when(F.col("n_uneven") > 0, "non_uniform_spacing").otherwise("ok")
    return out.withColumn("status", status).withColumn("uniform", (F.col("status") == "ok") & F.col("first_gap").isNotNull())


def uniform_runs(slices: DataFrame, keys: list[str], position: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, run_start, run_end, run_gap): runs of at least three slices whose gaps are within tolerance of the run's first gap."""
    p = F.sort_array(F.collect_list(F.col(position).cast("double")))
    folded = slices.groupBy(*keys).agg(p.alias("_p"))
    kind = "struct<runs:array<struct<s:int,e:int,g:double>>,s:int,g:double>"
    start = F.from_json(F.lit('{"runs":[],"s":0}'), kind)
    ordinals = F.when(F.size("_p") > 1, F.sequence(F.lit(1), F.size("_p") - 1)).otherwise(F.array().cast("array<int>"))

    def close(acc: Column, end: Column) -> Column:
        run = F.struct(acc["s"].alias("s"), end.cast("int").alias("e"), acc["g"].alias("g"))
        return F.when(end - acc["s"] >= 2, F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"])

    def step(acc: Column, i: Column) -> Column:
        gap = F.get(F.col("_p"), i) - F.get(F.col("_p"), i - 1)
        goes_on = acc["g"].isNotNull() & (gap > tolerance) & (F.abs(gap - acc["g"]) <= tolerance)
        fresh = F.struct(close(acc, i - 1).alias("runs"), F.when(gap > tolerance, i - 1).otherwise(i).cast("int").alias("s"), F.when(gap > tolerance, gap).alias("g"))
        return F.when(goes_on, acc).otherwise(fresh)

    runs = folded.withColumn("_r", F.aggregate(ordinals, start, step, lambda acc: close(acc, F.size("_p") - 1)))
    return runs.select(*keys, F.explode("_r").alias("r"), "_p").select(*keys, F.get("_p", F.col("r.s")).alias("run_start"), F.get("_p", F.col("r.e")).alias("run_end"), F.col("r.g").alias("run_gap"))


def frame_lengths(offsets: DataFrame, keys: list[str], offset: str, end: str) -> DataFrame:
    """Length of each frame: to the next offset, the last to the end; null, with a frame_error, where the end comes before the offset."""
    w = W.partitionBy(*keys).orderBy(offset)
    length = F.coalesce(F.lead(offset).over(w), F.col(end)) - F.col(offset)
    out = offsets.withColumn("frame_length", length)
    wrong = F.col("frame_length") < 0
    return out.withColumn("frame_error", F.when(wrong, "the end is before the offset")).withColumn("frame_length", F.when(~wrong, F.col("frame_length")))


def groups(frames: DataFrame, keys: list[str], member: str, order: list[str]) -> DataFrame:
    """One row per key with its members in order; a group is one stack."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, member)))
    return frames.groupBy(*keys).agg(F.count("*").alias("n_members"), F.transform(ordered, lambda s: s[member]).alias("members"))


def median_gap(slices: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Median of positive gaps; stacks without one are left out."""
    return gaps(slices, keys, position).filter("gap > 0").groupBy(*keys).agg(F.median("gap").alias("median_gap"))


def worst_status(rows: DataFrame, keys: list[str], status: str, priority: list[str]) -> DataFrame:
    """The status that comes first in priority."""
    rank = F.array_position(F.array(*(F.lit(s) for s in priority)), F.col(status))
    return rows.groupBy(*keys).agg(F.min_by(status, rank).alias("worst_status"))
