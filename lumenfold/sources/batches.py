"""Rows dealt to tasks before costly work, and rows of records gathered into Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of values after which a batch leaves the worker; one larger row is a batch of its own.
ROWS, BYTES = 4096, 4 << 20
#: Bytes of a table's files (keys and names take a few a row) for one task, tasks a core, and bytes a core from which a table's own splits are enough.
TASK_BYTES, TASKS, SPLIT_BYTES = 8 << 10, 4, 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to as many tasks as costly work on each row needs.

    A narrow table has a million rows in one row group, which one task reads, so without this one core would do all the work on them. Tables beyond 32 MB a core have enough
    splits of their own, and rows that were dealt once or come out of a worker are not dealt again. Best called before wide columns are computed, which would be shuffled.
    """
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size, cores = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())), rows.sparkSession.sparkContext.defaultParallelism
    if not TASK_BYTES < size < SPLIT_BYTES * cores or any(step in plan.toString() for step in ("Repartition", "MapInArrow")):
        return rows
    return rows.repartition(min(-(-size // TASK_BYTES), TASKS * cores))


def _weight(value) -> int:
    if isinstance(value, (bytes, str)):
        return len(value)
    return sum(map(_weight, value.values() if isinstance(value, dict) else value)) if isinstance(value, (list, tuple, dict)) else 8


def batched(schema: pa.Schema, rows: Iterable[tuple], limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += _weight(row)
        if size >= limit or len(held) >= ROWS:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
