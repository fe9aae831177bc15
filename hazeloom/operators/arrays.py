"""Sums of arrays: every task makes one array of its rows, and arrays are added element by element."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.session import kept

#: Arrays that one task adds.
FAN_IN = 64
#: Rows that a task holds as matrices at once (or one unit's, if these are more).
SLICE = 200_000
ARRAYS = pa.schema([("key", pa.int64()), ("task", pa.int64()), ("sums", pa.list_(pa.float64()))])


def task_arrays(df: DataFrame, of_batch: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> DataFrame:
    """key, task, sums: what ``of_batch`` makes of a task's batches (an array for each of a few keys), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, array in of_batch(batch).items():
                own[key] = own[key] + array if key in own else np.array(array, float)
        task = TaskContext.get().partitionId()
        if own:
            lists = pa.array([a.ravel() for a in own.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([task] * len(own), pa.int64()), lists], schema=ARRAYS)

    return df.mapInArrow(run, "key long, task long, sums array<double>")


def merged(arrays: DataFrame) -> DataFrame:
    """key, sums: task_arrays() added up, FAN_IN arrays of a key to a task in each round."""

    def add(group: pa.Table) -> pa.Table:
        rows = group["sums"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
        return pa.Table.from_arrays([group["key"][:1], pa.array([group["part"][0].as_py()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], schema=ARRAYS)

    arrays = kept(arrays)
    tasks = (arrays.agg({"task": "max"}).first()[0] or 0) + 1
    while True:
        arrays = arrays.selectExpr("key", f"task div {FAN_IN} AS part", "sums").groupBy("key", "part").applyInArrow(add, "key long, task long, sums array<double>")
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            return arrays.select("key", "sums")


def summed(df: DataFrame, of_batch: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """merged() of a few short arrays, on the driver."""
    return {r["key"]: np.array(r["sums"]) for r in merged(task_arrays(df, of_batch)).collect()}


def matrix_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns of a batch side by side, nulls as NaN."""
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if batch.num_rows else np.empty((0, len(names)))


def gram(df: DataFrame, xs: Sequence[str], ys: Sequence[str] = (), weight: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX, X'WY and n, from one small matrix a task; for many terms."""
    names, k = [*xs, *ys], len(xs)

    def of_batch(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        m = matrix_of(batch, [*names, *([weight] if weight else [])])
        x = m[:, : len(names)]
        w = m[:, -1:] if weight else 1.0
        return {0: np.append((x[:, :k].T @ (x * w)).ravel(), len(x))}

    got = summed(df.select(*names, *([weight] if weight else [])), of_batch).get(0, np.zeros(k * len(names) + 1))
    both = got[:-1].reshape(k, len(names))
    return both[:, :k], both[:, k:], int(got[-1])


def unit_rows(df: DataFrame, units: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The units and _rows, an array of the columns of a unit's rows; kept, so that a task reads whole units without a shuffle."""
    return kept(df.groupBy(*units).agg(F.collect_list(F.struct(*columns)).alias("_rows")))


def unit_slices(batch: pa.RecordBatch, most_units: int = SLICE) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(first row of each unit, columns) of unit_rows(), some whole units at a time."""
    lists = batch.column(batch.num_columns - 1)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, min(first + most_units, int(np.searchsorted(ends, before + SLICE, "right"))))
        part = lists.slice(first, last - first)
        yield np.append(0, ends[first : last - 1] - before), [c.to_numpy(zero_copy_only=False) for c in part.flatten().flatten()]
        first = last
