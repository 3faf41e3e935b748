"""Fit rows of several plans as numpy blocks, and sums over them by plan.

Models that need one aggregation per step (boosting, logistic regression) fit all
plans (CV folds and the final fit) together: the plan is a key of the aggregation, so a
step is one Spark job whatever the number of plans.  A block holds up to ``ROWS`` rows
of one plan as raw arrays; a step computes one small array per task and key with
numpy, and Spark adds these up by key.  What reaches the driver has a size fixed by the
model's parameters, not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

ROWS = 8192
TASK_ROWS = 4 * ROWS   # what a task holds at least, where there are enough rows
DIRECT, SUM_TASKS = 16, 8


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plan = batch.column("plan").to_numpy()
        for p in np.unique(plan):
            rows = np.flatnonzero(plan == p)
            for lo in range(0, len(rows), ROWS):
                part = batch.take(pa.array(rows[lo:lo + ROWS]))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(p)], pa.int32()), pa.array([part.num_rows], pa.int32()),
                    pa.array([part.column("id").to_numpy().tobytes()], pa.binary()),
                    pa.array([part.column("y").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                    names=["plan", "n", "id", "y", "x"])


def blocks(fits: list[DataFrame], key: str = "CustomerID") -> DataFrame:
    """(plan, n, id int64[n], y float64[n], x float64[n × d]): the rows of every plan;
    fits: (key, label, x array<double>).  Written to the shared checkpoint folder."""
    rows = None
    for p, fit in enumerate(fits):
        one = fit.select(F.lit(p).alias("plan"), F.col(key).cast("long").alias("id"), F.col("label").cast("double").alias("y"), "x")
        rows = one if rows is None else rows.unionByName(one)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(tasks).mapInArrow(_pack, "plan int, n int, id binary, y binary, x binary").checkpoint(eager=True)


def arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, their fields as arrays (bytes: ``bins``)."""
    for row in batch.to_pylist():
        yield {k: np.frombuffer(v, np.int64 if k == "id" else np.uint8 if k == "bins" else np.float64) if isinstance(v, bytes) else v
               for k, v in row.items()}


def opened(df: DataFrame) -> RDD:
    """The blocks of ``df``, a written frame, as dicts of arrays in as many tasks as they
    fill."""
    tasks = max(1, math.ceil((df.agg(F.sum("n")).first()[0] or 0) / TASK_ROWS))

    def run(rows: Iterator[Row]) -> Iterator[dict]:
        for row in rows:
            yield {k: np.frombuffer(v, np.int64 if k == "id" else np.uint8 if k == "bins" else np.float64) if isinstance(v, (bytes, bytearray)) else v
                   for k, v in row.asDict().items()}
    return df.coalesce(tasks).rdd.mapPartitions(run)


def kept(df: DataFrame) -> RDD:
    """``opened`` blocks, kept over the steps of a fit (``unpersist`` them after)."""
    return opened(df).persist(StorageLevel.MEMORY_AND_DISK)


def sums(data: RDD, add_to: Callable[[dict, dict[int, np.ndarray]], None]) -> dict[int, np.ndarray]:
    """key → sum over all blocks.  ``add_to`` adds one block to a task's arrays by key; a
    task emits each once.  A step is one short job on kept blocks: nothing is planned or
    compiled anew.  Up to ``DIRECT`` tasks' arrays are added up as they arrive, more of
    them by Spark, key by key."""
    def run(part: int, blocks: Iterator[dict]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        held: dict[int, np.ndarray] = {}
        for block in blocks:
            add_to(block, held)
        return iter([(k, (part, v)) for k, v in held.items()])

    def total(parts) -> np.ndarray:
        ordered = [v for _, v in sorted(parts, key=lambda p: p[0])]  # always added in the same order
        out = ordered[0].astype(np.float64)
        for v in ordered[1:]:
            out += v
        return out
    found = data.mapPartitionsWithIndex(run)
    if data.getNumPartitions() > DIRECT:
        return dict(found.groupByKey(SUM_TASKS).mapValues(total).collect())
    by_key: dict[int, list] = {}
    for k, v in found.collect():
        by_key.setdefault(k, []).append(v)
    return {k: total(v) for k, v in by_key.items()}
