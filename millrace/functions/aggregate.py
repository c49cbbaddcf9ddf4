"""Aggregates of a user's own in Python, merged in a tree.

An aggregate has four steps: `init` gives an empty state, `update` adds the rows of one key in one Arrow batch, `merge` joins two states and `finish`
turns a state into the values of the result. Each task holds one state for each key that it meets and gives them out at its end, so one state for a
task and key is shuffled, not rows. A key's states then meet in two rounds, those of `fan_in` tasks at a time first, so a key that all tasks hold is not
merged by one of them alone.

Memory: a task with over `max_states` keys gives its states out and begins again; they meet later all the same. States are pickled between the steps, so that
they may be any Python value. Groups with null keys are groups; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType


class Aggregate(Protocol):
    def init(self) -> Any: ...

    def update(self, state: Any, rows: pa.RecordBatch) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> tuple: ...


def _same(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def _groups(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The keys of a batch, whose first n columns they are, and the places of their rows."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in range(n):
        own = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield tuple(batch.column(k)[int(places[0])].as_py() for k in range(n)), places


def _states(aggregate: Aggregate, n: int, schema: pa.Schema, max_states: int):
    def out(task, held):
        rows = list(held.values())
        columns = [pa.array([key[k] for key, _ in rows], schema[k].type) for k in range(n)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(rows), pa.int32()), pa.array([pickle.dumps(s) for _, s in rows], pa.binary())], schema=schema)

    def run(batches):
        held, task = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            task = b.column(n)[0].as_py()
            for key, places in _groups(b, n):
                same = tuple(map(_same, key))
                state = held[same][1] if same in held else aggregate.init()
                held[same] = key, aggregate.update(state, b.take(pa.array(places)).select(range(n + 1, b.num_columns)))
            if len(held) > max_states:
                yield out(task, held)
                held = {}
        if held:
            yield out(task, held)

    return run


def _merged(aggregate: Aggregate, n: int, schema: pa.Schema, last: bool):
    """Function of states sorted by key (and group): one for each, or its results if it is the last round."""

    def out(key, group, state):
        values = aggregate.finish(state) if last else (group, pickle.dumps(state))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *values), schema)], schema=schema)

    def run(batches):
        now, key, group, state = None, None, None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *own, task, data in zip(*columns):
                same = (*map(_same, own), None if last else task)
                if same != now:
                    if now is not None:
                        yield out(key, group, state)
                    now, key, group, state = same, own, task, pickle.loads(data)
                else:
                    state = aggregate.merge(state, pickle.loads(data))
        if now is not None:
            yield out(key, group, state)

    return run


def aggregated(rows: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, returns: str, *, fan_in: int = 32, max_states: int = 20_000) -> DataFrame:
    """(keys, the columns of `returns`): the aggregate of the columns of each key's rows. `aggregate` is pickled to the tasks."""
    n = len(keys)
    names = [f"k{i}" for i in range(n)]
    result = StructType.fromDDL(returns)
    own = rows.select(*[F.col(k).alias(x) for k, x in zip(keys, names)], F.spark_partition_id().alias("task"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    kept = StructType([own.schema[x] for x in names])
    held = StructType([*kept.fields, StructField("task", IntegerType()), StructField("state", BinaryType())])
    states = own.mapInArrow(_states(aggregate, n, to_arrow_schema(held), max_states), held)
    near = states.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).repartition(*names, "task").sortWithinPartitions(*names, "task")
    near = near.mapInArrow(_merged(aggregate, n, to_arrow_schema(held), False), held)
    spread = near.repartition(*names).sortWithinPartitions(*names) if names else near.coalesce(1)
    final = StructType(kept.fields + result.fields)
    out = spread.mapInArrow(_merged(aggregate, n, to_arrow_schema(final), True), final)
    return out.select(*[F.col(x).alias(k) for x, k in zip(names, keys)], *result.names)


class Covariance:
    """Means and centred products of vectors, merged without loss of digits; gives n, the trace of the covariance (divisor n) and its largest entry off the diagonal."""

    def init(self):
        return 0, 0.0, 0.0

    def update(self, state, rows):
        x = rows.column(0).drop_null()
        if not len(x):
            return state
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        mean = x.mean(axis=0)
        return self.merge(state, (len(x), mean, (x - mean).T @ (x - mean)))

    def merge(self, state, other):
        (n, mean, products), (m, more, others) = state, other
        if not n or not m:
            return other if m else state
        apart = more - mean
        return n + m, mean + apart * (m / (n + m)), products + others + np.outer(apart, apart) * (n * m / (n + m))

    def finish(self, state):
        n, _, products = state
        if not n:
            return 0, None, None
        cov = products / n
        off = np.abs(cov - np.diag(np.diag(cov))).max()
        return n, float(np.trace(cov)), float(off)
