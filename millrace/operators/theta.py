"""Joins on inequalities alone, without an equality to join by.

Spark plans such a join as a nested loop over both tables. Here rows beyond the other side's least or greatest value go first. What is left of each side is
range-partitioned into cells of some `rows_per_cell` rows by the first condition's column (Spark samples the splitters, and a hash tells equal values apart, so that a value held by a third of the rows fills
several even cells). The least and greatest value of every condition's columns in each cell come to the driver, two numbers for a
cell and condition, and tell which pairs of cells can meet at all. Only those pairs are made, in blocks: both cells are cut by the hash into slices of some `rows_per_slice` rows, of
which every two meet. A task gets blocks of some `per_task` pairs of rows in all, so its work is the same at any size of the tables; that of all tasks
grows as the pairs do. Within a block the right side is sorted once for each condition. A left row's partners under a
condition are then one run of that order; the condition with the fewest candidates is followed, the others are checked on them.

A task holds one right slice and gives its pairs out in pieces. Rows with a null in a condition's column match nothing. NaN equals NaN and is above all numbers, as in Spark. Columns
of the two sides have different names; those of a condition are of one type: whole numbers, doubles, dates or times. Repeated rows each have their pairs;
empty sides give none.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.operators.hashing import row_hash
from millrace.sources.scratch import written

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Tasks at most, a bound on the shuffle; beyond it they grow
MAX_TASKS = 100_000
TYPES = ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz")


def ordinal(column: pa.Array) -> np.ndarray:
    """Values without nulls as longs of the same order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_floating(column.type):
        x = column.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
        x = np.where(np.isnan(x), np.nan, x)  # one NaN
        bits = x.view(np.int64)
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    if pa.types.is_date(column.type):
        column = column.cast(pa.int32())
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _ends(rows: DataFrame, columns: list[str]) -> pa.Table:
    """The least (a) and greatest (b) value of each column: for each cell if rows have cells, with their number."""
    most = [f(f"`{c}`").alias(f"{name}{i}") for i, c in enumerate(columns) for f, name in ((F.min, "a"), (F.max, "b"))]
    return (rows.groupBy("cell") if "cell" in rows.columns else rows).agg(F.count(F.lit(1)).alias("n"), *most).toArrow()


def _reaching(side: DataFrame, columns: list[str], ops: list[str], ends: pa.Table) -> DataFrame:
    """Rows that hold for the other side's most favourable values."""
    far = side.sparkSession.createDataFrame(ends)
    for i, (c, op) in enumerate(zip(columns, ops)):
        side = side.where(OPS[op](F.col(f"`{c}`"), far.select(f"b{i}" if op in ("<", "<=") else f"a{i}").scalar()))
    return side


def _celled(known: DataFrame, columns: list[str], keep: list[str], rows_per_cell: int, max_cells: int) -> DataFrame:
    cells = max(1, min(max_cells, -(-known.count() // rows_per_cell)))
    rows = known.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)], row_hash(known).alias("tie"))
    rows = rows.repartitionByRange(cells, "k0", "tie")
    return written(rows.select(F.spark_partition_id().alias("cell"), "*"), "cells")


def _reach(celled: DataFrame, n: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Cells, for each condition the least and greatest of each, as longs, and their rows."""
    ends = _ends(celled, [f"k{i}" for i in range(n)])
    get = lambda name: [ordinal(ends[f"{name}{i}"]) for i in range(n)]
    return ends["cell"].to_pylist(), get("a"), get("b"), ends["n"].to_numpy()


def meeting(left: tuple, right: tuple, ops: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cells that can meet, left and right."""
    (cells, low, high), (others, from_, to) = left[:3], right[:3]
    found = []
    for x in range(len(cells)):
        fits = np.ones(len(others), bool)
        for i, op in enumerate(ops):
            fits &= {"<": low[i][x] < to[i], "<=": low[i][x] <= to[i], ">": high[i][x] > from_[i], ">=": high[i][x] >= from_[i]}[op]
        found.append(np.flatnonzero(fits))
    return np.repeat(np.arange(len(cells)), [len(f) for f in found]), np.concatenate(found) if found else np.zeros(0, np.int64)


def _runs(sorted_keys: np.ndarray, own: np.ndarray, op: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each own key's partners in the other side's order."""
    n = len(sorted_keys)
    if op in ("<", "<="):
        return np.searchsorted(sorted_keys, own, "right" if op == "<" else "left"), np.full(len(own), n)
    return np.zeros(len(own), np.int64), np.searchsorted(sorted_keys, own, "left" if op == ">" else "right")


class _Cell:
    """The right side of one block."""

    def __init__(self, batches: list[pa.RecordBatch], n: int, ops: list[str]):
        self.rows = pa.concat_arrays([b.column(3) for b in batches])
        self.keys = [np.concatenate([ordinal(b.column(4 + i)) for b in batches]) for i in range(n)]
        self.order = [np.argsort(k, kind="stable") for k in self.keys]
        self.sorted = [k[o] for k, o in zip(self.keys, self.order)]
        self.ops = ops

    def pairs(self, b: pa.RecordBatch, chunk: int):
        own = [ordinal(b.column(4 + i)) for i in range(len(self.ops))]
        runs = [_runs(s, k, op) for s, k, op in zip(self.sorted, own, self.ops)]
        best = min(range(len(runs)), key=lambda i: int((runs[i][1] - runs[i][0]).sum()))
        start, stop = runs[best]
        size = np.maximum(stop - start, 0)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
            n = size[at:to]
            x = np.repeat(np.arange(at, to), n)
            y = self.order[best][np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)]
            fits = np.ones(len(x), bool)
            for i, op in enumerate(self.ops):
                if i != best:
                    p, q = own[i][x], self.keys[i][y]
                    fits &= {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]
            if fits.any():
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(x[fits])), self.rows.take(pa.array(y[fits]))], ["l", "r"])
            at = to


def _joiner(ops: list[str], chunk: int):
    def run(batches):
        now, held, cell = None, [], None
        for b in batches:
            block, side = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, b.num_rows]):
                if stop == start:
                    continue
                part = b.slice(start, stop - start)
                if block[start] != now:
                    now, held, cell = block[start], [], None
                if side[start] == 0:
                    held.append(part)
                elif held:
                    cell = cell or _Cell(held, len(ops), ops)
                    yield from cell.pairs(part, chunk)

    return run


def _blocks(left: tuple, right: tuple, ops: list[str], rows_per_slice: int, per_task: int) -> tuple[pa.Table, int]:
    """Pairs of cells that meet, with their slices, the number of their first block, and the tasks as a line: the first block's place and a block's length. The number of tasks."""
    x, y = meeting(left, right, ops)
    n, m = left[3][x], right[3][y]
    slices = -(-n // rows_per_slice), -(-m // rows_per_slice)
    blocks, work = slices[0] * slices[1], n.astype(float) * m
    per_task = max(per_task, work.sum() / MAX_TASKS)
    before = lambda v: np.cumsum(v) - v
    cells = lambda side, at: pa.array(np.array(side[0], np.int32)[at] if len(at) else [], pa.int32())
    table = {"left": cells(left, x), "right": cells(right, y), "left_slices": pa.array(slices[0], pa.int64()), "right_slices": pa.array(slices[1], pa.int64()), "first": pa.array(before(blocks), pa.int64())}
    table |= {"place": pa.array(before(work) / per_task, pa.float64()), "length": pa.array(work / per_task / np.maximum(blocks, 1), pa.float64())}
    return pa.table(table), int(work.sum() // per_task) + 1


def theta(left: DataFrame, right: DataFrame, on: list[tuple[str, str, str]], *, keep: list[str] | None = None, rows_per_cell: int = 20_000, max_cells: int = 4_096, rows_per_slice: int = 4_096, per_task: int = 1 << 26, chunk: int = 1 << 16) -> DataFrame:
    """Pairs of rows for which all (left column, <, <=, > or >=, right column) hold; `keep` names the columns that are returned, else all are.

    The first condition's columns deal the cells, so it should be the one that leaves the fewest of them to meet. Beyond
    rows_per_cell * max_cells rows cells grow, and have more slices.
    """
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    for a, op, b in on:
        kinds = [d.schema[c].dataType for d, c in ((left, a), (right, b))]
        if op not in FLIP or kinds[0] != kinds[1] or kinds[0].typeName() not in TYPES:
            raise TypeError(f"{a} {op} {b} is no comparison of two columns of one type")
    spark, ops = left.sparkSession, [op for _, op, _ in on]
    columns = [x for x, _, _ in on], [y for _, _, y in on]
    known = [d.where(" and ".join(f"`{c}` is not null" for c in dict.fromkeys(own))) for d, own in zip((left, right), columns)]
    far = [_ends(d, own) for d, own in zip(known, columns)]
    known = _reaching(known[0], columns[0], ops, far[1]), _reaching(known[1], columns[1], [FLIP[op] for op in ops], far[0])
    a, b = (_celled(d, own, [c for c in d.columns if keep is None or c in keep], rows_per_cell, max_cells) for d, own in zip(known, columns))
    blocks, tasks = _blocks(_reach(a, len(on)), _reach(b, len(on)), ops, rows_per_slice, per_task)
    pairs = spark.createDataFrame(blocks)
    keys = [f"k{i}" for i in range(len(on))]
    none = lambda d: F.lit(None).cast(d.schema["row"].dataType)

    def dealt(d: DataFrame, own: str, other: str, place, row: list) -> DataFrame:
        """Each row in the blocks of its slice; place tells a block's from its own slice and the other's."""
        met = d.join(pairs.withColumnRenamed(own, "cell"), "cell").withColumn("mine", F.expr(f"pmod(tie, {own}_slices)"))
        met = met.withColumn("theirs", F.explode(F.expr(f"sequence(0L, {other}_slices - 1)"))).withColumn("at", place)
        return met.select(F.floor(F.col("place") + F.col("at") * F.col("length")).cast("int").alias("task"), (F.col("first") + F.col("at")).alias("block"), *row, *keys)

    ours = dealt(a, "left", "right", F.expr("mine * right_slices + theirs"), [F.lit(1).alias("side"), F.col("row").alias("l"), none(b).alias("r")])
    theirs = dealt(b, "right", "left", F.expr("theirs * right_slices + mine"), [F.lit(0).alias("side"), none(a).alias("l"), F.col("row").alias("r")])
    met = theirs.union(ours).repartitionById(tasks, "task").drop("task").sortWithinPartitions("block", "side")
    schema = StructType([StructField("l", a.schema["row"].dataType), StructField("r", b.schema["row"].dataType)])
    return met.mapInArrow(_joiner(ops, chunk), schema).select("l.*", "r.*")
