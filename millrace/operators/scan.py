"""Running values in a global order, evenly spread whatever the keys: a distributed prefix scan.

A window over a key is one task for each key, so a key that holds a third of the table is a task that holds a third of it. Here rows are
range-partitioned by the whole order (Spark samples the splitters; rows that tie are told by a hash of all columns), sorted, and scanned
once in Arrow batches. Each partition also gives one summary row: its first and last keys and the state of each running value at its end. The summaries, one
row for each partition, are folded in order on the driver, and what a partition inherits comes back by a broadcast of that many rows: only rows of a partition's first
group take it. So there is one shuffle, no task for a whole key, and a task holds one batch at a time.

A running value is over a group of rows that agree in the first `within` columns of the order: 0 is the whole table. Kinds:

* count: rows so far; sum, min, max: of the column's values that are not null so far, null before the first,
* last: the last value that is not null so far; before: the value of the row before, null for a group's first,
* changes: how many distinct values the first `of` order columns had so far.

Sums and extremes are of integers (64 bits) or doubles. Nulls and NaN are equal to themselves; nulls come first, or last in a descending column. Order
columns may be of any type that has an order but arrays and structs. Rows equal in all columns (maps left out) are not told apart and stay in one partition. An empty table
gives no rows. Column names clash with nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from millrace.operators.hashing import row_hash
from millrace.sources.scratch import n_parts, written

KINDS = ("count", "sum", "min", "max", "last", "before", "changes")


@dataclass(frozen=True)
class Running:
    kind: str
    column: str | None = None
    within: int = 0
    of: int = 0


def _differs(now: pa.Array, then: pa.Array) -> np.ndarray:
    """Whether values differ, nulls and NaN being equal to themselves."""
    out = pc.fill_null(pc.not_equal(now, then), False)
    out = pc.or_(out, pc.xor(pc.is_null(now), pc.is_null(then)))
    if pa.types.is_floating(now.type):
        out = pc.and_(out, pc.invert(pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(then), False))))
    return out.to_numpy(zero_copy_only=False)


def _joined(*parts: pa.Array) -> pa.Array:
    return pa.concat_arrays([p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in parts])


class _Segments:
    """The groups of a batch for one number of leading columns."""

    def __init__(self, new: np.ndarray):
        n = len(new)
        self.new, self.number = new, np.cumsum(new)  # 0: the group of the batch before goes on
        at = np.arange(n)
        self.start = np.maximum.accumulate(np.where(new, at, 0)) if n else at
        self.goes_on = self.number == 0


class _State:
    """One running value through a partition."""

    def __init__(self, op: Running):
        self.op, self.held, self.n = op, None, 0

    def run(self, seg: _Segments, news: dict[int, np.ndarray], column: pa.Array | None) -> pa.Array:
        return getattr(self, "_" + ("fold" if self.op.kind in ("sum", "min", "max") else self.op.kind))(seg, news, column)

    def _count(self, seg, news, column):
        out = np.arange(len(seg.new)) - seg.start + 1 + np.where(seg.goes_on, self.held or 0, 0)
        self.held = int(out[-1])
        return pa.array(out, pa.int64())

    def _changes(self, seg, news, column):
        total = np.cumsum(news[self.op.of])
        base = np.where(seg.goes_on, -(self.held or 0), total[seg.start] - 1)
        out = total - base
        self.held = int(out[-1])
        return pa.array(out, pa.int64())

    def _fold(self, seg, news, column):
        kind, whole = self.op.kind, pa.types.is_integer(column.type)
        reach = np.iinfo(np.int64) if whole else None
        empty = 0 if kind == "sum" else (reach.max if whole else math.inf) if kind == "min" else (reach.min if whole else -math.inf)
        known = pc.is_valid(column).to_numpy(zero_copy_only=False)
        values = pd.Series(pc.fill_null(column, empty).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64))
        by = values.groupby(seg.number, sort=False)
        nan = None
        if not whole:  # NaN is above all numbers, and makes a sum NaN
            nan = np.isnan(values.to_numpy())
            by = values.where(~nan, empty).groupby(seg.number, sort=False)
            nans = pd.Series(nan.astype(np.int64)).groupby(seg.number, sort=False).cumsum().to_numpy()
        out = {"sum": by.cumsum, "min": by.cummin, "max": by.cummax}[kind]().to_numpy()
        seen = pd.Series(known.astype(np.int64)).groupby(seg.number, sort=False).cumsum().to_numpy()
        if nan is not None and nan.any():
            out = np.where((nans > 0) if kind != "min" else (nans == seen) & (seen > 0), math.nan, out)
        if self.held is not None:
            out = np.where(seg.goes_on, _combined(kind, self.held, out, seen), out)
            seen = np.where(seg.goes_on, np.maximum(seen, 1), seen)
        self.held = out[-1].item() if seen[-1] else None
        return pa.array(out, mask=seen == 0)

    def _last(self, seg, news, column):
        at = np.arange(len(column))
        known = np.maximum.accumulate(np.where(pc.is_valid(column).to_numpy(zero_copy_only=False), at, -1))
        own = known >= seg.start
        before = pa.array([self.held], column.type) if self.held is not None else pa.nulls(1, column.type)
        return self._taken(before, column, np.where(own, known + 1, np.where(seg.goes_on, 0, -1)))

    def _before(self, seg, news, column):
        before = pa.array([self.held], column.type) if self.held is not None else pa.nulls(1, column.type)
        out = _joined(before, column).take(pa.array(np.arange(len(column)), mask=seg.new))
        self.held = column[-1].as_py()
        return out

    def _taken(self, before, column, places):
        out = _joined(before, column).take(pa.array(np.maximum(places, 0), mask=places < 0))
        self.held = out[-1].as_py()
        return out


def _combined(kind: str, held, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """held and then own, of which the first `seen` say nothing yet."""
    if kind == "sum":
        return own + held
    up = kind == "max"
    if isinstance(held, float) and math.isnan(held):
        return np.full(len(own), held) if up else np.where(seen > 0, own, held)
    with np.errstate(invalid="ignore"):
        better = np.maximum(own, held) if up else np.where(np.isnan(own), held, np.minimum(own, held)) if own.dtype.kind == "f" else np.minimum(own, held)
    return np.where(seen > 0, better, held)


def _levels(ops: list[Running]) -> list[int]:
    return sorted({o.within for o in ops} | {o.of for o in ops if o.kind == "changes"})


def _scanner(ops: list[Running], order: list[int], columns: dict[int, int], schema: pa.Schema):
    """Function of a sorted partition's batches: each row with its running values and whether its groups are the partition's first; at the end the summary."""
    levels = _levels(ops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, last, first = [_State(o) for o in ops], None, None
        firsts = {m: True for m in levels}
        part = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            keys = [b.column(1 + k) for k in order]
            if last is None:
                last, opening = [k.slice(0, 1) for k in keys], True
                first = [k[0].as_py() for k in keys]
            else:
                opening = False
            changed, news, at = np.zeros(b.num_rows, bool), {}, 0
            for m in levels:
                for j in range(at, m):
                    changed = changed | _differs(keys[j], _joined(last[j], keys[j].slice(0, len(keys[j]) - 1)))
                at = m
                news[m] = changed.copy()
                if opening:
                    news[m][0] = True
            segs = {m: _Segments(news[m]) for m in levels}
            heads = []
            for m in levels:
                # the partition's first group: of its first batch the first one, later those that go on with it
                mine = (segs[m].number == 1) if opening else (segs[m].number == 0) & firsts[m]
                heads.append(pa.array(mine))
                firsts[m] = bool(mine[-1])
            outs = [s.run(segs[s.op.within], news, b.column(1 + columns[i]) if i in columns else None) for i, s in enumerate(states)]
            last = [k.slice(len(k) - 1, 1) for k in keys]
            starts = np.arange(b.num_rows) == (0 if opening else -1)
            arrays = [*b.columns, *outs, *heads, pa.array(starts), pa.nulls(b.num_rows, schema.field("sum").type)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
        if part is not None:
            total = {"first": dict(zip(map("o{}".format, range(len(order))), first)), "last": dict(zip(map("o{}".format, range(len(order))), [k[0].as_py() for k in last])), "whole": [firsts[m] for m in levels], "states": {f"s{i}": s.held for i, s in enumerate(states)}}
            arrays = [pa.nulls(1, f.type) for f in schema]
            arrays[0], arrays[-1] = pa.array([part], schema.field(0).type), pa.array([total], schema.field("sum").type)
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def _inherited(summaries: list, ops: list[Running], levels: list[int], n_order: int) -> list[tuple]:
    """For each partition, in order: what its first group inherits for each running value."""
    out, before, carried = [], None, [None] * len(ops)
    for r in summaries:
        s = r["sum"]
        first, last = tuple(s["first"]), tuple(s["last"])
        agree = 0
        while before is not None and agree < n_order and _same(before[agree], first[agree]):
            agree += 1
        inherits = []
        for i, o in enumerate(ops):
            goes_on = before is not None and agree >= o.within
            held = carried[i] if goes_on else None
            if held is not None and o.kind == "changes" and agree >= o.of:
                held -= 1  # the partition's first value had been counted
            inherits.append(held)
        out.append((r["part"], *inherits))
        for i, o in enumerate(ops):
            own, held, alone = s["states"][f"s{i}"], inherits[i], s["whole"][levels.index(o.within)]
            if not alone or held is None or o.kind == "before":
                carried[i] = own
            elif own is None:
                carried[i] = held
            elif o.kind in ("count", "changes", "sum"):
                carried[i] = held + own
            elif o.kind == "last":
                carried[i] = own
            else:
                carried[i] = _combined(o.kind, held, np.array([own]), np.array([1]))[0].item()
        before = last
    return out


def _nullable(schema: StructType) -> StructType:
    """A schema whose fields may all be null, nested ones too: a summary row has none of them."""
    text = schema.json()
    for rule in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{rule}":false', f'"{rule}":true')
    return StructType.fromJson(json.loads(text))


def scan(rows: DataFrame, order: list[str], ops: dict[str, Running], parts: int | None = None) -> DataFrame:
    """rows with the running values of ops, each under its name. A leading minus makes an order column descending."""
    spark, names = rows.sparkSession, rows.columns
    if bad := [o.kind for o in ops.values() if o.kind not in KINDS]:
        raise ValueError(f"no running value {bad[0]}")
    if not order:
        raise ValueError("an order has a column at least")
    plain = [o.removeprefix("-") for o in order]
    kind_of = {f.name: f.dataType for f in rows.schema.fields}
    number = lambda t: LongType() if t.typeName() in ("byte", "short", "integer", "long") else DoubleType()
    listed, columns, made = list(ops.values()), {}, [F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]
    fields = [StructField("part", IntegerType())] + [StructField(f"c{k}", f.dataType) for k, f in enumerate(rows.schema.fields)]
    outs = []
    for i, o in enumerate(listed):
        if o.kind in ("sum", "min", "max"):  # as a column of their own, in the type they are counted in
            kind = number(kind_of[o.column])
            columns[i] = len(made)
            made.append(F.col(f"`{o.column}`").cast(kind).alias(f"v{i}"))
            fields.append(StructField(f"v{i}", kind))
        elif o.column is not None:
            kind, columns[i] = kind_of[o.column], names.index(o.column)
        else:
            kind = LongType()
        outs.append(StructField(f"s{i}", kind))
    keys = [names.index(o) for o in plain]
    levels = _levels(listed)
    ends = StructType([StructField(f"o{j}", kind_of[o]) for j, o in enumerate(plain)])
    total = StructType([StructField("first", ends), StructField("last", ends), StructField("whole", ArrayType(BooleanType())), StructField("states", StructType(outs))])
    schema = _nullable(StructType(fields + outs + [StructField(f"h{m}", BooleanType()) for m in levels] + [StructField("starts", BooleanType()), StructField("sum", total)]))
    by = [F.col(f"c{k}").desc_nulls_last() if o.startswith("-") else F.col(f"c{k}").asc_nulls_first() for k, o in zip(keys, order)]
    run = _scanner(listed, keys, columns, to_arrow_schema(schema))
    spread = rows.select(*made, row_hash(rows).alias("tie")).repartitionByRange(parts or n_parts(spark), *by, "tie")
    spread = spread.sortWithinPartitions(*by, "tie").drop("tie").select(F.spark_partition_id().alias("part"), "*")
    scanned = written(spread.mapInArrow(run, schema), "scanned")
    summaries = scanned.where("sum is not null").select("part", "sum").orderBy("part").collect()  # one for each partition
    carry = _inherited(summaries, listed, levels, len(order))
    inherited = spark.createDataFrame(carry, StructType([StructField("part", IntegerType())] + [StructField(f"i{k}", f.dataType) for k, f in enumerate(outs)]))
    found = scanned.where("sum is null").join(F.broadcast(inherited), "part")
    values = []
    for i, (name, o) in enumerate(ops.items()):
        own, held = F.col(f"s{i}"), F.when(F.col(f"h{o.within}"), F.col(f"i{i}"))
        if o.kind in ("count", "changes"):
            value = own + F.coalesce(held, F.lit(0))
        elif o.kind == "sum":
            value = F.coalesce(own + held, own, held)
        elif o.kind in ("min", "max"):
            value = (F.least if o.kind == "min" else F.greatest)(own, held)
        elif o.kind == "last":
            value = F.coalesce(own, held)
        else:  # before: only the partition's first row lacks its own
            value = F.when(F.col("starts"), held).otherwise(own)
        values.append((name, value))
    return found.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], *[v.alias(n) for n, v in values])
