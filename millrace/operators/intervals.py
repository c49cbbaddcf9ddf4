"""Joins of intervals that overlap, both sides having lengths of any size.

Two closed intervals overlap if the right one starts within the left one, or the left one starts within the right one and not at its very
start: each pair is found by one of the two, once. A start within an interval is an equality on dyadic nodes: an interval goes to the level
whose nodes are just longer than it is, where it touches two nodes at most, however long it is; a start goes to its
node on each level that has intervals, of which there are 64 at most and in practice a few more than the logarithm of the longest over the shortest
length. True bounds are compared after that.

A node may hold a large part of either side: an interval over the whole time has a node that all starts are in. So both sides are counted by node, and
hot nodes are dealt over salts: starts over as many as their number asks for, intervals over theirs, each side repeated for the other's salts, so that no task gets
more than about `rows_per_task` rows of a side for one key. Nodes that are hot are 20,000 at most (a bound on the broadcast), as
the threshold grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.hashing import row_hash
from millrace.operators.joins import clock
from millrace.sources.scratch import written

HOT = 10_000


def _place(d: DataFrame, column: str, unit: float) -> Column:
    kind = d.schema[column].dataType
    x = clock(F.col(column), kind) if kind.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(column)
    return F.floor(x / F.lit(unit)).cast("long")


def _level(length: Column) -> Column:
    """The least k with 2 ** k over a length of zero or more."""
    return F.length(F.bin(length)).cast("int")


def _salted(rows: DataFrame, hot: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """rows at their nodes and salts: one of their own, and all of the other side's."""
    rows = rows.join(F.broadcast(hot), keys, "left")
    n = lambda c: F.coalesce(c, F.lit(1))
    mine = F.pmod("tie", n(F.col(own))).cast("int").alias(f"{own}_salt")
    return rows.select(*keys, "row", "place", mine, F.explode(F.sequence(F.lit(0), (n(F.col(other)) - 1).cast("int"))).alias(f"{other}_salt"))


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def keyed(spans: DataFrame, starts: DataFrame, by: list[str], rows_per_task: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides at their nodes: spans (by, first, last, tie, row) and starts (by, at, tie, row), tie being a hash of the row, and the columns they meet by."""
    levels = [r.level for r in spans.select(_level(F.col("last") - F.col("first")).alias("level")).distinct().collect()]  # 64 at most
    keys, level = [*by, "level", "node"], F.col("level")
    nodes = spans.withColumn("level", _level(F.col("last") - F.col("first")))
    nodes = nodes.select(*by, "level", F.explode(F.sequence(F.expr("shiftright(first, level)"), F.expr("shiftright(last, level)"))).alias("node"), "tie", "row", F.col("first").alias("place"))
    at = starts.select(*by, F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")).alias("level"), "at", "tie", "row")
    at = at.select(*by, "level", F.expr("shiftright(at, level)").alias("node"), "tie", "row", F.col("at").alias("place"))
    # starts are counted on the finest level, and those counts on the others
    least = min(levels, default=0)
    fine = written(starts.groupBy(*by, F.shiftright("at", least).alias("fine")).agg(F.count(F.lit(1)).alias("n")), "starts")
    many = fine.select(*by, F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")).alias("level"), "fine", "n").groupBy(*by, level, F.expr(f"shiftright(fine, level - {least})").alias("node")).agg(F.sum("n").alias("starts"))
    wide = _counts(nodes, keys, "spans")
    total = [d.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for d, c in ((many, "starts"), (wide, "spans"))]
    over = [max(rows_per_task, t // HOT) for t in total]  # so at most HOT nodes of each side are hot
    share = lambda c, k: F.ceil(F.coalesce(F.col(c), F.lit(1)) / F.lit(over[k])).alias(c)
    hot = many.where(F.col("starts") > over[0]).join(wide.where(F.col("spans") > over[1]), keys, "full").select(*keys, share("starts", 0), share("spans", 1))
    hot = written(hot, "hot-nodes")
    salts = ["spans_salt", "starts_salt"]
    return _salted(nodes, hot, keys, "spans", "starts"), _salted(at, hot, keys, "starts", "spans"), keys + salts


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], *, by: tuple[tuple[str, str], ...] = (), unit: float = 1.0, rows_per_task: int = 100_000) -> DataFrame:
    """Pairs of rows whose closed spans (start, end) share a point and whose `by` columns (left, right) are equal.

    `unit` is the length of the finest nodes: seconds for times, else the column's own unit; it should be near the shortest lengths that
    are common. Spans with a null bound, or that end before they start, and rows with a null key match nothing. Columns of the two sides have
    different names. Repeated rows each have their pairs; empty sides give none.
    """
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    if len({d.schema[c].dataType.typeName() for d, span in ((left, left_span), (right, right_span)) for c in span}) > 1:
        raise TypeError("all bounds are of one type")
    keys = [f"key{i}" for i in range(len(by))]

    def side(d: DataFrame, span: tuple[str, str], own: list[str]) -> DataFrame:
        ok = d.where(F.col(span[0]) <= F.col(span[1]))
        for c in own:
            ok = ok.where(F.col(c).isNotNull())
        return written(ok.select(*[F.col(c).alias(k) for k, c in zip(keys, own)], _place(d, span[0], unit).alias("first"), _place(d, span[1], unit).alias("last"), row_hash(d).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("row")), "spans")

    a, b = side(left, left_span, [x for x, _ in by]), side(right, right_span, [y for _, y in by])
    found = []
    for spans, starts, own, other, is_left in ((a, b, left_span, right_span, True), (b, a, right_span, left_span, False)):
        held, at, on = keyed(spans, starts.withColumnRenamed("first", "at").drop("last"), keys, rows_per_task)
        met = held.withColumnRenamed("row", "s").drop("place").join(at.withColumnRenamed("row", "p").drop("place"), on)
        start, bounds = F.col("p")[other[0]], (F.col("s")[own[0]], F.col("s")[own[1]])
        within = ((start >= bounds[0]) if is_left else (start > bounds[0])) & (start <= bounds[1])
        found.append(met.where(within).select(*([F.col("s").alias("l"), F.col("p").alias("r")] if is_left else [F.col("p").alias("l"), F.col("s").alias("r")])))
    return found[0].unionByName(found[1]).select("l.*", "r.*")
