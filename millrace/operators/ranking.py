"""Ranks over a whole table, exact percentiles and running values, by the prefix scan: no window, so no task for a whole key or table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scan import Running, scan
from millrace.sources.scratch import written


def ranks(rows: DataFrame, order: list[str], by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with place (row number), rank and dense_rank, all longs, in the order of some columns, over the table or within the keys of `by`.

    A leading minus makes a column descending. Rows that tie have one rank; their places are told by a hash of their columns.
    """
    k, n = len(by), len(by) + len(order)
    ops = {"place": Running("count", within=k), "_tie": Running("count", within=n), "dense_rank": Running("changes", within=k, of=n)}
    out = scan(rows, [*by, *order], ops, parts)
    return out.select(*rows.columns, "place", (F.col("place") - F.col("_tie") + 1).alias("rank"), "dense_rank")


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, str | None]], parts: int | None = None) -> DataFrame:
    """rows with running values of each key so far: name: (count, sum, min, max, last or before, column). The order should tell a key's rows apart."""
    return scan(rows, [*by, *order], {name: Running(kind, column, within=len(by)) for name, (kind, column) in values.items()}, parts)


def percentiles(rows: DataFrame, by: list[str], column: str, shares: list[float], parts: int | None = None) -> DataFrame:
    """(keys, share, n, value): exact percentiles of each key's values that are not null, between two values in proportion.

    The rows are ranked once within their keys; then only those at the places that the shares ask for are looked up, two for each key and
    share, however many rows a key has. Null keys are a key.
    """
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares go from 0 to 1")
    own = rows.where(F.col(column).isNotNull()).select(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], F.col(column).cast("double").alias("v"))
    keys = [f"k{i}" for i in range(len(by))]
    placed = written(scan(own, [*keys, "v"], {"place": Running("count", within=len(by))}, parts), "placed")
    sizes = placed.groupBy(*keys).agg(F.max("place").alias("n")).where("n > 0")
    at = F.col("share") * (F.col("n") - 1)
    asked = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("part", at - F.floor(at))
    asked = asked.select("*", F.posexplode(F.array(F.floor(at) + 1, F.ceil(at) + 1)).alias("side", "at"))
    same = [placed[k].eqNullSafe(asked[k]) for k in keys] + [placed.place == asked["at"]]
    found = asked.join(placed.select(*[F.col(k) for k in keys], "place", "v"), same).select(*[asked[k] for k in keys], "share", "n", "part", "side", "v")
    low, high = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in (0, 1))
    out = found.groupBy(*keys, "share", "n", "part").agg(low.alias("low"), high.alias("high"))
    value = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "share", "n", value.alias("value"))
