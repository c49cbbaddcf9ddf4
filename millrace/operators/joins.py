"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from millrace.operators.scan import Running, scan


def as_of(left: DataFrame, right: DataFrame, by: str | list[str], left_on: str, right_on: str, value: str, parts: int | None = None) -> DataFrame:
    """left with the value of the latest right row of the same key at or before its time, null if there is none.

    Both sides in one table, range-partitioned and sorted by key and time, and the last value seen carried on by the prefix scan: one
    shuffle, and a key that holds the whole table is spread over all tasks. Right rows come first at equal times; ties on the
    right take the largest value, and null values are passed over. Null keys and null times match nothing.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    own = lambda d: [F.col(b).alias(k) for b, k in zip(by, keys)]
    kind = F.struct(*left.columns)
    rows = left.select(*own(left), F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), kind.alias("_row"))
    known = right.where(" and ".join(f"`{c}` is not null" for c in [*by, right_on, value]))
    seen = known.select(*own(known), F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    found = scan(rows.unionByName(seen), [*keys, "_at", "_side", "_value"], {"_last": Running("last", "_value", within=len(keys))}, parts)
    return found.where("_side = 1").select("_row.*", F.col("_last").alias(value))


def clock(column: Column, kind: DataType) -> Column:
    """Whole seconds since 1970 on a clock without jumps: that of a time without zone, or UTC."""
    if isinstance(kind, TimestampNTZType):
        return F.unix_date(column.cast("date")).cast("long") * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
    return F.floor(F.unix_micros(column.cast("timestamp")) / 1_000_000)


def within(left: DataFrame, right: DataFrame, left_on: str, right_on: str, seconds: int, keys: list[str]) -> DataFrame:
    """Pairs of equal keys whose right time is at most so many seconds after the left one.

    Times go into bins of that width, so that the join is an equality join on key and bin, of two bins for each left row.
    Both times are of one type; those without a zone are compared as they stand, in any session's zone.
    """
    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        raise TypeError(f"{left_on} and {right_on} are of different types")
    slot = lambda d, c: F.floor(clock(F.col(c), d.schema[c].dataType) / seconds)
    a = left.withColumn("_bin", F.explode(F.array(slot(left, left_on), slot(left, left_on) + 1)))
    b = right.withColumn("_bin", slot(right, right_on))
    until = F.col(left_on) + F.expr(f"interval '{int(seconds)}' second")
    return a.join(b, [*keys, "_bin"]).where((F.col(right_on) >= F.col(left_on)) & (F.col(right_on) <= until)).drop("_bin")
