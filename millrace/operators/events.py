"""Event-time operators on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scan import Running, scan


def sessions(events: DataFrame, by: str, at: str, gap: str, parts: int | None = None) -> DataFrame:
    """Key, start, end and number of events of each run of events no further apart than gap.

    Two prefix scans instead of windows, so that a key with most of the events is spread over all tasks: the time before each event
    tells whether it opens a run, and the last opening so far names the run. Events without a time are a run of their own for each key.
    """
    own = events.select(F.col(by).alias("key"), F.col(at).alias("at"))
    before = scan(own, ["key", "at"], {"before": Running("before", "at", within=1)}, parts)
    opens = F.when(F.col("at") <= F.col("before") + F.expr(f"interval {gap}"), F.lit(None)).otherwise(F.col("at"))
    runs = scan(before.select("key", "at", opens.alias("opens")), ["key", "at", "-opens"], {"run": Running("last", "opens", within=1)}, parts)
    return runs.groupBy("key", "run").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n")).select(F.col("key").alias(by), "started", "ended", "n")


def tumbling(events: DataFrame, at: str, width: str, *aggs) -> DataFrame:
    return events.groupBy(F.window(at, width).alias("_w")).agg(*aggs).select(F.col("_w.start").alias("started"), "*").drop("_w")


def sliding(events: DataFrame, at: str, width: str, step: str, *aggs) -> DataFrame:
    """Windows of a width that begin every step, so that an event is in several."""
    return events.groupBy(F.window(at, width, step).alias("_w")).agg(*aggs).select(F.col("_w.start").alias("started"), "*").drop("_w")
