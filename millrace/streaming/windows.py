"""Windowed counts, deduplication and joins over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; event time as a timestamp with a zone, as watermarks need it."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour", step: str | None = None) -> DataFrame:
    """Events of each window (which begin every step, or every width) and type; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def followed(first: DataFrame, then: DataFrame, seconds: int, late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Pairs of a user's events, the second at most so many seconds after the first; state goes with the watermark.

    With how="left_outer" a first event that none followed is given out too, with a null, once the watermark tells that none can come any more.
    """
    a = first.select(F.col("user_id").alias("user"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select("user_id", F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    soon = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"interval '{int(seconds)}' second"))
    return a.join(b, (F.col("user") == F.col("user_id")) & soon, how).select("first_id", "then_id")
