"""Reading and writing tables in the formats that Spark has itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Tables of a folder as views for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _options(kind: str) -> dict[str, str]:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    return {"header": "true", "escape": '"'} if kind == "csv" else {}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A folder or file of a format; partition folders (key=value) become columns, filters on which skip whole folders."""
    reader = spark.read.format(kind).options(**_options(kind))
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write df, with a folder for each value of the columns in by."""
    df.write.format(kind).options(**_options(kind)).mode(mode).partitionBy(*by).save(path)
