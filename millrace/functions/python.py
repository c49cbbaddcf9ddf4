"""Functions in Python, for what built-in ones can't express: over Arrow batches, and over small bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectorized(function: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of whole columns, run on Arrow batches."""
    return F.pandas_udf(function, returns)


def table_function(spark, name: str, handler: type, returns: str) -> None:
    """Register a class with an eval method as a table function for SQL and lateral joins."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def by_group(rows: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], returns: str) -> DataFrame:
    """One call for each group; a group is in one task's memory, so its size has to be bounded by what the keys mean."""
    return rows.groupBy(*keys).applyInPandas(function, returns)


def by_batch(rows: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], returns: str) -> DataFrame:
    """One call for each partition, over its batches."""
    return rows.mapInPandas(function, returns)
