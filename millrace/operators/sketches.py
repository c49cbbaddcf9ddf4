"""Stored sketches: states of a fixed size by hour and group, kept as binary columns of a table and merged when a question is asked.

A state answers for any span of hours and any set of groups without a second look at the rows: distinct users by HyperLogLog and by theta sketches,
which also intersect, and quantiles by KLL. States merge in any order, so they are stored once, appended as hours close, and read by a filter on their hour.

Errors, as multiples of one standard error that a question may state: HyperLogLog with 2 ** k registers 1.04 / sqrt(2 ** k); a theta sketch of 2 ** k
entries is exact while it holds fewer, then 1 / sqrt(2 ** k); a KLL quantile of the default size is off by up to 1.7 % of the ranks in 99 of 100 cases. An intersection's error is relative to the
union. Null users and values are left out; an hour without rows has no state; merging no states gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of registers and entries
SIZE = 12
HLL_ERROR, THETA_ERROR, KLL_ERROR = 1.04 / 2 ** (SIZE / 2), 1 / 2 ** (SIZE / 2), 0.017


def hourly(rows: DataFrame, at: str, by: list[str], key: str, value: str) -> DataFrame:
    """(hour, by, n, hll, theta, kll): one row of states for each hour and group."""
    hour = F.date_trunc("hour", at).cast(rows.schema[at].dataType).alias("hour")
    return rows.groupBy(hour, *by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, F.lit(SIZE)).alias("hll"), F.theta_sketch_agg(key, F.lit(SIZE)).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("kll")
    )


def merged(states: DataFrame, *by) -> DataFrame:
    """The states of wider groups: by may be columns or expressions of the states' hour and groups."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def estimates(states: DataFrame, shares: list[float]) -> DataFrame:
    """states with hll_keys, theta_keys and quantiles (an array in the order of shares) in place of the states."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(q)) for q in shares])
    return states.withColumns({"hll_keys": F.hll_sketch_estimate("hll"), "theta_keys": F.theta_sketch_estimate("theta"), "quantiles": quantiles}).drop("hll", "theta", "kll")


def shared_keys(states: DataFrame, by: list, group: str, values: list[str]) -> DataFrame:
    """(by, keys): how many keys every one of some values of a group column has; none if one of them has no state."""
    own = states.where(F.col(group).isin(values)).groupBy(*by, group).agg(F.theta_union_agg("theta").alias("theta"))
    names = own.columns[: len(by)]
    met = own.groupBy(*names).agg(F.theta_intersection_agg("theta").alias("theta"), F.count(F.lit(1)).alias("n"))
    return met.select(*names, F.when(F.col("n") == len(set(values)), F.theta_sketch_estimate("theta")).otherwise(0).cast("long").alias("keys"))
