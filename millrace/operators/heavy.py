"""Keys that make more than a share of a table: mergeable counters of a fixed size, then an exact count of the candidates.

Each task keeps ceil(1 / share) Misra-Gries counters: counts of a batch are added, and if there are too many counters, all are lowered by the greatest one that
is too many, and those at zero go. Summaries merge in the same way, in rounds of a fixed fan-in, and the error of all merges together stays under that share of the
rows, so no key above it is lost. The last summary, at most that many keys, is broadcast for a second pass that counts the candidates exactly.

Null keys count neither as keys nor as rows. A key must be over the share, not at it. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from millrace.sources.scratch import written

FAN_IN = 16


def lowered(counters: Counter, size: int) -> Counter:
    """At most `size` counters."""
    if len(counters) <= size:
        return counters
    values = np.fromiter(counters.values(), np.int64, len(counters))
    cut = int(np.partition(values, len(values) - size - 1)[len(values) - size - 1])
    return Counter({k: n - cut for k, n in counters.items() if n > cut})


def _counter(size: int, schema: pa.Schema):
    """Function of batches of (key, n) or of (key): the counters of a task, and one row with a null key for its number of rows."""

    def run(batches):
        held, rows = Counter(), 0
        for b in batches:
            if b.num_columns == 2:
                for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if key is None:
                        rows += n
                    else:
                        held[key] += n
            else:
                found = pc.value_counts(b.column(0).drop_null())
                rows += b.num_rows - b.column(0).null_count
                for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    held[key] += n
            held = lowered(held, size)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([None, *held], schema[0].type), pa.array([rows, *held.values()], pa.int64())], schema=schema)

    return run


def heavy_hitters(rows: DataFrame, column: str, share: float) -> DataFrame:
    """(key, n, total) of all values of a column that more than this share of its rows hold."""
    if not 0 < share < 1:
        raise ValueError("a share lies between 0 and 1")
    size, keys = math.ceil(1 / share), rows.select(F.col(column).alias("key"))
    schema = StructType([StructField("key", keys.schema["key"].dataType), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)
    held = written(keys.mapInArrow(_counter(size, arrow), schema), "counters")
    while (n := held.count()) > FAN_IN * (size + 1):
        held = written(held.repartition(-(-n // (FAN_IN * (size + 1)))).mapInArrow(_counter(size, arrow), schema), "counters")
    last = held.coalesce(1).mapInArrow(_counter(size, arrow), schema).collect()  # size + 1 rows
    total = sum(r.n for r in last if r.key is None)
    candidates = held.sparkSession.createDataFrame([(r.key,) for r in last if r.key is not None], StructType(schema.fields[:1]))
    counts = keys.join(F.broadcast(candidates), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > share * F.lit(total)).select("key", "n", F.lit(total).cast("long").alias("total"))
