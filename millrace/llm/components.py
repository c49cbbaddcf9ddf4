"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop, write


#: Edges of a task that writes a round: small rounds are few files
ROWS = 10_000


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    both = edges if small else edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if not small:
        both = both.where("v > u")
        hooked = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hooked.where("u <> v").distinct()
    hooked = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round is written to the shared folder (and the one before removed), in as many files as its edges ask for, and only two numbers of it come to the driver. Edges
    with a null end and self-loops are left out. An empty table gives no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    (now, path), before = write(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        if state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, last = state, path
        stars = _stars(_stars(now, small=False), small=True)
        now, path = write(stars.coalesce(-(-state[0] // ROWS)), "edges")
        drop(now.sparkSession, last)
