"""A hash of whole rows, to tell rows that tie and to deal rows over salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(rows: DataFrame) -> Column:
    """A long of all columns but those that hold maps or variants, which Spark doesn't hash."""
    held = [f.name for f in rows.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{n}`") for n in held]) if held else F.lit(0).cast("long")
