"""Small helpers of the corpus operators; working tables and folders that all executors can see are those of the library."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import drop, fresh_path, n_parts, shared_root, working_tables, write, written
from millrace.sources.tables import table

__all__ = ["drop", "fresh_path", "n_parts", "shared_root", "table", "working_tables", "write", "written"]

#: The bytes that separate words, fixed by the word pattern [^\x20\x09-\x0D]+
SPACES = " \t\n\x0b\x0c\r"
_MEMORIES: dict[str, dict] = {}


def memory(name: str) -> dict:
    """This Python worker's memory of that name. All others are emptied: a worker serves one step at a time."""
    for other, held in _MEMORIES.items():
        if other != name:
            held.clear()
    return _MEMORIES.setdefault(name, {})


def tidy(run):
    """run, a function of a task's batches, and at the task's end what it left unused goes back to the system: workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
            if trim:
                trim(0)

    return tidied


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_struct(docs: DataFrame) -> Column:
    """All columns in one struct, `row`: passed on whole, their names clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def texts_of(batch: pa.RecordBatch, columns: list[str], text_col: str) -> pa.Array:
    """The texts (null: empty) within the `row` of a batch, a struct of these columns."""
    rows = batch.column(batch.schema.get_field_index("row"))
    return rows.field(columns.index(text_col)).cast(pa.string()).fill_null("")


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def text_runs(texts, limit: int = 1 << 22):
    """(first row, texts) of some `limit` bytes of a string column at a time, one text at least."""
    size, at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def hot_values(rows: DataFrame, counts: DataFrame, key: str, n_col: str, values: list[str]) -> DataFrame:
    """rows with _hot and the values of hot keys as _hot_<name>, null for others.

    counts is a written table of distinct keys with n_col rows each. Hot keys hold at least a thousandth of all those rows, so there are a
    thousand at most, and they come by a broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0]
    hot = counts.where(F.col(n_col) * 1000 >= F.lit(total)).select(F.col(key), F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    return rows.join(F.broadcast(hot), key, "left")


def cold_values(rows: DataFrame, counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows that hot_values made, with the values of all keys, null where counts has none; the columns of hot keys go.

    Rows of hot keys come here with a longer key of their own, which meets nothing: no task gets more than a thousandth of the rows for
    one key. Keys are binary and of one length.
    """
    alone = F.concat(F.col(key), F.encode(F.monotonically_increasing_id().cast("string"), "utf-8"))
    rows = rows.withColumn("_key", F.when(F.col("_hot"), alone).otherwise(F.col(key)))
    rows = rows.join(counts.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_cold_{v}") for v in values]), "_key", "left")
    own = [c for c in rows.columns if not c.startswith(("_hot", "_cold_")) and c != "_key"]
    return rows.select(*own, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])
