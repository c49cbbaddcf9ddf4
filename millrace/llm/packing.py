"""Best-fit packing planned on the histogram of lengths.

The plan depends on how many pieces there are of each length, not on the pieces: lengths are at most
the capacity, so the histogram that comes to the driver has at most `capacity` rows at any size of the
corpus. Best-fit decreasing runs over those counts: bins that are alike (same free space) are one
group, and a group takes as many pieces of a length at once as fit. The plan's rows say that the
pieces of length L with ranks a to b go to bins from f on, at a given place. It is broadcast while it has at most PLAN rows (it had a few thousand in all
tables tried), else joined by length.

Pieces then take their slot by their rank within their length, in the order of their row numbers, which are written with them: so no two pieces tie, and a
stage that is run again gives the same ranks. The rank of a frequent length is
not found in one task: each length is dealt into groups of some `rows_per_task` rows, ranked within those, and the
groups' counts before it are added.

Defined cases: a null or empty text is one piece that holds the end id only. Long texts are cut into as many pieces as they need. Repeated ids are packed once
for each row; null ids are packed like others. An empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import text_or_empty, tidy, written
from millrace.llm.tokens import REMEMBERED, encoder

#: Rows of a plan that is broadcast
PLAN = 100_000


def cuts(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of rows of n tokens: whole ones of the capacity, a shorter one first."""
    pieces = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
    first = n - (pieces - 1) * capacity
    return row, piece, np.where(piece > 0, first[row] + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first[row])


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32.

    remembered: chunks whose ids a worker keeps, some 40 bytes each; fewer take less memory and more time.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for at, ids, ends in enc.runs(b.column(1), end_id, remembered):
                row, piece, start, length = cuts(np.diff(ends, prepend=0), capacity)
                raw, from_ = memoryview(ids.astype("<u4")).cast("B"), np.concatenate([[0], ends])[row] + start
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(from_.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths.

    Returns (length, rank_from, rank_to, first_bin, place) rows, ranks from 0, and the number of bins.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths go from 1 to the capacity")
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first bin, bins)
    plan, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, space = counts[length], 0, length
        while left:
            while space <= capacity and not free[space]:
                space += 1
            if space > capacity:
                each = capacity // length
                first, n, space_here = bins, -(-left // each), capacity
                bins += n
            else:
                space_here = space
                first, n = free[space].pop()
            each = space_here // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                plan.append((length, rank, rank + full, first, capacity - space_here + j * length))
                rank += full
            left -= full * each
            if full:
                free[space_here - each * length].append((first, full))
            if full < n and left < each:
                for j in range(left):
                    plan.append((length, rank, rank + 1, first + full, capacity - space_here + j * length))
                    rank += 1
                free[space_here - left * length].append((first + full, 1))
                if n - full > 1:
                    free[space_here].append((first + full + 1, n - full - 1))
                left = 0
            space = length
    return plan, bins


def pack(pieces: DataFrame, *, capacity: int = 1024, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), rows_per_task: int = 4_000) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times, so it should be a written table; order should tell its rows apart."""
    counts = {int(r[0]): r[1] for r in pieces.groupBy(length_col).count().collect()}
    plan, _ = plan_bins(counts, capacity)
    deals = F.array(*[F.lit(-(-counts.get(n, 1) // rows_per_task)) for n in range(1, capacity + 1)])
    dealt = pieces.withColumn("_deal", F.pmod(F.xxhash64(*order), F.element_at(deals, F.col(length_col).cast("int"))))
    before = Window.partitionBy(length_col).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(length_col, "_deal").count().select(length_col, "_deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(length_col, "_deal").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, [length_col, "_deal"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    slots = pieces.sparkSession.createDataFrame(plan, "_length long, _from long, _to long, _bin long, offset long")
    fits = (F.col(length_col) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    slots = F.broadcast(slots) if len(plan) <= PLAN else slots
    return ranked.join(slots, fits).select(*pieces.columns, (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """The packed pieces of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, remembered=remembered)
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity=capacity, order=("_row",)).drop("_row")
