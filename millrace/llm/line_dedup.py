"""Incremental, reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of `min_chars` code points and more count. The index is three tables in
the shared folder:

* holdings: each document's keys, (digest, doc_id), each once: the references themselves,
* counts: the references of each key and its largest document,
* filters: for each shard of the keys, a cuckoo filter of those that have `min_docs` references or more.

`insert` adds the references that are new, `delete` takes a document's out; both count anew for the keys concerned only, and those
that pass the threshold, up or down, go into or out of their shard's filter. So the index after an insertion and a deletion is that before. A shard whose filter
is full is built anew from the counts, twice as large. `clean` sends lines' digests to their shard, where the filter settles all lines but those whose keys
are repeated (and some 8 in 65,536 others); only those meet the exact counts, which decide. A repeated key's lines go from all documents but its largest.

Memory: a task holds one shard's filter and, in an update, that shard's keys; the number of shards is set when the index is first filled, from the number of references
(`rows_per_shard`). A digest is 16 bytes of SHA-256. Keys that hold at least a thousandth of all references, a thousand at most, are settled by a
broadcast before lines go to shards, so that no shard gets more than that for one key.

Defined cases: a null or empty text is one empty line. Rows that share an id are one document; so are all rows without an id, which is never the largest
one if another holds the key. Long texts are read whole, a text and its dropped keys in one task. A document inserted again only adds keys that it did not have; to
replace a text, delete the id first. Ids to delete that the index doesn't have change nothing. Cleaned documents need not be in the index. Repeated rows each get
their results. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.cuckoo import Cuckoo
from millrace.llm.shared import SPACES, cold_values, hot_values, n_parts, text_or_empty, text_runs, tidy, written

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIN_CHARS, MIN_DOCS = 20, 3


def digest_of(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line's key, None if the key is too short to count."""
    key = line.strip(SPACES)
    return hashlib.sha256(key.encode().translate(LOWER)).digest()[:16] if len(key) >= min_chars else None


def _digests(text: str, min_chars: int) -> dict[bytes, None]:
    found = dict.fromkeys(digest_of(x, min_chars) for x in text.split("\n"))
    found.pop(None, None)
    return found


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index; insertions and deletions give new ones and leave these as they are."""

    holdings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, h, digest) for each row and key of its text; h tells rows of one id and other texts apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, texts in text_runs(b.column(2)):
                own = [_digests(t.as_py(), min_chars) for t in texts]
                row = pa.array(np.repeat(np.arange(at, at + len(own)), [len(o) for o in own]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array([d for o in own for d in o], pa.binary())], ["doc_id", "h", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, h long, digest binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _by_shard(batches):
    """Runs of one shard and kind in a stream of batches sorted by both: (shard, kind, batch)."""
    for b in batches:
        shard, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, b.num_rows]):
            if stop > start:
                yield int(shard[start]), int(kind[start]), b.slice(start, stop - start)


def _keys(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2)


def _update(batches):
    """Each shard's filter after its changes. Rows of kind 0 bring a filter, or the size of a new one, 1 keys to remove and 2 keys to add."""

    def done():
        if taken:
            held.remove(np.concatenate(taken))
        fits = held.add(np.concatenate(added)) if added else True
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.dumps() if fits else None], pa.binary())], ["shard", "filter"])

    now, held, taken, added = None, None, [], []
    for shard, kind, b in _by_shard(batches):
        if shard != now:
            if now is not None:
                yield done()
            now, held, taken, added = shard, None, [], []
        if kind == 0:
            data, n = b.column(3)[0].as_py(), b.column(4)[0].as_py()
            held = Cuckoo.loads(data) if data is not None else Cuckoo.sized(n)
        else:
            (taken if kind == 1 else added).append(_keys(b.column(2)))
    if now is not None:
        yield done()


def _filters(heads: DataFrame, removed: DataFrame | None, added: DataFrame) -> DataFrame:
    """(shard, filter), a null filter where the keys don't fit. heads: shard, filter, n."""
    rows = heads.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), "filter", F.col("n").cast("long"))
    for kind, keys in ((1, removed), (2, added)):
        if keys is not None:
            rows = rows.union(keys.select("shard", F.lit(kind), "digest", F.lit(None).cast("binary"), F.lit(None).cast("long")))
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidy(_update), "shard int, filter binary")


def _built(index: LineIndex, shards: DataFrame, room: int) -> DataFrame:
    """Filters of these shards from the counts, each with room for so many times its keys."""
    keys = index.counts.where(F.col("refs") >= index.min_docs).select(_shard(index.shards).alias("shard"), "digest").join(shards, "shard", "left_semi")
    sizes = keys.groupBy("shard").agg((F.count(F.lit(1)) * room).alias("n"))
    return _filters(shards.join(sizes, "shard", "left").select("shard", F.lit(None).cast("binary").alias("filter"), F.coalesce("n", F.lit(0)).alias("n")), None, keys)


def _settled(index: LineIndex, filters: DataFrame) -> LineIndex:
    """The index with these filters, those that overflowed built anew."""
    filters, room = written(filters, "filters"), 2
    while not (full := filters.where("filter is null").select("shard")).isEmpty():
        if room > 64:
            raise ValueError("keys don't fit a filter of 64 times their number: the digests are not spread")
        filters = written(filters.where("filter is not null").union(_built(index, full, room)), "filters")
        room *= 2
    return replace(index, filters=filters)


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, rows_per_shard: int = 4_000_000) -> LineIndex:
    """The index of a table of documents, which may be empty."""
    holdings = written(_references(docs, id_col, text_col, min_chars).select("digest", "doc_id").distinct(), "holdings")
    counts = written(holdings.groupBy("digest").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("top")), "counts")
    shards = shards or max(n_parts(docs.sparkSession), -(-holdings.count() // rows_per_shard))
    index = LineIndex(holdings, counts, holdings.limit(0), shards, min_docs, min_chars)
    return _settled(index, _built(index, docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")), 1))


def _changed(index: LineIndex, holdings: DataFrame, counts: DataFrame, before: DataFrame) -> LineIndex:
    """The index with other counts; before: (digest, refs) as they were for the keys concerned."""
    moved = counts.select("digest", F.col("refs").alias("now")).join(before, "digest", "right").select("digest", F.coalesce("refs", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    moved = written(moved.select(_shard(index.shards).alias("shard"), "digest", (F.col("was") >= index.min_docs).alias("held"), (F.col("now") >= index.min_docs).alias("holds")), "moved")
    index = replace(index, holdings=holdings, counts=counts)
    heads = index.filters.select("shard", "filter", F.lit(0).alias("n"))
    return _settled(index, _filters(heads, moved.where("held and not holds"), moved.where("holds and not held")))


def insert(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    fresh = _references(docs, id_col, text_col, index.min_chars).select("digest", "doc_id").distinct()
    held = index.holdings
    fresh = written(fresh.join(held, (fresh.digest == held.digest) & fresh.doc_id.eqNullSafe(held.doc_id), "left_anti"), "inserted")
    change = fresh.groupBy("digest").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("top"))
    counts = written(index.counts.union(change).groupBy("digest").agg(F.sum("refs").alias("refs"), F.max("top").alias("top")), "counts")
    before = index.counts.select("digest", "refs").join(change.select("digest"), "digest", "right")
    return _changed(index, held.union(fresh), counts, before)


def delete(index: LineIndex, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents whose ids a table lists."""
    held, gone = index.holdings, ids.select(F.col(id_col).alias("_id")).distinct()
    same = held.doc_id.eqNullSafe(gone["_id"])
    out, left = written(held.join(gone, same, "left_semi"), "deleted"), written(held.join(gone, same, "left_anti"), "holdings")
    change = out.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"), F.max("doc_id").alias("lost_top"))
    after = written(index.counts.join(change, "digest", "left").withColumn("left", F.col("refs") - F.coalesce("lost", F.lit(0))), "after")
    headless = after.where(F.col("lost_top").eqNullSafe(F.col("top")) & F.col("lost").isNotNull() & (F.col("left") > 0)).select("digest")
    heads = left.join(headless, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("next_top"), F.lit(True).alias("moved"))
    top = F.when(F.col("moved"), F.col("next_top")).otherwise(F.col("top"))
    counts = written(after.where("left > 0").join(heads, "digest", "left").select("digest", F.col("left").alias("refs"), top.alias("top")), "counts")
    return _changed(index, left, counts, after.where("lost is not null").select("digest", "refs"))


def _sift(batches):
    """Lines that their shard's filter may hold, and those that are settled already (of shards below zero)."""
    now, held = None, None
    for shard, kind, b in _by_shard(batches):
        if kind == 0:
            now, held = shard, Cuckoo.loads(b.column(2)[0].as_py())
        elif shard < 0:
            yield b.select(["digest", "row"])
        else:
            if shard != now:
                raise ValueError(f"shard {shard} has no filter")
            found = held.contains(_keys(b.column(3)))
            yield b.filter(pa.array(found)).select(["digest", "row"])


def dropped_lines(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, digest) of the keys whose lines go from a row."""
    repeated = written(index.counts.where(F.col("refs") >= index.min_docs), "repeated")
    lines = hot_values(_references(docs, id_col, text_col, index.min_chars), repeated, "digest", "refs", ["top", "refs"])
    aside = -1 - F.pmod(F.xxhash64("h"), F.lit(index.shards))  # hot keys' lines go by document to shards of their own
    lines = lines.select(F.when(F.col("_hot"), aside).otherwise(_shard(index.shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), "digest", F.struct("doc_id", "h", "_hot", "_hot_top", "_hot_refs").alias("row"))
    heads = index.filters.select("shard", F.lit(0).alias("kind"), "filter", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(lines.schema["row"].dataType).alias("row"))
    stream = heads.union(lines).repartition("shard").sortWithinPartitions("shard", "kind")
    kind = lines.schema["row"].dataType.simpleString()
    found = stream.mapInArrow(tidy(_sift), f"digest binary, row {kind}").select("digest", "row.*")
    found = cold_values(found, repeated, "digest", ["top", "refs"])
    return found.where((F.col("refs") >= index.min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "h", "digest")


def clean(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, text (of the lines that stay)."""
    kind, min_chars = docs.schema[id_col].dataType.simpleString(), index.min_chars

    def run(batches):
        for b in batches:
            for at, texts in text_runs(b.column(1)):
                total, gone, kept = [], [], []
                for t, drop in zip(texts, b.column(2).slice(at, len(texts))):
                    lines, drop = t.as_py().split("\n"), set(drop.as_py() or ())
                    stay = [x for x in lines if digest_of(x, min_chars) not in drop] if drop else lines
                    total.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    drops = dropped_lines(index, docs, id_col=id_col, text_col=text_col).groupBy("doc_id", "h").agg(F.collect_set("digest").alias("drop")).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.join(drops, (rows.h == drops["_h"]) & rows.doc_id.eqNullSafe(drops["_id"]), "left").select("doc_id", "text", "drop")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_lines long, n_dropped long, text string")
