"""Token ids of a corpus as flat binary files, and reading them back.

A folder holds, for each range of ascending ids, three little-endian files:

    NAME.bin   the token ids of its documents, one after another, unsigned 16- or 32-bit
    NAME.idx   unsigned 64-bit offsets into NAME.bin, in tokens: one more than it has documents
    NAME.ids   the documents' signed 64-bit ids, or the smallest such number for a null id

The manifest is a table with a row for each file: file, first_id, first_hash (the hash of its first text), n_docs, n_tokens, width, and base, the number of
tokens in all files before it (a prefix sum over the files' totals), so that base plus an offset is a
place in the whole corpus. Files are named by task attempt and only those of attempts that
succeeded are in the manifest, so a lost executor leaves nothing wrong.

Texts are encoded where they are read, and only ids of 2 or 4 bytes go to the task of their range, whose bounds come from a sample of ids and text hashes: SAMPLED for
each file, a million at most. There is a file for each `bytes_per_file` bytes of text, so their number grows with the table. Files are memory-mapped where the folder is a mounted one,
else read in ranges through pyarrow's file systems.

Defined cases: a null or empty text is only the end id; a long text is encoded some 4 MB at a time; null ids come first; repeated ids lie side by
side, ordered by the hash of their text and then by its tokens, so that one id's rows are not one task's; an empty table gives an empty manifest. Ids
are whole numbers. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import fresh_path, n_parts, text_or_empty, tidy, written
from millrace.llm.tokens import encoder

NULL_ID = -(1 << 63)
#: Pairs of id and text hash that a file's range is cut by
SAMPLED = 100
MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_tokens long, width int"


def bounds(ids: np.ndarray, hashes: np.ndarray, files: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, hash) pairs, ascending, that cut a sample of such pairs into as many ranges as there are files."""
    order = np.lexsort([hashes, ids])
    cut = order[(np.arange(1, files) * len(order)) // files] if len(order) else order
    return ids[cut], hashes[cut]


def range_of(ids: np.ndarray, hashes: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of each pair's range: how many of the cuts are no larger."""
    first, last = (np.searchsorted(cuts[0], ids, side) for side in ("left", "right"))
    out = first.copy()
    for k in np.flatnonzero(first < last).tolist():  # ids that are a cut's, too
        out[k] += np.searchsorted(cuts[1][first[k] : last[k]], hashes[k], "right")
    return out


def _encoded(tokenizer: str, end_id: int, cuts):
    """Function of (doc_id, h, text): (range, doc_id, h, ids with the end id, as bytes)."""

    def run(batches):
        enc, at = encoder(tokenizer), cuts.value
        kind = f"<u{enc.width}"
        for b in batches:
            for start, ids, ends in enc.runs(b.column(2), end_id):
                own = [b.column(k).slice(start, len(ends)) for k in (0, 1)]
                part = range_of(*(np.asarray(c.fill_null(NULL_ID)) for c in own), at)
                raw, edges = ids.astype(kind).tobytes(), np.concatenate([[0], ends * enc.width])
                blobs = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *own, blobs.cast(pa.binary())], ["range", "doc_id", "h", "ids"])

    return run


def _writer(folder: str, width: int):
    """Function of sorted (range, doc_id, h, ids): the files of each range, and a row of the manifest for it."""

    def run(batches):
        out, now, name, last, n, first = None, None, None, 0, 0, None

        def ended():
            for x in out:
                x.close()
            return pa.RecordBatch.from_pydict({"file": [name], "first_id": first[0], "first_hash": first[1], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([last], pa.int64()), "width": pa.array([width], pa.int32())})

        for whole in batches:
            part = whole.column(0).to_numpy()
            for rows in np.split(np.arange(whole.num_rows), np.flatnonzero(np.diff(part)) + 1) if whole.num_rows else ():
                b = whole.slice(int(rows[0]), len(rows))
                if part[rows[0]] != now:
                    if out:
                        yield ended()
                    now, last, n = part[rows[0]], 0, 0
                    name = f"{folder}/part-{uuid.uuid4().hex}"
                    fs, path = pyarrow.fs.FileSystem.from_uri(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = [fs.open_output_stream(f"{path}.{x}") for x in ("bin", "idx", "ids")]
                    out[1].write(np.zeros(1, "<u8").tobytes())
                    first = [pa.array([b.column(i)[0].as_py()], pa.int64()) for i in (1, 2)]
                ends = last + np.cumsum(pc.binary_length(b.column(3)).to_numpy().astype(np.int64) // width)
                out[0].write(b"".join(b.column(3).to_pylist()))
                out[1].write(ends.astype("<u8").tobytes())
                out[2].write(np.asarray(b.column(1).fill_null(NULL_ID)).astype("<i8").tobytes())
                last, n = int(ends[-1]), n + b.num_rows
        if out:
            yield ended()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, files: int | None = None, bytes_per_file: int = 256 << 20) -> DataFrame:
    """Write the files of docs in ascending id order; returns the manifest with each file's base."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    text = text_or_empty(text_col)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    size, count = keys.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    files = files or max(n_parts(spark), -(-size // bytes_per_file))
    share = min(1.0, min(1_000_000, SAMPLED * files) / max(1, count))
    some = keys.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "h").sample(share, 1).toArrow()
    cuts = spark.sparkContext.broadcast(bounds(*(some[c].to_numpy() for c in ("doc_id", "h")), files))
    ids = keys.mapInArrow(tidy(_encoded(tokenizer, end_id, cuts)), "range int, doc_id long, h long, ids binary")
    rows = ids.repartitionById(files, "range").sortWithinPartitions("range", "doc_id", "h", "ids")
    manifest = written(rows.mapInArrow(tidy(_writer(folder, encoder(tokenizer).width)), MANIFEST), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class _Ranged:
    """A file's numbers, read as they are asked for."""

    def __init__(self, file, kind: str):
        self.file, self.kind = file, np.dtype(kind)

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at(max(0, stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def _open(name: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(name)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return lambda ext, kind: np.memmap(f"{path}.{ext}", kind, "r")
    return lambda ext, kind: _Ranged(fs.open_input_file(f"{path}.{ext}"), kind)


def _reader(batches):
    for b in batches:
        for name, base, width in zip(*(b.column(i).to_pylist() for i in range(3))):
            load = _open(name)
            ids, offsets, tokens = load("ids", "<i8"), load("idx", "<u8"), load("bin", f"<u{width}")
            for at in range(0, len(ids), 2_000):
                own, ends = ids[at : at + 2_000], offsets[at : at + 2_001].astype(np.int64)
                first, last = int(ends[0]), int(ends[-1])
                if last - first <= 1 << 24:  # one read, if it is not too long
                    block, shift = tokens[first:last], first
                else:
                    block, shift = tokens, 0
                crc = [zlib.crc32(block[x - shift : y - shift].astype("<u4")) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(base + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = manifest.select("file", "base", "width").repartition(n_parts(manifest.sparkSession), "file")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(name: str, width: int, start: int, stop: int) -> np.ndarray:
    """Ids of one file from start to stop, both counted within the file."""
    return np.array(_open(name)("bin", f"<u{width}")[start:stop])


def corpus_tokens(spark: SparkSession, manifest: DataFrame) -> int:
    return manifest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
