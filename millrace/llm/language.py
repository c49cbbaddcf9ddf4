"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from labelled texts. A text is encoded with every
dictionary, and the language whose dictionary makes it smallest wins. Texts are encoded in blocks of
`block` bytes, every block against the dictionary afresh: else a long text would soon be its own best
dictionary, and memory would grow with it. All blocks count. A text is taken as a ring, so that its last block, or only one, goes on with the text's
start: the same rule at every length. Before that, letters are lower-cased and everything that is
not a letter or a mark on one becomes one space, so that case, digits and symbols don't vote.

The score is one minus the ratio of the smallest to the next size, times `SHARP`, at most 1. A text whose margin
is under `min_margin` is rejected (`accepted` false), as is one without a letter (`und`).

The dictionaries come from a bounded sample: for each language the `sample` labelled ids with the lowest hash, of each a stretch that starts at a place set by that hash, `dictionary` bytes in all for a language. They
are cut and joined in the executors, so the driver gets `dictionary` bytes for each language and no more, and sends them on once to each executor. All languages are learned,
each with the same number of bytes however many there are; more than `languages` of them are an error, which names what to change.

Defined cases: a null, empty or letterless text is `und` with score 0; a long text is encoded whole, block by block. With no labelled text all are `und`; with one
language learned, all else are that language with score 0 and accepted. Ties go to the language first in order. Repeated rows and null ids get a row
each. An empty table gives no rows. Other columns are not read; with `keep_row` they come back unchanged in a struct, so no name can clash.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import row_struct, text_or_empty, texts_of, tidy, written

UND, SHARP = "und", 5.0
LEVEL, BLOCK, DICTIONARY, LANGUAGES, SAMPLE, MIN_MARGIN = 6, 1024, 64 << 10, 1024, 400, 0.002
#: Languages whose counts are broadcast, and tasks that a language's rows are dealt to where there are more
BROADCAST, DEALS = 10_000, 256
#: Up to U+02FF there are no marks, and \w has these numbers that are no letters
_BEYOND = re.compile("[̀-\U0010ffff]")
_PLAIN = re.compile(r"[\W\d_²³¹¼½¾]+")
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    low = text.lower()
    if not _BEYOND.search(low):
        return _PLAIN.sub(" ", low).strip().encode()
    return _NOT_LETTERS.sub(" ", low).strip().encode() if _LETTER.search(low) else b""


def _joined(dictionary: int):
    """Function of one language's pieces, at most `sample` of some 4 * dictionary / sample characters: its dictionary."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("h").to_pylist(), table.column("piece").to_pylist()))
        parts = [letters(t) for _, t in rows]
        share = max(1, dictionary // len(parts))
        spare = sum(max(0, share - len(p)) for p in parts)
        share += spare // max(1, sum(len(p) > share for p in parts))
        raw = b" ".join(p[:share] for p in parts)[-dictionary:]
        return pa.table({"lang": table.column("lang").slice(0, 1), "raw": pa.array([raw], pa.binary())})

    return run


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, dictionary: int = DICTIONARY, languages: int = LANGUAGES) -> dict[str, bytes]:
    """language: dictionary bytes, from a bounded sample of rows with a text and a label."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = written(rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct("h"), F.lit(1)).alias("n")), "languages")
    if counts.count() <= BROADCAST:
        counted = rows.join(F.broadcast(counts), "lang")
    else:  # each language's count goes to so many tasks that a frequent one's rows are dealt
        deal = F.pmod("h", F.lit(DEALS)).cast("int")
        counted = rows.withColumn("deal", deal).join(counts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))), ["lang", "deal"])
    # a threshold that some 4 * sample hashes of the language stay under: no language's rows meet in one task
    low = counted.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) <= 4 * sample / F.col("n"))
    # of each a stretch four times its share, as letters are fewer and some texts short
    size = F.ceil(4 * dictionary / F.least("n", F.lit(sample))).cast("int")
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int")
    pieces = low.select("lang", "h", F.substring("text", place + 1, size).alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    first = Window.partitionBy("lang").orderBy("h")
    picked = pieces.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    found = picked.select("lang", "h", "piece").groupBy("lang").applyInArrow(_joined(dictionary), "lang string, raw binary").limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages: raise `languages`, and lower `dictionary` so that their product fits the driver and the workers")
    return {r.lang: bytes(r.raw) for r in sorted(found, key=lambda r: r.lang)}


def _compressors(model: dict[str, bytes], level: int) -> list:
    """For each language in order, a compressor."""
    out = []
    for _, raw in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: str, compressors: list, block: int = BLOCK) -> list[int]:
    """Bytes of a text by each compressor; none of a text without a letter."""
    raw = letters(text)
    ring = b"%b %b" % (raw, raw[:block])
    cut = [ring[i : i + block] for i in range(0, len(raw), block)]
    return [sum(len(c.compress(x)) for x in cut) for c in compressors] if raw else []


def decide(got: list[int], langs: list[str], min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
    """(language, score, accepted)"""
    if not got:
        return UND, 0.0, False
    best = min(range(len(got)), key=got.__getitem__)
    if len(got) == 1:
        return langs[best], 0.0, True
    margin = 1 - got[best] / min(s for k, s in enumerate(got) if k != best)
    return langs[best], min(1.0, SHARP * margin), margin >= min_margin


def identify(docs: DataFrame, model: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, block: int = BLOCK, min_margin: float = MIN_MARGIN, keep_row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and accepted, and the whole row as `row` if that is to be kept. The model's size is bounded by `learn`."""
    text = row_struct(docs) if keep_row else text_or_empty(text_col).alias("text")
    rows, langs, columns = docs.select(F.col(id_col).alias("doc_id"), text), sorted(model), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        compressors = _compressors(sent.value, level)
        for b in batches:
            texts = texts_of(b, columns, text_col) if keep_row else b.column(1)
            out = [decide(sizes(t.as_py(), compressors, block), langs, min_margin) if langs else (UND, 0.0, False) for t in texts]
            new = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
            own = b.schema.names if keep_row else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *new], [*own, "lang_pred", "score", "accepted"])

    schema = StructType([f for f in rows.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return rows.mapInArrow(tidy(run), schema)
