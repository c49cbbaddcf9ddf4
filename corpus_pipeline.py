"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. `run` writes every stage's rows to the shared folder and reads them again.

Defined cases, for every stage: rows are judged one by one, not by their id alone, so of rows that share an id (or have none) one may go and
another stay. A null, empty or letterless text goes in the language stage; where such texts come to a later stage, they are
equal texts, alike, without tokens, and one piece with the end id. Long texts are read whole. Of texts that tie, the largest id stays in the exact stage and the smallest
in the near-duplicate one; of rows that repeat id and text, one. An empty table gives no rows. Other columns of documents are passed on, whatever their names; a
table without `lang` or without labels is an error of the input, empty ones are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, language, mixing, packing, similar
from millrace.llm.queries import tokenizer
from millrace.llm.shared import drop, table, working_tables, write

#: Tokens of good prose to poor to toxic. Good prose keeps its tokens (the anchor), and no document is repeated.
TARGETS, ANCHOR = {"good": 0.93, "poor": 0.065, "toxic": 0.005}, "good"

#: Chunks of text whose ids a packing worker remembers: it shares its executor's memory with what earlier stages left
REMEMBERED = 150_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, or no language clearly nearer than the next."""
    return language.identify(docs, language.learn(docs), keep_row=True).where("accepted").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.deduplicate(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike in 0.8 of their 5-word shingles one stays."""
    return similar.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the fitted rates."""
    mixed = mixing.mix_documents(docs, table(spark, sf_dir, "labels"), TARGETS, anchor=ANCHOR, max_rate=1.0, keep_row=True)
    return mixed.where("copies > 0").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, fingerprints and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working tables of a stage go when its rows are written, and its rows when those of the next stage are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with working_tables(spark) as made:
            docs, path = write(stage(spark, docs, sf_dir), name)
            made.remove(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
