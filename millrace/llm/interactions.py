"""How filters of a fixed set interact: every order of them replayed over all documents.

`flags` measures each text once and gives a row of fail bits. `audit` crosses these rows with the broadcast table of the orders (5 filters have 120),
explodes each into its five steps, finds the first step that fails, and sums the conditions by part, order and step. The sums are combined within each
task before the shuffle, so that what is shuffled is at most 600 rows for each part and task, whatever the documents.

The bit of a repeated text needs the smallest id of its text in the whole table. Texts are told by SHA-256. Digests found once need no
partner, the others are joined to their smallest id; digests of at least a thousandth of all rows, at most a thousand of them, by a broadcast.

Defined cases: a null text counts as empty: no words, so it fails A only (and E if another empty one has a smaller id). A long text is measured whole. A null
part counts as the empty string. Of equal texts those with the smallest id don't fail E, also if several rows share that id; a row with a null id neither fails E
nor makes another row fail. A document is good (toxic) if any label row of its id says so; null ids have no labels. Rows that repeat each count. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cold_values, hot_values, n_parts, tidy, written

FILTERS = "ABCDE"
#: Characters that filter D looks for, and those that filter C counts
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
WORDS, SHARE, CAPITAL_SHARE = 200, 50, 2


def fails(text: str) -> int:
    """The bits of A to D for one text."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    rare = 100 * len(set(words)) < SHARE * len(words)
    return (len(words) < WORDS) | rare << 1 | (100 * capitals > CAPITAL_SHARE * len(text)) << 2 | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


def _measure(batches):
    for b in batches:
        bits, digests = [], []
        for t in b.column(2):
            text = t.as_py() or ""
            bits.append(fails(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])


def flags(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and bits, one row for each document; bit k is set if it fails the filter FILTERS[k]."""
    kind = docs.schema[id_col].dataType.simpleString()
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(tidy(_measure), f"doc_id {kind}, part string, bits int, digest binary"), "flags")
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    bits = F.col("bits").bitwiseOR(F.when(copy, 16).otherwise(0))
    return cold_values(hot_values(rows, first, "digest", "n", ["least"]), first, "digest", ["least"]).select("doc_id", "part", bits.alias("bits"))


def orders(spark) -> DataFrame:
    """The orders, each with the place of every filter and its steps."""
    rows = []
    for p in permutations(range(len(FILTERS))):
        rows.append(("".join(FILTERS[k] for k in p), [p.index(k) + 1 for k in range(len(p))], [(i + 1, 1 << k) for i, k in enumerate(p)]))
    return spark.createDataFrame(rows, "filter_order string, places array<int>, steps array<struct<step:int,bit:int>>").coalesce(1)


def audit(flagged: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each part, order and step: part, filter_order, step and the counts."""
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    says = lambda c: F.max(F.when(F.col(c) == 1, True).otherwise(False)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(says("quality"), says("toxic"))
    docs = flagged.join(known, "doc_id", "left").select("part", "bits", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("bad"))
    docs = docs.repartition(n_parts(flagged.sparkSession))  # small rows that grow 600-fold: as many tasks as the session has
    none = len(FILTERS) + 1
    failed: list[Column] = [F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("places")[k]).otherwise(none) for k in range(len(FILTERS))]
    replay = docs.crossJoin(F.broadcast(orders(flagged.sparkSession))).select("part", "bits", "good", "bad", "filter_order", F.least(*failed).alias("first"), F.explode("steps").alias("s"))
    first, step, own = F.col("first"), F.col("s.step"), F.col("bits").bitwiseAND(F.col("s.bit")) != 0
    out = replay.groupBy("part", "filter_order", step.alias("step"), F.col("s.bit").alias("bit")).agg(
        count(first > step, "kept"), count(first == step, "removed"), count(own & (first < step), "redundant"), count(F.col("bits") == F.col("s.bit"), "unique_fails"),
        count((first == step) & F.col("good"), "good_lost"), count((first == step) & F.col("bad"), "toxic_lost"),
    )
    out = written(out, "audit")  # 600 rows for each part
    total = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "bit"]).drop("bit")
