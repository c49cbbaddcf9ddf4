"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into runs, one for each `rows_per_run` rows (64 at least, so their number grows with the table), by their partition and, within it, by
stretches of `stretch` rows, so that a table read as one partition gives as many runs as any other. A run
is its digests in order, each once, with the smallest (or largest) id and a count; it is cut into `ranges` by the digest's leading bits, so
that a run of any length is many tasks' work. Runs then meet in binomial rounds of `fan_in` partners: in round k those
runs whose number differs only in digit k (to the base `fan_in`) send their ranges to the one of them with the digit zero, which merges what came in
digest order, keeps the best id of each verified digest and adds the counts. After the last round run 0 holds all. Then the verdict goes
down the same tree to the rows. A text that makes up a third of the table is one row for each run, and no task of any
round reads more than `fan_in` rows of it, nor more than one run's share of its rows on the last way down.

The merge is Spark's sort aggregate (its buffer is a struct, which hash aggregates don't take): a sort of the sorted runs that an exchange
brought together, and one pass over it.

A digest is verified by the text's length and an independent 64-bit hash, kept beside it as part of
the key at every level: texts that differ in either are never merged.

Defined cases: a null text counts as empty; a long one is hashed whole, like any other. Null ids never win over others; in a group of null ids
only, keep_id is null and all its rows are kept. Rows that repeat the winning id are all kept, as
the id can't tell them apart (`deduplicate` then keeps one). An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import n_parts, text_or_empty, written

KEY = ("range", "digest", "n_bytes", "check")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", n_runs: int | None = None, fan_in: int = 8, rows_per_run: int = 4_000_000, ranges: int | None = None, stretch: int = 1_000) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, text_bytes."""
    best = {"min": F.min, "max": F.max}[keep]
    text = text_or_empty(text_col)
    leaf = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
            F.monotonically_increasing_id().alias("place"),  # the partition's number over 33 bits of the row's
        ),
        "digests",
    )
    n_rows = leaf.count()
    n_runs = n_runs or max(64, -(-n_rows // rows_per_run))
    ranges = ranges or max(4 * n_parts(docs.sparkSession), -(-n_rows // rows_per_run))
    leading = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    leaf = leaf.select("*", F.pmod(F.shiftright("place", 33) + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / stretch), F.lit(n_runs)).cast("int").alias("run"), F.floor(leading * ranges / F.lit(float(1 << 32))).cast("int").alias("range")).drop("place")
    # a null struct never wins, so neither does a null id
    merged = lambda rows, own, n: rows.groupBy("run", *KEY).agg(best(own).alias("best"), n.alias("group_size"))
    levels = [merged(leaf, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id")), F.count(F.lit(1)))]
    above, step = [], 1
    while step < n_runs:
        partner = F.expr(f"run - (run div {step}) % {fan_in} * {step}").cast("int")
        above.append(partner)
        sent = levels[-1].withColumn("run", partner).repartition("run", "range")
        levels.append(merged(sent, F.col("best"), F.sum("group_size")))
        step *= fan_in
    verdict = levels[-1]
    for level, partner in zip(reversed(levels[:-1]), reversed(above)):
        mine = level.select("run", *KEY, partner.alias("above"))
        verdict = mine.join(verdict.withColumnRenamed("run", "above"), ["above", *KEY]).drop("above")
    return leaf.join(verdict, ["run", *KEY]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("n_bytes").alias("text_bytes"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text."""
    mark = "_keep_digest"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    kept = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep, **options).where("kept")
    kept = written(kept.groupBy(F.col("doc_id").alias(f"{mark}id"), F.unhex("text_sha256").alias(mark)).agg(F.count(F.lit(1)).alias(f"{mark}n")), "kept")
    left = docs.withColumn(f"{mark}sha", F.unhex(F.sha2(text_or_empty(text_col), 256)))
    rows = left.join(kept, left[id_col].eqNullSafe(kept[f"{mark}id"]) & (left[f"{mark}sha"] == kept[mark]), "left_semi")
    if not kept.where(f"{mark}n > 1").isEmpty():  # rows that repeat both id and text
        rows = rows.dropDuplicates([id_col, f"{mark}sha"])
    return rows.drop(f"{mark}sha")
