"""Quality rules as a ledger of fail bits, in DataFrame operations only.

`ledger` evaluates every rule once and stores its measurements and one bit for each rule that fails. A
policy is a versioned name for a mask of rules: a document is kept if none of the policy's bits is set, so a new policy,
or the effect of leaving a rule out, needs no second look at the texts. `ablations` counts the documents of each
bit pattern (at most 2 ** rules rows, summed before the shuffle) and answers from those counts.

All conditions are on whole numbers, so any engine gives the same verdict. Words are runs of other bytes than
space and \\x09-\\x0D. Repeated 3-word windows are told by 64-bit hashes of the words within one text.

Defined cases: a null or empty text has no words and fails `few_words`; a long text is measured whole, and needs some ten times its size in its task. Repeated rows and null ids get a row
each. An empty table gives no rows (and ablations of zeros). Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import SPACES, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Letters counted as upper case
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: name: SQL condition of failing; a rule's bit is its place here, so rules are only ever added at the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
#: version: the rules it applies
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and fail_bits."""
    text = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.withColumns(
        {
            "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        }
    )
    n, text = F.size("words"), F.col("text")
    d = d.select(
        "doc_id", F.length(_without(text, SPACES)).cast("long").alias("word_chars"), n.cast("long").alias("n_words"),
        _count(text, SYMBOLS).alias("n_symbols"), _count(text, CAPITALS).alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("ordered", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("windows")
    same = lambda x, i: F.coalesce(F.get("ordered", i)["h"] == x["h"], F.lit(False))
    d = d.withColumn("found", F.sort_array(F.transform(F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("ordered")
    covered = F.transform("found", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("found", i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    # a one-row generator: else a filter on a measurement would be pushed below the steps, and put them into one another
    d = d.select("doc_id", F.inline(F.array(F.struct(*MEASURES))))
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return d.select("doc_id", *MEASURES, bits.cast("long").alias("fail_bits"))


def fails(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_failed_alone and n_kept_without, for each rule of the policy."""
    patterns = entries.groupBy("fail_bits").count()
    whole, on = mask(policy), lambda m: F.col("fail_bits").bitwiseAND(F.lit(m))
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).alias(name)
    parts = []
    for rule in POLICIES[policy]:
        bit = 1 << list(RULES).index(rule)
        parts.append(F.struct(F.lit(rule).alias("rule"), total(on(bit) != 0, "n_failed").alias("n_failed"), total(on(whole) == bit, "n").alias("n_failed_alone"), total(on(whole & ~bit) == 0, "n").alias("n_kept_without")))
    return patterns.agg(F.array(*parts).alias("rules")).select(F.inline("rules"))
