"""The queries op1 to op13 and their SQL, each over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, interactions, language, line_dedup, mixing, packing, page_text, quality, repeats, simhash, token_files, whitening
from millrace.llm.shared import table


def tokenizer(name: str) -> str:
    """A public tokenizer's file: in $TOKENIZER_DIR if that is set, else where public_tokenizers has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: What op5 aims at: tokens of good prose to poor to toxic
TARGETS = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
#: The turns of a made conversation whose texts hold control strings
MADE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max").drop("text_bytes")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.learn(docs.where(~held_out))
    return language.identify(docs, model).withColumn("held_out", held_out)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_files.read_token_files(manifest)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")  # more columns may be there
    made = spark.createDataFrame(MADE, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.turns_of_rows(rows.unionByName(made)))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.withColumns({"base_failed": quality.fails("base"), "kept": ~quality.fails("v1")})


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are short beside the texts of a part, so they are sent to few tasks: files of Spark's advisory size rather than one for each part."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans").hint("rebalance", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.clean(line_dedup.build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in found}


_OP2 = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""

_ESC = r"replace(replace(replace({0}, '\', '\\'), '###', '\h'), '</turn>', '\t')"

_OP6 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(4 + length(replace({_ESC.format("role")}, chr(10), '\\n')) + 2 + length({_ESC.format("text")}) + 8) as bigint) as formatted_chars
from (select *, case when conv_id is null then row_number() over () end as alone from c) group by conv_id, alone
"""

_BITS = " + ".join(f"case when {rule} then {1 << k} else 0 end" for k, rule in enumerate(quality.RULES.values()))
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP7 = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {_BLANK}, '') <> '') as l from d),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, len(w) - 1)) as u(i)),
c as (select r, i, count(*) over (partition by r, g) as n from g),
p as (select r, count(distinct i + k) as n from c, (values (0), (1), (2)) as o(k) where n > 1 group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(translate(t, {_BLANK}, '')) as bigint) as word_chars,
             cast(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) as bigint) as n_symbols,
             cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
             cast(coalesce(p.n, 0) as bigint) as n_repeat_words, cast(len(l) as bigint) as n_lines,
             cast(length(t) - length(translate(t, '{quality.CAPITALS}', '')) as bigint) as n_capitals
      from w left join p using (r)),
b as (select *, cast({_BITS} as bigint) as fail_bits from m)
select *, fail_bits & {quality.mask("base")} <> 0 as base_failed, fail_bits & {quality.mask("v1")} = 0 as kept from b
"""

_OP8 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
w as (select doc_id, i, substring(h, 2 * i + 1, 100) as s from d, unnest(range(0, n - 49)) as u(i)),
m as (select s, min(doc_id) as least from w group by s),
f as (select doc_id, i from w join m using (s) where least < doc_id),
o as (select doc_id, i, case when i <= 50 + lag(i) over (partition by doc_id order by i) then 0 else 1 end as opens from f),
k as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as run from o),
runs as (select doc_id, run, min(i) as a, max(i) + 50 as b from k group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs),
cut as (select g.doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as last,
               string_agg(substring(h, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)), '' order by a) as head
        from gaps g join d using (doc_id) group by g.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from d left join cut using (doc_id)
"""


_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_OP11 = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select r, doc_id, i, l[i] as line from d, unnest(range(1, len(l) + 1)) as u(i)),
k as (select *, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
c as (select key, count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) as n, max(doc_id) as top from k where length(key) >= 20 group by key),
f as (select k.*, coalesce(n >= 3 and doc_id is distinct from top, false) as gone from k left join c using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from f group by r
"""

_OP12 = r"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from d),
b as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as bad from w left join l using (doc_id)),
n as (select part, good, toxic, bad, count(*) as n from b group by all),
o as (select '' as o union all select o || f from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(f) where not contains(o, f)),
s as (select part, o, step, ascii(o[step]) - 64 as f, good, toxic, bad, n,
             coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: bad[ascii(o[i]) - 64])), 6) as first
      from n, (select * from o where length(o) = 5), unnest([1, 2, 3, 4, 5]) as u(step)),
g as (select part, o, step, f, sum(case when first > step then n else 0 end) as kept, sum(case when first = step then n else 0 end) as removed,
             sum(case when bad[f] and first < step then n else 0 end) as redundant,
             sum(case when bad[f] and len(list_filter(bad, lambda x: x)) = 1 then n else 0 end) as unique_fails,
             sum(case when first = step and good = 1 then n else 0 end) as good_lost, sum(case when first = step and toxic = 1 then n else 0 end) as toxic_lost
      from s group by all)
select part, o as filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley from g
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": _OP11, "op12_filter_audit": _OP12, "op2_exact_dedup": _OP2, "op6_chat_format": _OP6, "op7_quality_rules": _OP7, "op8_repeated_passages": _OP8}
