"""Chat formatting: layouts are told by a fingerprint of their nested field paths and mapped to turns.

Records come as JSON texts or as tables with a row for each turn, which are first nested into one record for each conversation; both are variants from
there on and take the same way. A layout is declared by its fields (LAYOUTS). Its fingerprint is the 64-bit hash of its sorted field paths, with one more
for each choice of its optional fields. A record's fingerprint is the hash of the known paths it has, taken row by row, so that records of
several layouts may be mixed; it selects the layout, and the layout's declaration makes the turns. Records with
an unknown fingerprint get null turns, never a guess.

What paths a record has: paths that no layout knows don't count, so extra fields do no harm. An array has the paths of
all its elements together; an empty array of a known name has all that are known. A field that is null is there, but for optional ones, which count as missing where they are null or empty. Families
(FAMILIES) are tried in order, and only the paths of the first that the record has are hashed: with both `messages` and `prompt` it is a messages record.

Template, a text for each conversation:

    ### role:\\n text </turn>\\n      (without the blanks)

In roles and texts the control strings are escaped: \\ as \\\\, ### as \\h, </turn> as \\t, and in roles a newline as \\n.
After that neither ### nor </turn> can come from a text, and reading from left to right restores it.
`loss_spans` are the code-point ranges (start, length) of the assistant texts in the formatted text.

Defined cases: a null role or text counts as empty; turns are ordered by turn, then role, then text; null turns
come first; a row with a null conv_id belongs to no other: it is a conversation of its own, with a null id; repeated rows are turns of their own. A long text is
kept whole (a conversation is one row, so it has to fit in one). An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: layout: {field path: what it is}, in the order of the turns. A path under [] is a field of an array's elements; one with a ? may be missing.
LAYOUTS = {
    "turn_rows": {"turns[].role": "role", "turns[].text": "text"},
    "messages": {"messages[].role": "role", "messages[].content": "text"},
    "sharegpt": {"conversations[].from": "role", "conversations[].value": "text"},
    "instruction": {"system?": "system", "instruction": "user", "input?": "user", "output": "assistant"},
    "prompt_completion": {"system?": "system", "prompt": "user", "completion": "assistant"},
    "prompt_response": {"system?": "system", "prompt": "user", "response": "assistant"},
    "question_answer": {"system?": "system", "question": "user", "answer": "assistant"},
}
#: names of arrays, the first that a record has counts; "" stands for fields outside of them
FAMILIES = ("turns", "messages", "conversations", "")
#: other names of the canonical roles; the stored roles of turn rows stay as they are
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
OPEN, CLOSE = "### ", "</turn>\n"


def _family(path: str) -> str:
    return path.partition("[].")[0] if "[]." in path else ""


def known_paths(family: str) -> dict[str, bool]:
    """path without its mark: whether it is optional in every layout that has it"""
    found: dict[str, bool] = {}
    for layout in LAYOUTS.values():
        for p in layout:
            if _family(p) == family:
                found[p.rstrip("?")] = found.get(p.rstrip("?"), True) and p.endswith("?")
    return dict(sorted(found.items()))


def fingerprint(paths: Column) -> Column:
    """The hash of an array of field paths."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def fingerprints(name: str) -> list[list[str]]:
    """The sets of paths that a layout's records may have."""
    sure = [p for p in LAYOUTS[name] if not p.endswith("?")]
    may = [p.rstrip("?") for p in LAYOUTS[name] if p.endswith("?")]
    return [sorted(sure + list(more)) for k in range(len(may) + 1) for more in combinations(may, k)]


def _there(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant").isNotNull()


def present_paths(record: Column) -> Column:
    """The known paths of a variant record, of the first family that it has."""
    cases = []
    for family in FAMILIES:
        known = known_paths(family)
        if family:
            items = F.try_variant_get(record, f"$.{family}", "array<variant>")
            has = lambda p: (F.size(items) == 0) | F.exists(items, lambda x: F.coalesce(_there(x, f"$.{p.partition('[].')[2]}"), F.lit(False)))  # noqa: E731, B023
            own = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in known]))
            cases.append((F.coalesce(F.size(own) > 0, F.lit(False)), own))
        else:
            of = [F.when(F.try_variant_get(record, f"$.{p}", "string") != "" if optional else _there(record, f"$.{p}"), F.lit(p)) for p, optional in known.items()]
            cases.append((F.lit(True), F.array_compact(F.array(*of))))
    out = cases[-1][1]
    for here, paths in reversed(cases[:-1]):
        out = F.when(here, paths).otherwise(out)
    return out


def _role(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), name), name)


def _mapped(record: Column, layout: dict[str, str]) -> Column:
    """The turns of a variant record under one layout."""
    family = _family(next(iter(layout)))
    if family:
        fields = {what: p.partition("[].")[2] for p, what in layout.items()}
        items = F.try_variant_get(record, f"$.{family}", "array<variant>")
        get = lambda x, what: F.coalesce(F.try_variant_get(x, f"$.{fields[what]}", "string"), F.lit(""))
        role = (lambda x: get(x, "role")) if family == "turns" else lambda x: _role(get(x, "role"))
        return F.transform(items, lambda x: F.struct(role(x).alias("role"), get(x, "text").alias("text")))
    turns: dict[str, list[str]] = {}
    for p, role in layout.items():
        turns.setdefault(role, []).append(p.rstrip("?"))
    optional = {role: all(f"{p}?" in layout for p in own) for role, own in turns.items()}
    get = lambda p: F.try_variant_get(record, f"$.{p}", "string") if p in layout else F.nullif(F.try_variant_get(record, f"$.{p}", "string"), F.lit(""))
    made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *map(get, own)).alias("text")) for role, own in turns.items()]
    there = [F.coalesce(*map(get, own)).isNotNull() if optional[role] else F.lit(True) for role, own in turns.items()]
    return F.array_compact(F.array(*[F.when(here, turn) for here, turn in zip(there, made)]))


def turns_of_records(records: DataFrame, record_col: str) -> DataFrame:
    """records with layout, layout_fingerprint and turns, in place of a variant column; null layout and turns if the fingerprint is unknown."""
    record = F.col(record_col)
    known = records.withColumn("layout_fingerprint", F.when(record.isNotNull(), fingerprint(present_paths(record))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, fields in LAYOUTS.items():
        own = [fingerprint(F.array(*[F.lit(p) for p in paths])) for paths in fingerprints(name)]
        hit = F.col("layout_fingerprint").isin(*own)
        layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, _mapped(record, fields).cast(TURNS)).otherwise(turns)
    return known.withColumns({"layout": layout, "turns": turns}).drop(record_col)


def turns_of_json(records: DataFrame, json_col: str) -> DataFrame:
    """records with layout, layout_fingerprint and turns; null layout and turns if it is unknown or not JSON."""
    return turns_of_records(records.withColumn("_record", F.try_parse_json(json_col)), "_record")


def turns_of_rows(rows: DataFrame, *, by: str = "conv_id", order: str = "turn", array: str = "turns") -> DataFrame:
    """conv_id, layout, layout_fingerprint and turns of a table with a row for each turn.

    Each conversation becomes a record with an array of that name, of its rows' fields that any layout knows, and goes on like any other record.
    """
    fields = sorted({p.partition("[].")[2] for layout in LAYOUTS.values() for p in layout if "[]." in p} & set(rows.columns))
    fields = [c for c in fields if rows.columns.count(c) == 1]
    if not fields or not {by, order} <= set(rows.columns):
        raise ValueError(f"not a table of turn rows: it has no {by}, no {order}, or no field of a turn once")
    # what a turn is ordered by: its number, then its fields as they are declared
    declared = sorted(fields, key=lambda c: min(list(layout).index(p) for layout in LAYOUTS.values() for p in layout if p.endswith(f"[].{c}")))
    turn = F.struct(F.col(order).alias("n"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in declared])
    whole = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("own"))
    alone = rows.where(F.col(by).isNull()).select(F.col(by).alias("conv_id"), F.array(turn).alias("own"))
    nested = F.transform("own", lambda t: F.struct(*[t[c].alias(c) for c in declared]))
    records = whole.unionByName(alone).select("conv_id", F.to_variant_object(F.struct(nested.alias(array))).alias("_record"))
    return turns_of_records(records, "_record")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are found from the left, as `escape` wrote them; what is between holds single ones."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_turns(convs: DataFrame, *, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """convs with formatted and loss_spans (array of start, length, in code points from 0)."""
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))
    parts = F.transform(turns_col, lambda t: F.struct(head(t).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (t["role"] == loss_role).alias("loss")))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, p: F.struct((a["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
    out = convs.withColumn("_parts", parts)
    return out.withColumns({"formatted": F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""), "loss_spans": F.aggregate("_parts", start, step)["spans"]}).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    role = lambda x: F.substring_index(x, ":\n", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring(role(x), len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 3)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
