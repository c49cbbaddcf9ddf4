"""The schema of JSON texts by reduction: what types each path has, over any number of rows in one aggregation.

Every task folds its rows into counts by path and type, gives them out at its end (or when it knows over `max_paths` paths, as objects used as maps may have any number of
keys), and the counts are added up by path. The types of a path then meet in a lattice: null below all; integer below double; any other two types
below string, which is how Spark would have to read both.

A path is written $.a.b, elements of arrays are []; dots, brackets and backslashes in names get a backslash. A text that is not JSON counts as `invalid` at $, a null
text as `absent`. Of a name that an object repeats the last counts. NaN and infinities, which JSON doesn't have, are invalid. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("null", "boolean", "integer", "double", "string", "array", "object", "invalid", "absent")
_SPECIAL = re.compile(r"([.\[\]\\])")


def _no_constant(name: str):
    raise ValueError(name)


def _visit(value, path: str, found: dict) -> None:
    todo = [(value, path)]
    while todo:
        value, path = todo.pop()
        if isinstance(value, dict):
            kind = "object"
            todo += [(v, f"{path}.{_SPECIAL.sub(r'\\\1', k)}") for k, v in value.items()]
        elif isinstance(value, list):
            kind = "array"
            todo += [(v, f"{path}[]") for v in value]
        else:
            kind = "null" if value is None else "boolean" if value is True or value is False else "integer" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
        found[path, kind] = found.get((path, kind), 0) + 1


def paths_of(text: str | None) -> dict[tuple[str, str], int]:
    """How often each (path, type) is in one text."""
    found: dict[tuple[str, str], int] = {}
    if text is None:
        return {("$", "absent"): 1}
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return {("$", "invalid"): 1}
    _visit(value, "$", found)
    return found


def _fold(max_paths: int):
    def out(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in keys]).cast(pa.string()), pa.array([p for _, p, _ in keys], pa.string()), pa.array([k for _, _, k in keys], pa.string()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.int64())], ["part", "path", "kind", "n", "rows"])

    def run(batches):
        held: dict = defaultdict(lambda: [0, 0])
        for b in batches:
            for part, text in zip(b.column(0).to_pylist(), b.column(1)):
                for (path, kind), n in paths_of(text.as_py()).items():
                    counts = held[part, path, kind]
                    counts[0] += n
                    counts[1] += 1
            if len(held) > max_paths:
                yield out(held)
                held.clear()
        if held:
            yield out(held)

    return run


def json_paths(rows: DataFrame, column: str, part: str | None = None, max_paths: int = 100_000) -> DataFrame:
    """(part, path, kind, n, rows): values of each type at each path, and the rows that have one; `part` splits the report, for instance by day."""
    own = rows.select(F.col(part).cast("string").alias("part") if part else F.lit(None).cast("string").alias("part"), F.col(column).cast("string").alias("text"))
    counts = own.mapInArrow(_fold(max_paths), "part string, path string, kind string, n long, rows long")
    return counts.groupBy("part", "path", "kind").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def merged(paths: DataFrame) -> DataFrame:
    """(path, type, nullable, mixed, n): the type of each path in the lattice, whether it has nulls, and whether types met that only a string can hold."""
    kinds = F.array_sort(F.collect_set("kind"))
    out = paths.where("kind not in ('invalid', 'absent')").groupBy("path").agg(kinds.alias("kinds"), F.sum("n").alias("n"))
    real = F.array_remove("kinds", "null")
    numbers = F.size(F.array_except(real, F.array(F.lit("integer"), F.lit("double")))) == 0
    kind = F.when(F.size(real) == 0, "null").when(F.size(real) == 1, real[0]).when(numbers, "double").otherwise("string")
    return out.select("path", kind.alias("type"), F.array_contains("kinds", "null").alias("nullable"), ((F.size(real) > 1) & ~numbers).alias("mixed"), "n")


def drift(paths: DataFrame, before: str, after: str) -> DataFrame:
    """(path, kind, change): what one part of a report has that another one before it has not, `new`, and what it lacks, `gone`."""
    own = lambda part, name: paths.where(F.col("part") == part).groupBy("path", "kind").agg(F.lit(True).alias(name))
    met = own(before, "was").join(own(after, "is"), ["path", "kind"], "full").where("was is null or is is null")
    return met.select("path", "kind", F.when(F.col("was").isNull(), "new").otherwise("gone").alias("change"))


def spark_type(report: dict[str, str], path: str = "$") -> str:
    """The Spark type of a path from its merged types, objects and arrays with what is below them."""
    kind = report.get(path, "null")
    if kind == "array":
        return f"array<{spark_type(report, path + '[]')}>"
    if kind == "object":
        names = sorted(p[len(path) + 1 :] for p in report if p.startswith(path + ".") and not re.search(r"(?<!\\)[.\[]", p[len(path) + 1 :]))
        fields = ",".join(f"`{re.sub(r'\\(.)', r'\1', n).replace('`', '``')}`:{spark_type(report, f'{path}.{n}')}" for n in names)
        return f"struct<{fields}>" if names else "map<string,string>"
    return {"integer": "bigint", "null": "string"}.get(kind, kind)
