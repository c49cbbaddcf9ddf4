"""Patterns over the rows of each key, in order: a regular expression whose letters are conditions on rows.

Every row gets the letter of the first condition that holds, or a dot. From each row on, the match of an expression (as the `re` module finds it, within `longest` rows) is a
result: the rows from there to its end. Matches may overlap, so a row's result depends on the rows after it only, and at most on `longest` of them.

So keys need no tasks of their own. The prefix scan numbers all rows in the order of keys and times, and chunks of `rows_per_chunk` numbers are the
tasks' groups, each with the next `longest` - 1 rows besides. A key that holds the whole table is spread over all chunks, and a task holds one chunk's letters and ids.

Null keys are a key; a condition that is null does not hold. Rows that tie in the order are told by a hash of their columns. An expression that matches no rows at all
gives nothing there. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators.scan import Running, scan


def spans(letters: str, pattern: re.Pattern, ahead: re.Pattern, start: int, stop: int, end: int, longest: int):
    """(from, to) of the match from each place of start to stop, within letters[start:end]."""
    for m in ahead.finditer(letters, start, end):
        at = m.start()
        if at >= stop:
            return
        found = pattern.match(letters, at, min(end, at + longest))
        if found and found.end() > at:
            yield at, found.end()


def _matcher(patterns: dict[str, str], longest: int, rows_per_chunk: int, schema: pa.Schema):
    def run(batches):
        compiled = {name: (re.compile(p), re.compile(f"(?={p})")) for name, p in patterns.items()}

        def out(held: list[pa.RecordBatch]):
            b = pa.concat_batches(held)
            letters, chunk = "".join(b.column(4).to_pylist()), b.column(0)[0].as_py()
            place, key = b.column(1).to_numpy(), b.column(2).to_numpy()
            own = int(np.searchsorted(place, (chunk + 1) * rows_per_chunk))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for name, (whole, ahead) in compiled.items():
                found = [s for a, z in zip(cuts, cuts[1:]) if a < own for s in spans(letters, whole, ahead, a, min(z, own), z, longest)]
                if found:
                    first, last = np.array(found).T
                    rows = b.column(3)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), rows.take(pa.array(first)), rows.take(pa.array(last - 1)), pa.array(last - first, pa.int64())], schema=schema)

        now, held = None, []
        for b in batches:
            chunk = b.column(0).to_numpy()
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(chunk)) + 1) if b.num_rows else ():
                if chunk[part[0]] != now:
                    if held:
                        yield from out(held)
                    now, held = chunk[part[0]], []
                held.append(b.slice(int(part[0]), len(part)))
        if held:
            yield from out(held)

    return run


def match_rows(rows: DataFrame, by: list[str], order: list[str], keep: list[str], letters: dict[str, Column], patterns: dict[str, str], *, longest: int = 100, rows_per_chunk: int = 50_000, parts: int | None = None) -> DataFrame:
    """(pattern, by, first, last, n): for each match of a named pattern its key, the `keep` columns of its first and last row as structs, and its number of rows."""
    if any(len(x) != 1 for x in letters) or longest < 1 or longest > rows_per_chunk:
        raise ValueError("letters are single, and longest goes from 1 to rows_per_chunk")
    letter = F.lit(".")
    for name, condition in reversed(letters.items()):
        letter = F.when(condition, F.lit(name)).otherwise(letter)
    own = rows.select(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], *[F.col(o.removeprefix("-")).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]).alias("row"), letter.alias("letter"))
    turned = [f"{'-' if o.startswith('-') else ''}o{i}" for i, o in enumerate(order)]
    numbered = scan(own, [*[f"b{i}" for i in range(len(by))], *turned], {"place": Running("count"), "key": Running("changes", of=len(by))}, parts)
    at = F.col("place") - 1
    chunk = F.floor(at / rows_per_chunk)
    again = (at % rows_per_chunk < longest - 1) & (chunk > 0)
    spread = numbered.select(F.explode(F.when(again, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))).alias("chunk"), at.alias("at"), "key", "row", "letter")
    kind = spread.schema["row"].dataType
    schema = StructType([StructField("pattern", StringType()), StructField("first", kind), StructField("last", kind), StructField("n", LongType())])
    spread = spread.repartition("chunk").sortWithinPartitions("chunk", "at")
    found = spread.mapInArrow(_matcher(patterns, longest, rows_per_chunk, to_arrow_schema(schema)), schema)
    ends = [F.struct(*[F.col(e)[f"k{i}"].alias(k) for i, k in enumerate(keep)]).alias(e) for e in ("first", "last")]
    return found.select("pattern", *[F.col("first")[f"b{i}"].alias(b) for i, b in enumerate(by)], *ends, "n")
