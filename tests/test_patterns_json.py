"""Row patterns and JSON schemas against plain versions."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import json_schema
from millrace.operators import patterns
from tests.test_spread import even, tables  # noqa: F401


def plain_matches(rows, named, longest):
    out, by = [], {}
    for k, o, i, x in rows:
        by.setdefault(k, []).append((o, i, x))
    for k, own in by.items():
        own.sort()
        letters = "".join(x if x in ("A", "B") else "." for _, _, x in own)
        for name, p in named.items():
            for s in range(len(own)):
                m = re.compile(p).match(letters, s, min(len(own), s + longest))
                if m and m.end() > s:
                    out.append((name, str(k), own[s][1], own[m.end() - 1][1], m.end() - s))
    return sorted(out)


@pytest.mark.parametrize(("longest", "chunk"), [(1, 1), (7, 7), (9, 50), (40, 5000)])
def test_matches_against_the_plain_way(spark, tables, longest, chunk):  # noqa: F811
    r = random.Random(longest)
    rows = [("hot" if i % 5 else r.choice([None, "a", "b"]), r.randrange(10**6), i, r.choice(["A", "A", "B", "C", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, at int, place int, row string")
    named = {"run": "A+B", "any": "B.{2}|A", "lazy": "B[^A]*?A", "none": "C*", "two": "(A|B){2,3}"}
    letters = {"A": F.col("row") == "A", "B": (F.col("row") == "B") & F.lit(True), "X": F.lit(None).cast("boolean")}
    got = patterns.match_rows(df, ["key"], ["at", "place"], ["place"], letters, named, longest=longest, rows_per_chunk=chunk, parts=6)
    assert sorted((x.pattern, str(x.key), x.first.place, x.last.place, x.n) for x in got.collect()) == plain_matches(rows, named, longest)
    even(tables, "scanned")


def test_pattern_of_one_key_and_none(spark):
    df = spark.range(1000).select("id", F.lit("A").alias("x"))
    got = patterns.match_rows(df, [], ["id"], ["id"], {"A": F.col("x") == "A"}, {"p": "A{3}"}, longest=3, rows_per_chunk=10)
    assert got.count() == 998 and got.columns == ["pattern", "first", "last", "n"]
    assert patterns.match_rows(df.limit(0), [], ["id"], ["id"], {"A": F.col("x") == "A"}, {"p": "A"}).collect() == []
    with pytest.raises(ValueError):
        patterns.match_rows(df, [], ["id"], ["id"], {"AB": F.lit(True)}, {"p": "A"})


def plain_paths(value, path="$"):
    kind = {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", list: "array", dict: "object"}[type(value)]
    yield path, kind
    for k, v in value.items() if kind == "object" else ():
        yield from plain_paths(v, path + "." + re.sub(r"([.\[\]\\])", r"\\\1", k))
    for v in value if kind == "array" else ():
        yield from plain_paths(v, path + "[]")


def made(r, depth=0):
    kind = r.randrange(9 if depth < 3 else 6)
    if kind < 6:
        return [None, True, r.randrange(9), 1.5, "text", ""][kind]
    if kind == 6:
        return [made(r, depth + 1) for _ in range(r.randrange(3))]
    return {r.choice(["a", "b", "a.b", "c[]", "d\\", "`q`", ""]): made(r, depth + 1) for _ in range(r.randrange(4))}


@pytest.mark.parametrize("max_paths", [1, 100_000])
def test_paths_against_the_plain_way(spark, max_paths):
    r = random.Random(8)
    texts = [json.dumps(made(r)) for _ in range(300)] + [None, "", "{", "NaN", '{"a": Infinity}', '{"a": 1, "a": "x"}', "[" * 3000, "1" * 400]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "doc string, day int")
    want, rows = Counter(), Counter()
    for t in texts:
        try:
            bad = t is not None and re.search("NaN|Infinity", t)
            found = Counter([("$", "absent")] if t is None else [("$", "invalid")] if bad else plain_paths(json.loads(t)))
        except ValueError:
            found = Counter([("$", "invalid")])
        except RecursionError:
            found = Counter([("$", "invalid")])
        want.update(found)
        rows.update(list(found))
    got = json_schema.json_paths(df, "doc", max_paths=max_paths).collect()
    assert {(x.path, x.kind): x.n for x in got} == want and {(x.path, x.kind): x.rows for x in got} == rows
    assert json_schema.json_paths(df.limit(0), "doc").collect() == []


def test_types_and_drift(spark):
    days = {"1": ['{"k": 1, "tags": [], "o": {"x.y": null}}', '{"k": 2.5, "s": "a"}', None], "2": ['{"k": null, "tags": ["t"], "s": {"z": 1}}', '{"k": 3, "m": {}}', "no"]}
    df = spark.createDataFrame([(d, t) for d, own in days.items() for t in own], "day string, doc string")
    paths = json_schema.json_paths(df, "doc", "day")
    got = {x.path: (x.type, x.nullable, x.mixed) for x in json_schema.merged(paths).collect()}
    assert got == {"$": ("object", False, False), "$.k": ("double", True, False), "$.tags": ("array", False, False), "$.tags[]": ("string", False, False), "$.o": ("object", False, False), "$.o.x\\.y": ("null", True, False), "$.s": ("string", False, True), "$.s.z": ("integer", False, False), "$.m": ("object", False, False)}
    kind = json_schema.spark_type({k: v[0] for k, v in got.items()})
    assert kind == "struct<`k`:double,`m`:map<string,string>,`o`:struct<`x.y`:string>,`s`:string,`tags`:array<string>>"
    read = df.where("doc like '{%'").select(F.from_json("doc", kind).alias("r")).select("r.k", "r.s", "r.tags", "r.o")
    assert sorted(str(x.k) for x in read.collect()) == ["1.0", "2.5", "3.0", "None"] and read.where("s = '{\"z\":1}' or s = '{\"z\": 1}'").count() == 1
    changes = {(x.path, x.kind, x.change) for x in json_schema.drift(paths, "1", "2").collect()}
    assert ("$.tags[]", "string", "new") in changes and ("$.o", "object", "gone") in changes and ("$.k", "double", "gone") in changes and ("$.k", "null", "new") in changes and ("$", "object", "new") not in changes
