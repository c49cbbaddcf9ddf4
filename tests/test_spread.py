"""Scans, ranks, joins on inequalities and intervals, heavy hitters: against windows, brute force and SQL, with keys that hold the whole table."""

import datetime
import math
import os
import random
from collections import Counter
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import events, heavy, intervals, joins, ranking, scan, theta
from millrace.operators.scan import Running
from millrace.sources import scratch


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def tables(monkeypatch):
    """What a module writes to the shared folder."""
    held = []
    for module in (scan, theta, intervals):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real: held.append((name, out := real(df, name))) or out)
    return held


def same(got, want, key):
    a, b = ({r[key]: {c: str(v) for c, v in r.asDict().items()} for r in d.collect()} for d in (got, want))
    assert sorted(got.columns) == sorted(want.columns) and a == b


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_is_a_window(spark, small_batches, parts):
    r, nan = random.Random(1), float("nan")
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([None, nan, 1.0, 2.0, 3.0, -4.0]) if i % 3 else float(i), i, r.choice([None, 10, 20, -5]), r.choice(["a", None, "b"]), r.choice([None, True, False])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, x double, i int, part int, s1 string, sum boolean")
    got = scan.scan(
        df, ["k", "x", "-i"],
        {
            "n": Running("count", within=1), "row": Running("count"), "tie": Running("count", within=2), "dense": Running("changes", of=2), "own_dense": Running("changes", within=1, of=2), "total": Running("sum", "part", within=1),
            "least": Running("min", "x", within=1), "most": Running("max", "x", within=1), "all": Running("sum", "x"), "low": Running("min", "part", within=2), "last": Running("last", "s1", within=1), "was": Running("before", "s1", within=1), "prev": Running("before", "x"), "flag": Running("last", "sum"),
        },
        parts,
    )
    up = [F.asc_nulls_first("x"), F.desc("i")]
    every, own, tie = Window.orderBy(F.asc_nulls_first("k"), *up), Window.partitionBy("k").orderBy(*up), Window.partitionBy("k", "x").orderBy(F.desc("i"))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(own).alias("n"), F.row_number().over(every).alias("row"), F.row_number().over(tie).alias("tie"), F.dense_rank().over(Window.orderBy("k", "x")).alias("dense"), F.dense_rank().over(Window.partitionBy("k").orderBy("x")).alias("own_dense"),
        F.sum("part").over(so_far(own)).alias("total"), F.min("x").over(so_far(own)).alias("least"), F.max("x").over(so_far(own)).alias("most"), F.sum("x").over(so_far(every)).alias("all"), F.min("part").over(so_far(tie)).alias("low"), F.last("s1", True).over(so_far(own)).alias("last"),
        F.lag("s1").over(own).alias("was"), F.lag("x").over(every).alias("prev"), F.last("sum", True).over(so_far(every)).alias("flag"),
    )
    same(got, want, "i")
    assert scan.scan(df.limit(0), ["k"], {"n": Running("count")}).collect() == []
    with pytest.raises(ValueError):
        scan.scan(df, ["k"], {"n": Running("median", "x")})


def even(tables, name):
    """That no partition of the last scan is over twice the median."""
    table = [t for n, t in tables if n == name][-1]
    sizes = [r["count"] for r in table.groupBy("part").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * median(sizes), sizes


def test_one_key_for_the_whole_table(spark, tables):
    r = random.Random(2)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    left = [(i, "hot", at(r.randrange(20_000))) for i in range(6000)] + [(9000, None, at(5)), (9001, "hot", None), (9002, "cold", at(30_000)), (9003, "hot", at(-1))]
    right = [("hot", at(r.randrange(20_000)), r.choice([None, *range(50)])) for _ in range(40)] + [(None, at(0), 7), ("hot", None, 8), ("cold", at(40_000), 9), ("hot", at(0), 1), ("hot", at(0), 3)]
    a, b = spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int")
    got = {x.i: x.v for x in joins.as_of(a, b, "k", "t", "u", "v", parts=8).collect()}

    def plain(k, t):
        before = [(u, v) for q, u, v in right if None not in (k, t, u, v) and q == k and u <= t]
        return max(before)[1] if before else None

    assert got == {i: plain(k, t) for i, k, t in left}
    even(tables, "scanned")
    twice = joins.as_of(a.withColumn("k2", F.lit(1)), b.withColumn("k2", F.lit(1)), ["k", "k2"], "t", "u", "v").collect()
    assert {x.i: x.v for x in twice} == got
    runs = events.sessions(a.where("k is not null and t is not null"), "k", "t", "4 minutes", parts=8)
    times, want = sorted(t for _, k, t in left if k == "hot" and t), []
    for t in times:
        if not want or t > want[-1][1] + datetime.timedelta(minutes=4):
            want.append([t, t, 0])
        want[-1][1:] = [t, want[-1][2] + 1]
    assert sorted((x.started, x.ended, x.n) for x in runs.where("k = 'hot'").collect()) == [tuple(w) for w in want]
    even(tables, "scanned")


def test_ranks_and_percentiles_of_a_hot_key(spark, tables):
    r = random.Random(3)
    rows = [(i, "hot" if i % 3 else r.choice(["a", None, "b"]), None if i % 50 == 0 else 7.0 if i % 4 == 0 else round(r.gauss(0, 9), 1)) for i in range(6000)]
    df = spark.createDataFrame(rows, "i int, k string, x double")
    got = {x.i: (x.rank, x.dense_rank) for x in ranking.ranks(df, ["-x"], parts=8).collect()}
    even(tables, "scanned")
    values = [x for _, _, x in rows if x is not None]
    above, distinct = Counter(values), sorted(set(values), reverse=True)
    place, total = {}, 1
    for d, x in enumerate(distinct):
        place[x] = (total, d + 1)
        total += above[x]
    assert got == {i: place.get(x, (total, len(distinct) + 1)) for i, _, x in rows}
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    found = ranking.percentiles(df, ["k"], "x", shares, parts=8).collect()
    own = {k: [x for _, q, x in rows if q == k and x is not None] for k in {k for _, k, _ in rows}}
    assert sorted((str(f.k), f.share, f.n) for f in found) == sorted((str(k), q, len(v)) for k, v in own.items() for q in shares)
    assert all(math.isclose(f.value, np.quantile(own[f.k], f.share), abs_tol=1e-9) for f in found)
    assert ranking.percentiles(df.where("x is null"), ["k"], "x", shares).collect() == []
    assert len(ranking.percentiles(df, [], "x", [0.5]).collect()) == 1


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def key(x):
    return math.inf if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("on", [[("a", "<", "c")], [("a", ">=", "c"), ("b", "<=", "d")], [("a", "<=", "c"), ("a", ">", "d"), ("b", "<", "d")]])
def test_theta_against_brute_force(spark, small_batches, tables, on):
    r = random.Random(4)
    value = lambda: r.choice([None, float("nan"), 5.0, 5.0, 5.0, -0.0, 0.0, r.uniform(-9, 9), r.uniform(-9, 9)])
    left, right = ([(i, value(), value()) for i in range(n)] for n in (300, 200))
    a, b = spark.createDataFrame(left, "i int, a double, b double"), spark.createDataFrame(right, "j int, c double, d double")
    got = theta.theta(a, b, on, rows_per_cell=30, chunk=100)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    at = {"a": 1, "b": 2, "c": 1, "d": 2}
    meets = lambda p, q: all(None not in (p[at[x]], q[at[y]]) and OPS[op](key(p[at[x]]), key(q[at[y]])) for x, op, y in on)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((p[0], q[0]) for p in left for q in right if meets(p, q))
    sizes = [x["count"] for _, t in tables for x in t.groupBy("cell").count().collect()]
    assert max(sizes) <= 75  # a value of a third of the rows is several cells


def test_one_pair_of_cells_is_several_tasks(spark):
    # two rows that keep all others: within the ends of the other side
    a = spark.range(12_000).select("id", F.lit(0).alias("a"), F.expr("if(id = 0, 20000, cast(id * 7919 % 12000 as int))").alias("b"))
    b = spark.range(12_000).select(F.col("id").alias("j"), F.lit(1).alias("c"), F.expr("if(id = 0, -1, cast(11900 + id % 100 as int))").alias("d"))
    want = sum(120 * min(100, x - 11_900) for x in range(11_900, 12_000)) - sum(x > 11_900 for x in range(12_000)) + 12_000 + 11_999
    n = [r["count"] for r in theta.theta(a, b, [("a", "<", "c"), ("b", ">", "d")]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == want and len(n) > 1 and max(n) < 0.7 * want
    few = theta.theta(a.where("id < 900"), b.where("j < 700"), [("a", "<", "c")], keep=["id", "j"], rows_per_slice=100, per_task=30_000)
    n = [r["count"] for r in few.groupBy(F.spark_partition_id()).count().collect()]
    assert few.columns == ["id", "j"] and sum(n) == 900 * 700 and len(n) > 15 and max(n) <= 60_000 and few.distinct().count() == 900 * 700


def test_theta_of_other_types_and_empty_sides(spark):
    day = lambda k: datetime.date(2024, 1, 1 + k)
    a, b = spark.createDataFrame([(day(k), k) for k in range(9)], "a date, i long"), spark.createDataFrame([(day(k), k) for k in range(5)], "b date, j long")
    assert theta.theta(a, b, [("a", "<", "b"), ("i", "<", "j")]).count() == 10
    assert theta.theta(a, b.limit(0), [("a", "<", "b")]).collect() == [] == theta.theta(a.limit(0), b, [("a", "<", "b")]).collect()
    times = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 3), 1)], "t timestamp_ntz, n int"), spark.createDataFrame([(datetime.datetime(2024, 1, 1, 4), 1)], "u timestamp_ntz, m int")
    assert theta.theta(*times, [("t", "<", "u")]).count() == 1 and theta.theta(*times, [("t", ">", "u")]).count() == 0
    with pytest.raises(TypeError):
        theta.theta(a, b, [("a", "<", "j")])
    with pytest.raises(ValueError):
        theta.theta(a, a, [("a", "<", "a")])


@settings(deadline=None)
@given(st.lists(st.floats(allow_nan=True), min_size=1))
def test_ordinals_keep_the_order(values):
    got = theta.ordinal(pa.array(values, pa.float64())).tolist()
    for x, p in zip(values, got):
        for y, q in zip(values, got):
            nan = math.isnan(x), math.isnan(y)
            assert (p < q) == (x < y if not any(nan) else nan == (False, True)) and (p == q) == (x == y or all(nan))


def test_columns_that_have_no_hash(spark):
    a = spark.createDataFrame([(k, k + 5, {"a": k}, [{"b": k}]) for k in range(20)], "s long, e long, m map<string,int>, n array<map<string,int>>")
    b = a.toDF("f", "t", "p", "q")
    met = intervals.overlaps(a, b, ("s", "e"), ("f", "t")).collect()
    assert len(met) == sum(abs(x - y) <= 5 for x in range(20) for y in range(20)) and all(r.m == {"a": r.s} and r.q == [{"b": r.f}] for r in met)
    assert len([r for r in theta.theta(a, b, [("s", "<", "f")], rows_per_cell=4).collect() if r.m == {"a": r.s}]) == 190
    at = joins.as_of(a.withColumn("k", F.lit(1)), b.select(F.lit(1).alias("k"), "f", F.col("t").alias("v")), "k", "s", "f", "v").collect()
    assert all(r.v == r.s + 5 and r.m == {"a": r.s} for r in at) and len(at) == 20
    with pytest.raises(ValueError):
        scan.scan(a, [], {"n": Running("count")})


@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_against_brute_force(spark, hot):
    r = random.Random(5)

    def spans(n, name):
        out = []
        for i in range(n):
            s = r.randrange(-3000, 3000)
            out.append((i, s, s + r.choice([0, 1, 3, 60, 900, 6000]), r.choice([1, 2, None])))
        return out + [(n, None, 5, 1), (n + 1, 5, None, 1), (n + 2, 9, 3, 1), (n + 3, -5000, 9000, 1), (n + 4, 0, 0, 1), (n + 4, 0, 0, 1)] + ([(9000 + k, -3000, 3000, 1) for k in range(40)] if hot else [])

    left, right = spans(160, "l"), spans(120, "r")
    a, b = spark.createDataFrame(left, "i int, s int, e int, k int"), spark.createDataFrame(right, "j int, f int, t int, q int")
    limit = 25 if hot else 100_000
    ok = lambda x: None not in x[1:3] and x[1] <= x[2]
    meets = lambda x, y: ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2]
    got = intervals.overlaps(a, b, ("s", "e"), ("f", "t"), rows_per_task=limit)
    assert got.columns == ["i", "s", "e", "k", "j", "f", "t", "q"] and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y))
    keyed = intervals.overlaps(a, b, ("s", "e"), ("f", "t"), by=(("k", "q"),), unit=5, rows_per_task=limit)
    assert sorted((x.i, x.j) for x in keyed.collect()) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y) and x[3] is not None and x[3] == y[3])


def test_an_interval_over_everything_is_dealt_out(spark):
    spans = spark.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(100_000).cast("long").alias("last"), F.col("id").alias("tie"), F.struct("id").alias("row"))
    starts = spark.range(20_000).select((F.col("id") * 5).alias("at"), F.xxhash64("id").alias("tie"), F.struct("id").alias("row"))
    held, at, on = intervals.keyed(spans, starts, [], 500)
    assert at.groupBy(*on).count().agg(F.max("count")).first()[0] <= 1000
    assert held.count() == 40 and at.join(held.drop("row"), on).count() == 20_000
    times = [(datetime.datetime(2024, 1, d, 1), datetime.datetime(2024, 1, d + 2)) for d in range(1, 20)]
    a, b = spark.createDataFrame(times, "s timestamp_ntz, e timestamp_ntz"), spark.createDataFrame(times, "f timestamp_ntz, t timestamp_ntz")
    assert intervals.overlaps(a, b, ("s", "e"), ("f", "t"), unit=3600).count() == sum(p[0] <= q[1] and q[0] <= p[1] for p in times for q in times)
    assert intervals.overlaps(a.limit(0), b, ("s", "e"), ("f", "t")).collect() == []


def test_working_tables_go(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    with scratch.working_tables(spark) as made:
        kept, path = scratch.write(ranking.ranks(spark.range(100).selectExpr("id % 7 as x"), ["x"]), "ranked")
        made.remove(path)
        assert len(set(os.listdir(shared)) - before) == 2
    assert len(set(os.listdir(shared)) - before) == 1 and kept.count() == 100
    scratch.drop(spark, path)
    with pytest.raises(RuntimeError), scratch.working_tables(spark):
        scratch.written(spark.range(3), "some")
        raise RuntimeError
    assert set(os.listdir(shared)) == before


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=6), st.integers(1, 8))
def test_lowered_counters_lose_no_frequent_key(batches, size):
    held = Counter()
    for b in batches:
        held = heavy.lowered(held + Counter(b), size)
    exact, n = Counter(k for b in batches for k in b), sum(map(len, batches))
    assert len(held) <= size and all(k in held for k, c in exact.items() if c * (size + 1) > n)


def test_heavy_hitters(spark):
    r = random.Random(6)
    keys = ["hot"] * 4000 + ["warm"] * 300 + [None] * 500 + [f"cold{r.randrange(5000)}" for _ in range(7000)] + ["edge"] * 113
    r.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(300)  # so many summaries are merged in rounds
    exact = Counter(k for k in keys if k)
    for share in (0.02, 0.005, 113 / sum(exact.values())):
        got = heavy.heavy_hitters(df, "key", share).collect()
        assert {x.key: x.n for x in got} == {k: n for k, n in exact.items() if n > share * sum(exact.values())}
        assert all(x.total == sum(exact.values()) for x in got)
    assert heavy.heavy_hitters(df.limit(0), "key", 0.1).collect() == []
    assert {x.key for x in heavy.heavy_hitters(spark.range(50).selectExpr("id % 3 as n"), "n", 0.1).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        heavy.heavy_hitters(df, "key", 1.5)
