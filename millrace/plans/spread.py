"""Queries of the operators that Spark lacks or runs in one task: (Spark query, the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import json_schema
from millrace.functions.aggregate import Covariance, aggregated
from millrace.operators import events, intervals, patterns, ranking, sketches, theta
from millrace.operators.heavy import heavy_hitters
from millrace.sources.arrow_files import ArrowFiles
from millrace.sources.scratch import fresh_path, written
from millrace.sources.tables import table


def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all lines by quantity and of all events by value, each over the whole table."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    ranked = ranking.ranks(lines, ["-quantity"])
    return ranked.select("l_orderkey", "rank", "dense_rank")


def type_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.0, 0.1, 0.5, 0.99])
    return found.select("event_type", "share", "n", F.round("value", 6).alias("value"))


def table_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over the whole table in time order: one key for all rows."""
    own = {"n": ("count", None), "total": ("sum", "k"), "least": ("min", "value"), "most": ("max", "value"), "last_error": ("last", "error"), "before": ("before", "event_type")}
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))
    return ranking.running(rows, [], ["ts", "event_id"], own).drop("ts", "value", "event_type", "k", "error")


def late_cheaper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders at the two ends of the time, the later one being cheaper."""
    o = table(spark, sf_dir, "orders")
    early = o.select(F.col("o_orderkey").alias("early"), (F.col("o_orderdate") + F.expr("interval 2390 days")).alias("until"), F.col("o_totalprice").alias("price"))
    late = o.select(F.col("o_orderkey").alias("late"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("less"))
    return theta.theta(early, late, [("until", "<=", "day"), ("price", ">", "less")], keep=["early", "late"])


def close_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers whose balances lie within 2 of each other: a band without any key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 2).alias("low"), (F.col("s_acctbal") + 2).alias("high"))
    return theta.theta(c, s, [("c_acctbal", ">=", "low"), ("c_acctbal", "<=", "high")], keep=["c_custkey", "s_suppkey"])


def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sessions of different users that share a moment; a session without length counts too."""
    own = written(events.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes").where("n > 1"), "sessions")
    a, b = (own.select(F.col("user_id").alias(f"{x}_user"), F.col("started").alias(f"{x}_start"), F.col("ended").alias(f"{x}_end")) for x in "ab")
    met = intervals.overlaps(a, b, ("a_start", "a_end"), ("b_start", "b_end"), unit=60)
    return met.where("a_user < b_user").select("a_user", "b_user", F.greatest("a_start", "b_start").alias("both_from"))


def order_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders were open on some day of each quarter; an order is open until its last line is shipped, if that is not before its date."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderdate").alias("opened"), "closed")
    first = orders.select(F.date_trunc("quarter", "opened").cast("timestamp_ntz").alias("quarter")).distinct()
    quarters = first.select("quarter", (F.col("quarter") + F.expr("interval 3 months") - F.expr("interval 1 second")).alias("until"))
    met = intervals.overlaps(orders, quarters, ("opened", "closed"), ("quarter", "until"), unit=86_400)
    return met.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that make more than a fifth of a percent of them."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return heavy_hitters(words, "word", 0.002).select(F.col("key").alias("word"), "n", "total")


def sketched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day, and those that both clicked and purchased, from hourly states that are stored and merged; the exact figures beside them.

    Distinct counts hold at three standard errors, the median at twice its bound; theta sketches are exact up to 4,096 keys.
    """
    rows = table(spark, sf_dir, "events")
    states = written(sketches.hourly(rows, "ts", ["event_type"], "user_id", "value"), "states")
    day = lambda c: F.col(c).cast("date").alias("day")
    about = sketches.estimates(sketches.merged(states, day("hour")), [0.5])
    both = sketches.shared_keys(states, [day("hour")], "event_type", ["click", "purchase"])
    exact = rows.groupBy(day("ts")).agg(F.countDistinct("user_id").alias("users"))
    ends = ranking.percentiles(rows.select(day("ts"), "value"), ["day"], "value", [0.5 - 2 * sketches.KLL_ERROR, 0.5 + 2 * sketches.KLL_ERROR]).groupBy("day").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    kinds = rows.where("event_type in ('click', 'purchase')").groupBy(day("ts"), "user_id").agg(F.countDistinct("event_type").alias("kinds"))
    met = kinds.groupBy("day").agg(F.count(F.when(F.col("kinds") == 2, 1)).alias("both"))
    near = lambda a, b, error, of: F.abs(F.col(a) - F.col(b)) <= 3 * error * F.col(of) + 0.5
    found = about.join(exact, "day").join(met, "day").join(both, "day", "left").join(ends, "day")
    return found.select(
        "day", "n", "users", "both", near("hll_keys", "users", sketches.HLL_ERROR, "users").alias("hll_near"), near("theta_keys", "users", sketches.THETA_ERROR, "users").alias("theta_near"),
        near("keys", "both", sketches.THETA_ERROR, "users").alias("both_near"), F.col("quantiles")[0].between(F.col("low"), F.col("high")).alias("middle_near"),
    )


def label_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each label's vectors: the covariance's trace and its largest entry off the diagonal, by a mergeable aggregate."""
    found = aggregated(table(spark, sf_dir, "embeddings"), ["label"], ["embedding"], Covariance(), "n long, trace double, off double")
    return found.select("label", "n", F.round("trace", 6).alias("trace"), F.round("off", 6).alias("off"))


def arrow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as Arrow files and read again, by a filter that skips batches on their statistics."""
    spark.dataSource.register(ArrowFiles)
    folder = fresh_path(spark, "arrow")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    lines.sortWithinPartitions("l_orderkey").write.format("arrow_files").mode("append").save(folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    back = spark.read.format("arrow_files").option("pushdown", "true").schema(lines.schema).load(folder).where("l_orderkey > 1000 and l_returnflag <> 'A'")
    return back.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("latest"))


#: Letters of event types, and patterns over a user's events
LETTERS = {"V": "view", "C": "click", "E": "error", "P": "purchase", "S": "signup"}
PATTERNS = {"funnel": "VC*P", "errors": "E{2,}", "bought": "S[^E]*?P"}


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three patterns over each user's events."""
    letters = {x: F.col("event_type") == kind for x, kind in LETTERS.items()}
    found = patterns.match_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id"], letters, PATTERNS, longest=20)
    return found.select("pattern", "user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "n")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by path of orders as JSON: lines nested, totals of one status as text, arrays that may be empty or null."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("q"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"'))).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    text = F.concat(F.lit('{"total":'), total, F.lit(',"lines":'), F.coalesce(F.to_json("lines", {"ignoreNullFields": "false"}), F.lit("null")), F.lit("}"))
    return json_schema.json_paths(orders.select(text.alias("doc")), "doc").drop("part")


_SESSIONS = """o as (select user_id, ts, case when ts <= lag(ts) over w + interval 30 minutes then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
           r as (select user_id, ts, sum(opens) over (partition by user_id order by ts) as run from o),
           s as (select user_id, min(ts) as started, max(ts) as ended from r group by user_id, run having count(*) > 1)"""

QUERIES = {
    "value_ranks": (
        value_ranks,
        """select l_orderkey, rank() over (order by q desc) as rank, dense_rank() over (order by q desc) as dense_rank
           from (select l_orderkey, sum(l_quantity) as q from lineitem group by 1)""",
    ),
    "type_percentiles": (
        type_percentiles,
        """select event_type, cast(share as double) as share, count(value) as n, round(case share when 0 then min(value) when 0.1 then quantile_cont(value, 0.1) when 0.5 then quantile_cont(value, 0.5)
           else quantile_cont(value, 0.99) end, 6) as value from events, (values (0), (0.1), (0.5), (0.99)) as s(share) group by 1, share""",
    ),
    "table_so_far": (
        table_so_far,
        """select event_id, row_number() over w as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) over w as bigint) as total, min(value) over w as least, max(value) over w as most,
           last_value(case when event_type = 'error' then event_id end ignore nulls) over w as last_error, lag(event_type) over (order by ts, event_id) as before
           from events window w as (order by ts, event_id rows unbounded preceding)""",
    ),
    "late_cheaper_orders": (
        late_cheaper_orders,
        """select a.o_orderkey as early, b.o_orderkey as late from orders a join orders b on a.o_orderdate + interval 2390 days <= b.o_orderdate and a.o_totalprice > b.o_totalprice""",
    ),
    "close_balances": (close_balances, "select c_custkey, s_suppkey from customer join supplier on c_acctbal >= s_acctbal - 2 and c_acctbal <= s_acctbal + 2"),
    "overlapping_sessions": (
        overlapping_sessions,
        f"""with {_SESSIONS} select a.user_id as a_user, b.user_id as b_user, greatest(a.started, b.started) as both_from
            from s a join s b on a.started <= b.ended and b.started <= a.ended and a.user_id < b.user_id""",
    ),
    "order_phases": (
        order_phases,
        """with o as (select o_orderkey, o_orderdate as opened, max(l_shipdate) as closed from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
           q as (select distinct date_trunc('quarter', opened) as quarter from o)
           select cast(quarter as timestamp) as quarter, count(*) as n from q join o on opened < quarter + interval 3 months and closed >= quarter and closed >= opened group by 1""",
    ),
    "sketched_days": (
        sketched_days,
        """with d as (select cast(ts as date) as day, count(*) as n, count(distinct user_id) as users from events group by 1),
           k as (select cast(ts as date) as day, user_id, count(distinct event_type) as kinds from events where event_type in ('click', 'purchase') group by 1, 2),
           b as (select day, count(*) filter (kinds = 2) as both from k group by 1)
           select day, n, users, "both", true as hll_near, true as theta_near, true as both_near, true as middle_near from d join b using (day)""",
    ),
    "label_spread": (
        label_spread,
        """with e as (select label, vec_id, i, cast(embedding[i] as double) as x from embeddings, range(1, 65) as r(i)),
           t as (select label, sum(v) as trace from (select label, i, var_pop(x) as v from e group by 1, 2) group by 1),
           o as (select label, max(abs(c)) as off from (select a.label, a.i, b.i, covar_pop(a.x, b.x) as c from e a join e b on a.vec_id = b.vec_id and a.i < b.i group by 1, 2, 3) group by 1),
           n as (select label, count(*) as n from embeddings group by 1)
           select label, n, round(trace, 6) as trace, round(off, 6) as off from n join t using (label) join o using (label)""",
    ),
    "arrow_lines": (
        arrow_lines,
        """select l_returnflag, l_linenumber, count(*) as n, sum(l_quantity) as quantity, max(l_shipdate) as latest from lineitem
           where l_orderkey > 1000 and l_returnflag <> 'A' group by 1, 2""",
    ),
    "user_paths": (
        user_paths,
        """with e as (select user_id, event_id, case event_type when 'view' then 'V' when 'click' then 'C' when 'error' then 'E' when 'purchase' then 'P' when 'signup' then 'S' else '.' end as x,
             row_number() over (partition by user_id order by ts, event_id) as i from events),
           s as (select user_id, string_agg(x, '' order by i) as s, list(event_id order by i) as ids from e group by 1),
           m as (select p.name as pattern, e.user_id, e.event_id as first_id, ids, i, length(regexp_extract(substring(s, i, 20), p.p)) as n
                 from e join s using (user_id), (values ('funnel', '^VC*P'), ('errors', '^E{2,}'), ('bought', '^S[^E]*?P')) as p(name, p))
           select pattern, user_id, first_id, ids[i + n - 1] as last_id, n from m where n > 0""",
    ),
    "order_documents": (
        order_documents,
        """with o as (select o_orderkey, o_orderstatus from orders), l as (select * from lineitem join o on l_orderkey = o_orderkey), h as (select distinct l_orderkey from l)
           select '$' as path, 'object' as kind, count(*) as n, count(*) as rows from o
           union all select '$.total', case when o_orderstatus = 'P' then 'string' else 'double' end as k, count(*), count(*) from o group by k
           union all select '$.lines', case when l_orderkey is null then 'null' else 'array' end as k, count(*), count(*) from o left join h on o_orderkey = l_orderkey group by k
           union all select '$.lines[]', 'object', count(*), count(distinct l_orderkey) from l
           union all select '$.lines[].q', 'integer', count(*), count(distinct l_orderkey) from l
           union all select '$.lines[].flag', case when l_returnflag = 'N' then 'null' else 'string' end as k, count(*), count(distinct l_orderkey) from l group by k""",
    ),
    "frequent_words": (
        frequent_words,
        """with w as (select unnest(string_split(lower(text), ' ')) as word from documents), k as (select word from w where word <> ''), t as (select count(*) as total from k)
           select word, count(*) as n, any_value(total) as total from k, t group by word having count(*) > 0.002 * any_value(total)""",
    ),
}
