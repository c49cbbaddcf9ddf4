"""More queries by name: (Spark query, the same in SQL or None)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import python
from millrace.operators import events, ranking, sketches
from millrace.sources.tables import table


def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct count is an aggregate of its own: beside the others it would carry their buffers by user through a shuffle."""
    r, e = lambda x, name: F.round(x, 4).alias(name), table(spark, sf_dir, "events")
    spread = e.groupBy("event_type").agg(
        r(F.stddev_samp("value"), "deviation"), r(F.var_pop("value"), "variance"), r(F.min("value"), "least"), r(F.max("value"), "most"),
        r(F.percentile("value", F.lit(0.9)), "p90"), r(F.median("value"), "middle"), r(F.corr("value", F.col("user_id").cast("double")), "corr"),
        F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("over"),
    )
    return spread.join(e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")), "event_type")


def sketches_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact figures, and whether sketches of fixed size come within their stated errors of them: three standard errors, or one step of a rank."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts")).join(lines.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("middle")), "l_returnflag")
    about = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(sketches.SIZE))).alias("hll"), F.approx_percentile("l_quantity", 0.5, F.lit(10_000)).alias("mid"))
    near = lambda a, b, share: F.abs(F.col(a) - F.col(b)) <= share * F.col(b)
    return exact.join(about, "l_returnflag").select(
        "l_returnflag", "parts", "middle", near("about", "parts", 3 * 0.02).alias("distinct_near"), near("hll", "parts", 3 * sketches.HLL_ERROR).alias("hll_near"), (F.abs(F.col("mid") - F.col("middle")) <= 1).alias("middle_near"),
    )


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.where("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda name, key, bal, out: table(spark, sf_dir, name).where(f"{bal} > 9000").groupBy(F.col(key).alias("k")).agg(F.round(F.sum(bal), 2).alias(out))
    return own("customer", "c_nationkey", "c_acctbal", "customers").join(own("supplier", "s_nationkey", "s_acctbal", "suppliers"), "k", "full")


def part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size").isin(1, 2, 3), "tiny").when(F.col("p_size").between(4, 25), "small").otherwise("large")
    return table(spark, sf_dir, "part").where(F.col("p_brand").like("Brand#%") & ~F.col("p_type").rlike("^PROMO")).groupBy(kind.alias("kind"), F.upper(F.substring("p_type", 1, 3)).alias("start")).agg(F.count(F.lit(1)).alias("n"))


def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate"))
    rows = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(day).alias("rank"), F.dense_rank().over(day).alias("dense"), F.ntile(3).over(own).alias("third"),
        F.round(F.percent_rank().over(day), 6).alias("percent"), F.round(F.cume_dist().over(own), 6).alias("cume"), F.lead("o_orderkey", 2, -1).over(own).alias("after_next"),
        F.first("o_orderkey").over(rows).alias("first"), F.nth_value("o_orderkey", 2).over(rows).alias("second"),
    )


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = "over (partition by user_id order by ts range between interval 1 day preceding and current row)"
    return table(spark, sf_dir, "events").select("event_id", F.expr(f"count(*) {frame}").alias("n"), F.expr(f"round(sum(value) {frame}, 4)").alias("total"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", F.count(F.lit(1)).alias("n"))


def long_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s) for s in "FOP"])
    return wide.unpivot("o_orderpriority", ["F", "O", "P"], "status", "n")


def grouped_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").groupingSets([[c("l_returnflag"), c("l_linestatus")], [c("l_returnflag")], []], "l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _nations(spark, sf_dir)
    return c.intersectAll(s)


def one_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _nations(spark, sf_dir)
    return c.union(s).where("k % 2 = 0").subtract(s.where("k % 4 = 0"))


def typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int, other string")
    return table(spark, sf_dir, "events").select("event_id", props.alias("p")).groupBy((F.col("p.k") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.count("p.other").alias("others"), F.max(F.to_json(F.struct(F.col("p.k").alias("k")))).alias("most"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(c).alias("up"), F.lpad(F.regexp_extract(c, r"(\d+)$", 1), 12, "*").alias("digits"), F.split(c, "#")[0].alias("head"), F.reverse(c).alias("back"),
        F.translate(c, "mor", "xyz").alias("swapped"), F.instr(c, "#").cast("long").alias("at"), F.concat_ws("-", F.lower("c_mktsegment"), F.substring(c, 1, 3)).alias("joined"), F.md5(c).alias("md5"),
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.dayofyear(d).cast("long").alias("n"), F.weekofyear(d).cast("long").alias("w"),
        F.last_day(d.cast("date")).alias("ends"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.datediff(F.lit("2002-01-01").cast("date"), d.cast("date")).cast("long").alias("left"), F.add_months(d.cast("date"), 1).alias("next"),
    )


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and maps of each order's lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return lines.select(
        "l_orderkey", F.size("q").cast("long").alias("n"), F.element_at("q", -1).alias("most"), F.size(F.filter("q", lambda x: x > 25)).cast("long").alias("large"), F.array_join("flags", "").alias("flags"),
        F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max(F.transform("q", lambda x: x % 7)).alias("rest"), F.element_at(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.element_at("q", 1), F.element_at("q", -1))), "a").alias("least"), F.array_contains("flags", "R").alias("returned"),
    )


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sqrt(x), 6).alias("root"), F.round(F.ln(x), 6).alias("log"), F.floor(x).alias("down"), F.ceil(x).alias("up"), F.pow("p_size", F.lit(2.0)).alias("square"),
        F.greatest("p_size", F.lit(10)).alias("most"), F.signum(x - 1000).alias("sign"), F.try_divide(x, F.col("p_size") - 1).isNull().alias("by_zero"), F.col("p_partkey").bitwiseAND(F.lit(7)).alias("bits"),
    )


def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = python.vectorized(_half, "double")
    return table(spark, sf_dir, "events").select("event_id", half("value").alias("half"))


def _half(x: pd.Series) -> pd.Series:
    return (x / 2).clip(upper=50)


class _Steps:
    def eval(self, n: int):
        for k in range(n % 4):
            yield (k,)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.udtf(_Steps, returnType="step int")
    return table(spark, sf_dir, "part").lateralJoin(of(F.col("p_size").outer())).select("p_partkey", "step")


def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest fall below a day's highest value so far, of each user and day; a user with most of the events is spread over all tasks."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", "value")
    high = ranking.running(rows, ["user_id", "day"], ["ts", "event_id"], {"high": ("max", "value")})
    return high.groupBy("user_id", "day").agg(F.round(F.max(F.col("high") - F.col("value")), 4).alias("fall"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each batch in Python, then of those."""
    parts = python.by_batch(table(spark, sf_dir, "events").select("event_type", "value"), _totals, "event_type string, n long, total double")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


def _totals(batches):
    for b in batches:
        yield b.groupby("event_type", as_index=False).agg(n=("value", "size"), total=("value", "sum"))


TABLES = ["customer", "orders", "lineitem", "supplier", "nation", "region", "part"]


def _sql(text: str):
    named = re.sub(rf"\b({'|'.join(TABLES)})\b", r"{\1}", text)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if f"{{{t}}}" in named]
        return spark.sql(named, **{t: table(spark, sf_dir, t) for t in used})  # no views that could replace a caller's

    return query


#: The same text for both engines.
BOTH = {
    "shipping_priority": """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey
        join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15'
        group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
    "local_suppliers": """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name""",
    "forecast": """select round(sum(l_extendedprice * l_discount), 2) as revenue, count(*) as n from lineitem
        where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "promotion": """select l_returnflag, round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice else 0 end) / sum(l_extendedprice), 4) as share
        from lineitem join part on l_partkey = p_partkey group by l_returnflag""",
    "small_quantity": """select l_partkey, round(sum(l_extendedprice) / 7.0, 2) as yearly from lineitem a
        where l_quantity < (select 0.5 * avg(l_quantity) from lineitem b where b.l_partkey = a.l_partkey) group by l_partkey""",
    "customers_without_urgent": """select c_nationkey, count(*) as n, round(avg(c_acctbal), 2) as mean from customer
        where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') and c_acctbal > (select avg(c_acctbal) from customer) group by c_nationkey""",
    "order_counts": """with c as (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus <> 'P' group by c_custkey)
        select n, count(*) as customers from c group by n having count(*) > 0""",
}

QUERIES = {
    "value_spread": (
        value_spread,
        """select event_type, round(stddev_samp(value), 4) as deviation, round(var_pop(value), 4) as variance, round(min(value), 4) as least, round(max(value), 4) as most,
           round(quantile_cont(value, 0.9), 4) as p90, round(median(value), 4) as middle, round(corr(value, cast(user_id as double)), 4) as corr,
           count(distinct user_id) as users, cast(sum(case when value > 100 then 1 else 0 end) as bigint) as over from events group by 1""",
    ),
    "sketches_agree": (
        sketches_agree,
        """select l_returnflag, count(distinct l_partkey) as parts, quantile_cont(l_quantity, 0.5) as middle, true as distinct_near, true as hll_near, true as middle_near from lineitem group by 1""",
    ),
    "supplier_nations": (supplier_nations, "select n_name, count(s_suppkey) as n from (select * from supplier where s_acctbal > 5000) right join nation on s_nationkey = n_nationkey group by 1"),
    "balances": (
        balances,
        """select k, customers, suppliers from (select c_nationkey as k, round(sum(c_acctbal), 2) as customers from customer where c_acctbal > 9000 group by 1)
           full join (select s_nationkey as k, round(sum(s_acctbal), 2) as suppliers from supplier where s_acctbal > 9000 group by 1) using (k)""",
    ),
    "part_kinds": (
        part_kinds,
        """select case when p_size in (1, 2, 3) then 'tiny' when p_size between 4 and 25 then 'small' else 'large' end as kind, upper(substring(p_type, 1, 3)) as start, count(*) as n
           from part where p_brand like 'Brand#%' and not regexp_matches(p_type, '^PROMO') group by 1, 2""",
    ),
    "largest_orders": (largest_orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100"),
    "order_ranks": (
        order_ranks,
        """select o_orderkey, cast(rank() over day as int) as rank, cast(dense_rank() over day as int) as dense, cast(ntile(3) over own as int) as third, round(percent_rank() over day, 6) as percent,
           round(cume_dist() over own, 6) as cume, lead(o_orderkey, 2, -1) over own as after_next,
           first_value(o_orderkey) over (own rows between unbounded preceding and unbounded following) as first, nth_value(o_orderkey, 2) over (own rows between unbounded preceding and unbounded following) as second
           from orders window own as (partition by o_custkey order by o_orderdate, o_orderkey), day as (partition by o_custkey order by year(o_orderdate))""",
    ),
    "last_day": (
        last_day,
        """select event_id, count(*) over w as n, round(sum(value) over w, 4) as total from events
           window w as (partition by user_id order by ts range between interval 1 day preceding and current row)""",
    ),
    "sliding_counts": (
        sliding_counts,
        """select time_bucket(interval 15 minutes, ts) - to_minutes(cast(15 * k as int)) as started, count(*) as n from events, range(4) as r(k) group by 1""",
    ),
    "long_status": (
        long_status,
        """select o_orderpriority, s as status, count(*) filter (o_orderstatus = s) as n from orders, (values ('F'), ('O'), ('P')) as v(s) group by 1, 2""",
    ),
    "grouped_sets": (
        grouped_sets,
        """select l_returnflag, l_linestatus, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as level, count(*) as n, round(sum(l_quantity), 2) as quantity
           from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    ),
    "both_sides": (both_sides, "select c_nationkey as k from customer intersect all select s_nationkey from supplier"),
    "one_side": (one_side, "select k from (select c_nationkey as k from customer union all select s_nationkey from supplier) where k % 2 = 0 except select s_nationkey from supplier where s_nationkey % 4 = 0"),
    "typed_json": (
        typed_json,
        """select cast(json_extract_string(props, '$.k') as int) % 10 as digit, count(*) as n, count(json_extract_string(props, '$.other')) as others,
           max('{"k":' || json_extract_string(props, '$.k') || '}') as most from events group by 1""",
    ),
    "strings": (
        strings,
        """select c_custkey, upper(c_name) as up, lpad(regexp_extract(c_name, '(\\d+)$', 1), 12, '*') as digits, split_part(c_name, '#', 1) as head, reverse(c_name) as back,
           translate(c_name, 'mor', 'xyz') as swapped, cast(instr(c_name, '#') as bigint) as at, lower(c_mktsegment) || '-' || substring(c_name, 1, 3) as joined, md5(c_name) as md5 from customer""",
    ),
    "dates": (
        dates,
        """select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, dayofyear(o_orderdate) as n, weekofyear(o_orderdate) as w, last_day(o_orderdate) as ends,
           cast(date_trunc('month', o_orderdate) as timestamp) as month, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as left, cast(cast(o_orderdate as date) + interval 1 month as date) as next from orders""",
    ),
    "nested": (
        nested,
        """with q as (select l_orderkey, list_sort(list(l_quantity)) as q, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1)
           select l_orderkey, cast(len(q) as bigint) as n, q[-1] as most, cast(len(list_filter(q, lambda x: x > 25)) as bigint) as large, array_to_string(flags, '') as flags,
           list_sum(q) as total, list_max(list_transform(q, lambda x: x % 7)) as rest, q[1] as least, list_contains(flags, 'R') as returned from q""",
    ),
    "numbers": (
        numbers,
        """select p_partkey, round(sqrt(p_retailprice), 6) as root, round(ln(p_retailprice), 6) as log, cast(floor(p_retailprice) as bigint) as down, cast(ceil(p_retailprice) as bigint) as up,
           pow(p_size, 2.0) as square, greatest(p_size, 10) as most, cast(sign(p_retailprice - 1000) as double) as sign, p_size = 1 as by_zero, p_partkey & 7 as bits from part""",
    ),
    "scaled_values": (scaled_values, "select event_id, least(value / 2, 50) as half from events"),
    "steps": (steps, "select p_partkey, cast(k as int) as step from part, range(3) as r(k) where k < p_size % 4"),
    "drawdowns": (
        drawdowns,
        """with m as (select user_id, cast(ts as date) as day, value, max(value) over (partition by user_id, cast(ts as date) order by ts, event_id rows unbounded preceding) as high from events)
           select user_id, day, round(max(high - value), 4) as fall from m group by 1, 2""",
    ),
    "batch_totals": (batch_totals, "select event_type, count(*) as n, round(sum(value), 3) as total from events group by 1"),
    **{name: (_sql(text), text) for name, text in BOTH.items()},
}
