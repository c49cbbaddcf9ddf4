"""Queries by name: (Spark query, the same in SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine
from millrace.operators import events, joins
from millrace.plans import more, spread
from millrace.sources.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-06-30").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
    )


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def big_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 250")
    return table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


def brand_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("place", F.row_number().over(best)).where("place <= 3").select("p_brand", "p_partkey", "place")


def running_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(own.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(own).alias("before"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one(c.union(s).distinct(), "union").union(one(c.intersect(s), "intersect")).union(one(c.exceptAll(s), "except all"))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("k"), "ts")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), (F.col("o_orderdate") + F.expr("interval 2500 days")).alias("at"), "o_orderkey")
    return joins.as_of(e, o, "k", "ts", "at", "o_orderkey").select("event_id", "o_orderkey")


def error_after_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("failed"))
    return joins.within(views, errors, "seen", "failed", 86_400, ["user_id"]).select("view_id", "error_id")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector to the first of its label."""
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("first")), 4).alias("cosine"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.md5("line").alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


QUERIES = {
    "pricing_summary": (
        pricing_summary,
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
           round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '2001-06-30' group by 1, 2""",
    ),
    "orders_by_customer": (
        orders_by_customer,
        """select c_mktsegment, count(o_orderkey) as n_orders, count(distinct c_custkey) as n_customers, round(sum(o_totalprice), 2) as total
           from customer left join orders on c_custkey = o_custkey group by 1""",
    ),
    "unlabelled": (unlabelled, "select doc_id, source from documents anti join labels using (doc_id)"),
    "big_orders": (big_orders, "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 250)"),
    "brand_cube": (brand_cube, "select p_brand, p_size, cast(grouping_id(p_brand, p_size) as bigint) as level, count(*) as n from part group by cube (p_brand, p_size)"),
    "status_rollup": (status_rollup, "select o_orderstatus, o_orderpriority, count(*) as n, round(avg(o_totalprice), 2) as mean from orders group by rollup (o_orderstatus, o_orderpriority)"),
    "top_parts": (top_parts, "select p_brand, p_partkey, cast(place as int) as place from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part) where place <= 3"),
    "running_value": (
        running_value,
        """select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running,
           lag(event_type) over (partition by user_id order by ts, event_id) as before from events""",
    ),
    "set_operations": (
        set_operations,
        """select 'union' as what, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier)
           union all select 'intersect', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier)
           union all select 'except all', count(*) from (select c_nationkey from customer except all select s_nationkey from supplier)""",
    ),
    "priorities": (
        priorities,
        """select o_custkey, nullif(count(*) filter (o_orderstatus = 'F'), 0) as F, nullif(count(*) filter (o_orderstatus = 'O'), 0) as O,
           nullif(count(*) filter (o_orderstatus = 'P'), 0) as P from orders group by 1""",
    ),
    "json_fields": (json_fields, "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1"),
    "latest_order": (
        latest_order,
        """select event_id, (select max(o_orderkey) from (select o_orderkey, rank() over (order by o_orderdate desc) as r from orders
           where o_custkey % 100 = user_id % 100 and o_orderdate + interval 2500 days <= ts) where r = 1) as o_orderkey from events""",
    ),
    "error_after_view": (
        error_after_view,
        """select v.event_id as view_id, e.event_id as error_id from events v join events e on v.user_id = e.user_id and e.ts between v.ts and v.ts + interval 1 day
           where v.event_type = 'view' and e.event_type = 'error'""",
    ),
    "user_sessions": (
        user_sessions,
        """with o as (select user_id, ts, case when ts <= lag(ts) over w + interval 30 minutes then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
           r as (select user_id, ts, sum(opens) over (partition by user_id order by ts) as run from o)
           select user_id, min(ts) as started, max(ts) as ended, count(*) as n from r group by user_id, run""",
    ),
    "hourly": (hourly, "select time_bucket(interval '1 hour', ts) as started, count(*) as n, round(sum(value), 4) as total from events group by 1"),
    "label_similarity": (
        label_similarity,
        """with f as (select label, arg_min(embedding, vec_id) as first from embeddings group by 1)
           select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(first as double[])), 4) as cosine from embeddings join f using (label)""",
    ),
    "repeated_lines": (repeated_lines, "select md5(line) as line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) where line <> '' group by 1 having n > 1"),
    **more.QUERIES,
    **spread.QUERIES,
}
