"""Statistics and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import numbers
from evidentia.operators import dedupe, stats
from evidentia.sources.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "factual_error").when(F.col("quality") == 0, "scope_overclaim").when(F.col("quality") == 1, "temporal_error")
    return docs.join(labels, "doc_id", "left").withColumn("kind", kind)


KINDS = ["factual_error", "temporal_error", "scope_overclaim"]
_D = "d as (select doc_id, source, lang, n_chars, case when toxic = 1 then 'factual_error' when quality = 0 then 'scope_overclaim' when quality = 1 then 'temporal_error' end kind from documents left join labels using (doc_id))"
_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in KINDS)


def stats_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type distribution by domain; languages outside the known ones are etc."""
    return stats.distribution_view(_docs(spark, sf_dir), F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("etc"), "kind", KINDS)


def stats_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length in buckets of 900, as lectures by quarter hours."""
    return stats.bucket_view(_docs(spark, sf_dir), "n_chars", 900, 8)


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map of types by language, as one row for each entry."""
    told = stats.histogram(_docs(spark, sf_dir), "lang", "kind", KINDS)
    return told.select("lang", F.explode("histogram").alias("kind", "n")).filter("n > 0")


def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of line items by return flag, by line status, and in all."""
    amounts = {"quantity": F.col("l_quantity"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}
    out = stats.cost_report(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", amounts)
    return out.select("level", "l_returnflag", "l_linestatus", "events", F.round("quantity", 2).alias("quantity"), F.round("net", 2).alias("net"))


COST = """
select case when l_returnflag is not null then 'stage' when l_linestatus is not null then 'model' else 'total' end level, l_returnflag, l_linestatus, count(*) events,
  round(sum(l_quantity), 2) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) net
from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())"""


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of orders at prices by priority; an unknown priority is free, cached tokens don't exceed the input."""
    orders = table(spark, sf_dir, "orders")
    spent, cached = F.col("o_totalprice"), F.least(F.col("o_custkey").cast("double") * 100, F.col("o_totalprice"))
    price = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", 10.0, "2-HIGH", 5.0, "3-MEDIUM", 2.5)]), F.col("o_orderpriority"))
    cost = numbers.token_cost(spent - cached, cached, F.lit(1000.0), price, price / 10, price * 4)
    return orders.select("o_orderkey", "o_orderpriority", F.round(cost, 9).alias("cost"))


TOKEN_COSTS = """
with p as (select *, case o_orderpriority when '1-URGENT' then 10.0::double when '2-HIGH' then 5.0 when '3-MEDIUM' then 2.5 end price, least(o_custkey::double * 100, o_totalprice) cached from orders)
select o_orderkey, o_orderpriority, round(coalesce(((o_totalprice - cached) * price + cached * (price / 10) + 1000.0::double * (price * 4)) / 1e6, 0), 9) cost from p"""


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the status of the latest order, unknown without one."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return dedupe.latest_children(customers, orders, "c_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


LATEST = """
with l as (select o_custkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey, c_name, coalesce(o_orderstatus, 'unknown') o_orderstatus from customer left join l on o_custkey = c_custkey"""


def latest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose latest order is open."""
    return latest_orders(spark, sf_dir).filter("o_orderstatus = 'O'")


def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of six customers whose name holds a 1, by balance. A top-k report."""
    rows = table(spark, sf_dir, "customer").filter(F.lower("c_name").contains("1")).select("c_custkey", "c_name", "c_acctbal")
    return rows.orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").offset(12).limit(6)


PAGE = "select c_custkey, c_name, c_acctbal from customer where contains(lower(c_name), '1') order by c_acctbal desc nulls last, c_custkey limit 6 offset 12"


def result_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier of each nation by tier of balance, then newest key: a priority list of which the first wins."""
    rows = table(spark, sf_dir, "supplier").withColumn("tier", F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2))
    return dedupe.first_by_priority(rows, ["s_nationkey"], [F.col("tier"), F.col("s_suppkey").desc()]).select("s_nationkey", "s_suppkey", "tier")


CANDIDATES = """
select s_nationkey, s_suppkey, case when s_acctbal > 5000 then 0 when s_acctbal > 0 then 1 else 2 end tier from supplier
qualify row_number() over (partition by s_nationkey order by case when s_acctbal > 5000 then 0 when s_acctbal > 0 then 1 else 2 end, s_suppkey desc) = 1"""


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand."""
    return dedupe.top_k(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)


TOP_PARTS = "select p_brand, p_partkey, p_retailprice, row_number() over w rank from part window w as (partition by p_brand order by p_retailprice desc, p_partkey) qualify row_number() over w <= 3"


def keyword_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent keywords of the conversations with their scores."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return stats.keyword_scores(stats.keyword_counts(rows, "key", "text"))


KEYWORDS = """
with w as (select conv_id || '-' || turn key, unnest(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) >= 4)) keyword from conversations),
k as (select keyword, count(*) total_count, count(distinct key) rows_with from w group by keyword),
r as (select *, row_number() over (order by total_count desc, keyword) rank from k where total_count >= 3 and rows_with <= 0.5 * (select count(*) from (select distinct conv_id, turn from conversations)))
select keyword, total_count, rows_with, rank, greatest(1, 5 - (rank - 1) // 4) score from r where rank <= 20"""


def time_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order lies between its customer's cheapest and dearest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.select("o_orderkey", F.round(stats.min_max_position(orders, ["o_custkey"], "o_totalprice"), 6).alias("position"))


POSITIONS = """select o_orderkey, round(case when max(o_totalprice) over w > min(o_totalprice) over w then (o_totalprice - min(o_totalprice) over w) / (max(o_totalprice) over w - min(o_totalprice) over w) else 0 end, 6) "position"
from orders window w as (partition by o_custkey)"""


def equal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole percent shares of a region's nations."""
    return stats.equal_shares(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey")


SHARES = """select n_regionkey, n_nationkey, case when row_number() over (partition by n_regionkey order by n_nationkey) = count(*) over (partition by n_regionkey)
  then 100 - (100 // count(*) over (partition by n_regionkey)) * (count(*) over (partition by n_regionkey) - 1) else 100 // count(*) over (partition by n_regionkey) end percent from nation"""

BANDS = {"p_size": (5, 45, (15.0, 30.0)), "p_retailprice": (950, 1800, (1000.0, 1500.0))}


def audio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded scores of parts by size and price, as recordings by their measures."""
    return stats.audio_quality(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), BANDS).drop("p_size", "p_retailprice")


AUDIO = """
with s as (select p_partkey, case when p_size between 15 and 30 then 100 when p_size between 5 and 45 then 70 else 40 end p_size_score,
  case when p_retailprice between 1000 and 1500 then 100 when p_retailprice between 950 and 1800 then 70 else 40 end p_retailprice_score from part),
o as (select *, round((p_size_score + p_retailprice_score) / 2, 1) overall from s)
select *, case when overall >= 85 then 'A' when overall >= 70 then 'B' when overall >= 60 then 'C' else 'D' end grade from o"""


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer merge by customer of order and balance facts: first, last and total, the dearest order's key."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("best"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.round("c_acctbal", 2).alias("balance")).filter("balance >= 0")
    return orders.join(customers, "key", "full").select("key", "first_at", "last_at", "total", (-F.col("best.k")).alias("best_key"), "balance")


MERGED = """
with o as (select o_custkey key, min(o_orderdate) first_at, max(o_orderdate) last_at, round(sum(o_totalprice), 2) total, first(o_orderkey order by o_totalprice desc, o_orderkey) best_key from orders group by 1)
select key, first_at, last_at, total, best_key, balance from o full join (select c_custkey key, round(c_acctbal, 2) balance from customer where round(c_acctbal, 2) >= 0) using (key)"""


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with those of two regions deleted by key and put in again, renamed."""
    nations = table(spark, sf_dir, "nation")
    new = nations.filter("n_regionkey < 2").withColumn("n_name", F.lower("n_name"))
    return dedupe.replaced(nations, new, "n_nationkey")


REPLACED = "select n_nationkey, case when n_regionkey < 2 then lower(n_name) else n_name end n_name, n_regionkey from nation"


def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any order."""
    return dedupe.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


def keep_last_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value over 30 of each user's event types in order of time: stage timings that outlive a zero run."""
    events = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.select("user_id", "event_type", F.last(F.when(F.col("value") > 30, F.col("value")), ignorenulls=True).over(by).alias("seconds")).distinct()


TIMINGS = """select user_id, event_type, last(value order by ts, event_id) filter (value > 30) as seconds from events group by all"""

QUERIES = {
    "stats_by_domain": stats_by_domain,
    "stats_by_duration": stats_by_duration,
    "type_histogram": type_histogram,
    "cost_report": cost_report,
    "token_costs": token_costs,
    "latest_orders": latest_orders,
    "latest_open": latest_open,
    "order_page": order_page,
    "result_candidates": result_candidates,
    "top_parts": top_parts,
    "keyword_report": keyword_report,
    "time_positions": time_positions,
    "equal_shares": equal_shares,
    "audio_quality": audio_quality,
    "merged_documents": merged_documents,
    "replaced_rows": replaced_rows,
    "missing_artifacts": missing_artifacts,
    "keep_last_timings": keep_last_timings,
}
ORACLES = {
    "stats_by_domain": f"with {_D} select case when lang in ('en', 'de') then lang else 'etc' end view_key, count(*) lecture_count, {_COUNTS} from d group by 1",
    "stats_by_duration": f"with {_D} select least(n_chars // 900, 8) bucket, count(*) lecture_count, round(avg(n_chars) / 60, 1) mean_minutes from d where n_chars > 0 group by 1",
    "type_histogram": f"with {_D} select lang, kind, count(*) n from d where kind is not null group by all",
    "cost_report": COST,
    "token_costs": TOKEN_COSTS,
    "latest_orders": LATEST,
    "latest_open": f"select * from ({LATEST}) where o_orderstatus = 'O'",
    "order_page": PAGE,
    "result_candidates": CANDIDATES,
    "top_parts": TOP_PARTS,
    "keyword_report": KEYWORDS,
    "time_positions": POSITIONS,
    "equal_shares": SHARES,
    "audio_quality": AUDIO,
    "merged_documents": MERGED,
    "replaced_rows": REPLACED,
    "missing_artifacts": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "keep_last_timings": TIMINGS,
}
