"""Queries in SQL over the registered functions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from evidentia.functions import registered
from evidentia.sources.session import table


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    registered.register(spark)
    view = f"{name}_{uuid4().hex}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


def sql_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's runs of events no more than a day apart, by the table function."""
    view = _view(spark, sf_dir, "events")
    runs = f"islands(TABLE(SELECT user_id, unix_micros(cast(ts AS timestamp)) / 1000000D AS at FROM {view}), 'user_id', 'at', 86400D)"
    return spark.sql(f"SELECT user_id, island, count(*) AS n, round(min(at), 3) AS first_at, round(max(at), 3) AS last_at FROM {runs} GROUP BY user_id, island")


def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text in pieces of 1,000 characters that overlap by 100, by the table function."""
    view = _view(spark, sf_dir, "documents")
    return spark.sql(f"SELECT doc_id, chunk, start, sha2(text, 256) AS digest FROM chunks(TABLE(SELECT doc_id, text FROM {view}), 'doc_id', 'text', 1000, 100)")


def sql_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the verdict on their discount and tax, by scalar functions."""
    view = _view(spark, sf_dir, "lineitem")
    return spark.sql(f"SELECT verdict(clamp01(l_discount * 12 - l_tax * 4)) AS verdict, count(*) AS n, sum(hamming_distance(l_orderkey, l_partkey)) AS bits FROM {view} GROUP BY 1")


QUERIES = {"sql_islands": sql_islands, "sql_chunks": sql_chunks, "sql_verdicts": sql_verdicts}
ORACLES = {
    "sql_islands": """
with e as (select user_id, epoch(ts) "at" from events), l as (select *, case when "at" - lag("at") over (partition by user_id order by "at") > 86400 then 1 else 0 end new from e),
i as (select *, sum(new) over (partition by user_id order by "at" rows unbounded preceding)::bigint island from l)
select user_id, island, count(*) n, round(min("at"), 3) first_at, round(max("at"), 3) last_at from i group by all""",
    "sql_chunks": """
with d as (select doc_id, text t, unnest(range(0, greatest(length(text) - 100, least(1, length(text))), 900)) s from documents)
select doc_id, s // 900 chunk, s "start", sha256(substring(t, (s + 1)::int, 1000)) digest from d""",
    "sql_verdicts": """
with l as (select *, greatest(0, least(1, l_discount * 12 - l_tax * 4)) s from lineitem)
select case when s >= 0.8 then 'confirmed' when s <= 0.2 then 'rejected' else 'professor_check' end verdict, count(*) n, sum(bit_count(xor(l_orderkey, l_partkey)))::bigint bits from l group by 1""",
}
