"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.plans import answers, boundary, captures, decisions, evidence, frames, registered, results, sequences, streams, texts, timelines, verdicts, views
from evidentia.sources.session import table


def stats_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source with the distribution of their verdict types; unlabelled types count as null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("etc")).alias("tag"), "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (
        docs.join(labels, "doc_id", "left")
        .groupBy("tag")
        .agg(
            F.count("*").alias("lecture_count"),
            F.count_if(F.col("quality") == 1).alias("confirmed"),
            F.count_if(F.col("quality") == 0).alias("rejected"),
            F.count_if(F.col("toxic") == 1).alias("flagged"),
            F.round(F.avg("n_chars"), 2).alias("mean_chars"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stats_by_tag": stats_by_tag}
ORACLES: dict[str, str] = {
    "stats_by_tag": """
select coalesce(source, 'etc') tag, count(*) lecture_count, count(*) filter (quality = 1) confirmed, count(*) filter (quality = 0) rejected,
  count(*) filter (toxic = 1) flagged, round(avg(n_chars), 2) mean_chars
from documents left join labels using (doc_id) group by 1""",
}
for _module in (views, verdicts, timelines, texts, results, sequences, decisions, answers, streams, boundary, frames, evidence, captures, registered):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
