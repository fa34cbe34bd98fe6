"""Streaming queries, each drained over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.streaming import feeds


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of every user."""
    return feeds.drained(feeds.latest_status(feeds.event_stream(spark, sf_dir)), "complete")


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has passed."""
    return feeds.drained(feeds.hourly(feeds.event_stream(spark, sf_dir)), "append")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user."""
    return feeds.drained(feeds.sessions(feeds.event_stream(spark, sf_dir)), "complete")


def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished episodes of the writing state machine."""
    return feeds.drained(feeds.episodes(feeds.event_stream(spark, sf_dir)), "append")


QUERIES = {"stream_status": stream_status, "stream_hours": stream_hours, "stream_sessions": stream_sessions, "stream_episodes": stream_episodes}
ORACLES = {
    "stream_status": "select user_id, last(event_type order by ts, event_id) as status, max(ts) as at, count(*) events from events group by 1",
    "stream_hours": """select date_trunc('hour', ts) "hour", event_type, count(*) n, round(avg(value), 6) mean_value from events
where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 2 hour from events) group by all""",
    "stream_sessions": """
with f as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) s from f)
select user_id, min(ts) start_at, count(*) n, round(sum(value), 4) total from i group by user_id, s""",
}
