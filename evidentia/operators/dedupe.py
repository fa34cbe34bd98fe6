"""Keep-best, latest, priority and merged-run operators. Ties always go to the earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nr", nr).filter("_nr = 1").drop("_nr")


def keep_best(rows: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The row of highest score of each key, the first by ``seq`` on ties; null scores come last."""
    return _first(rows, keys, [F.col(score).desc_nulls_last(), F.col(seq)])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _first(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def first_by_priority(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order: a list of candidates of which the first that exists wins."""
    return _first(rows, keys, order)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def latest_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], status: str, wanted: str | None = None) -> DataFrame:
    """Each parent with its latest child's status, ``unknown`` without one; ``wanted`` filters by that status."""
    own = latest(children, [key], order).select(key, status)
    out = parents.join(own, key, "left").withColumn(status, F.coalesce(status, F.lit("unknown")))
    return out if wanted is None else out.filter(F.col(status) == wanted)


def merged_runs(rows: DataFrame, keys: list[str], run: str, confidence: str, runs: int, least_rate: float = 0.5, least_pair: float = 0.9) -> DataFrame:
    """Findings that recur over runs: kept if seen in enough runs, or twice with a high mean confidence."""
    out = rows.groupBy(*keys).agg(F.count_distinct(run).alias("seen"), F.round(F.avg(confidence), 9).alias("mean_confidence"), F.max(confidence).alias("best_confidence"))
    out = out.withColumn("rate", F.round(F.col("seen") / runs, 6))
    return out.filter((F.col("rate") >= least_rate) | ((F.col("seen") >= 2) & (F.col("mean_confidence") >= least_pair)))


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the new keys put in place of the old ones: delete by key, then insert."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys that aren't there."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")
