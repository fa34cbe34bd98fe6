"""Statistics views, cost reports and keyword counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution_view(rows: DataFrame, key: Column, kind: str, kinds: list[str]) -> DataFrame:
    """Rows of each key and how many are of each kind; other kinds only count in the total."""
    return rows.withColumn("view_key", key).groupBy("view_key").agg(F.count("*").alias("lecture_count"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def bucket_view(rows: DataFrame, value: str, width: float, top: int) -> DataFrame:
    """Rows and mean minutes of each bucket of ``width`` seconds, the last one open; unknown and zero values are left out."""
    bucket = F.least(F.floor(F.col(value) / width), F.lit(top)).cast("long")
    return rows.filter(F.col(value) > 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("lecture_count"), F.round(F.avg(value) / 60, 1).alias("mean_minutes"))


def cost_report(events: DataFrame, stage: str, model: str, amounts: dict[str, Column]) -> DataFrame:
    """Sums by stage, by model and in total from one scan; ``level`` tells which."""
    sums = [F.sum(c).alias(name) for name, c in amounts.items()]
    out = events.groupingSets([(F.col(stage),), (F.col(model),), ()], F.col(stage), F.col(model)).agg(F.grouping_id().alias("g"), F.count("*").alias("events"), *sums)
    level = F.when(F.col("g") == 1, "stage").when(F.col("g") == 2, "model").otherwise("total")
    return out.withColumn("level", level).drop("g")


def histogram(rows: DataFrame, outer: str, inner: str, inners: list[str]) -> DataFrame:
    """A two-level histogram as a map column: counts of each inner value that is listed, by outer value."""
    counts = [F.count_if(F.col(inner) == k) for k in inners]
    return rows.groupBy(outer).agg(F.map_from_arrays(F.array(*[F.lit(k) for k in inners]), F.array(*counts)).alias("histogram"))


def keyword_counts(texts: DataFrame, key: str, text: str, least_chars: int = 4, least_count: int = 3, most_share: float = 0.5) -> DataFrame:
    """Words with how often and in how many rows they stand, short, rare and all too common ones left out."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    each = texts.select(key, F.explode(F.filter(words, lambda w: F.length(w) >= least_chars)).alias("keyword"))
    own = each.groupBy("keyword", key).agg(F.count("*").alias("n"))
    out = own.groupBy("keyword").agg(F.sum("n").alias("total_count"), F.count("*").alias("rows_with"))
    rows = texts.select(key).distinct().count()
    return out.filter((F.col("total_count") >= least_count) & (F.col("rows_with") <= most_share * rows))


def keyword_scores(counts: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent keywords and a score from 5 down to 1, four ranks a step. A top-k report."""
    top = counts.orderBy(F.col("total_count").desc(), "keyword").limit(most)
    rank = F.row_number().over(Window.orderBy(F.col("total_count").desc(), "keyword"))
    return top.withColumn("rank", rank).withColumn("score", F.greatest(F.lit(1), 5 - F.floor((F.col("rank") - 1) / 4)).cast("long"))


def min_max_position(rows: DataFrame, keys: list[str], value: str) -> Column:
    """A value's place between its key's lowest and highest, 0 where these are one."""
    by = Window.partitionBy(*keys)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def equal_shares(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """100 percent in whole equal shares within a key; the last row gets what is left."""
    by = Window.partitionBy(*keys)
    n, nr = F.count("*").over(by), F.row_number().over(by.orderBy(order))
    part = F.floor(F.lit(100) / n).cast("long")
    return rows.withColumn("percent", F.when(nr == n, 100 - part * (n - 1)).otherwise(part))


def audio_quality(rows: DataFrame, bands: dict[str, tuple[float, float, tuple[float, float]]]) -> DataFrame:
    """Banded scores of measured columns, their mean over those present, and a grade."""
    from evidentia.functions.numbers import banded_score, grade

    scores = {f"{name}_score": banded_score(F.col(name), *band) for name, band in bands.items()}
    rows = rows.withColumns(scores)
    told = F.array_compact(F.array(*[F.col(c) for c in scores]))
    mean = F.round(F.aggregate(told, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(told), F.lit(0)), 1)
    return rows.withColumn("overall", mean).withColumn("grade", grade(F.col("overall")))
