"""Votes, ensembles and severity over the judgments of several reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import clamp01, status_of


def consensus(scores: DataFrame, claim: str, model: str, confidence: str, raised: str, evaluated: Column, majority: float = 0.7, strong: float = 0.85) -> DataFrame:
    """One decision a claim from the scores of the models that judged it.

    A model counts if it raised the issue with ``majority`` or more. At least half of the ``evaluated`` models
    (rounded up) keep the claim; short of that one model of ``strong`` or more does. ``strongest`` is the model of
    highest confidence among those that count, the first by name on ties.
    """
    conf = clamp01(F.col(confidence))
    counts = F.col(raised) & (conf >= majority)
    order = F.struct((-conf).alias("c"), F.col(model).alias("m"))
    out = scores.groupBy(claim).agg(
        F.max(evaluated).alias("evaluated_count"),
        F.count_if(F.col(raised)).alias("issue_count"),
        F.count_if(counts).alias("qualified_count"),
        F.coalesce(F.max(F.when(counts, conf)), F.lit(0.0)).alias("best_confidence"),
        F.coalesce(F.min(F.when(counts, order)), F.min(F.when(F.col(raised), order)))["m"].alias("strongest"),
    )
    n, q = F.col("evaluated_count"), F.col("qualified_count")
    needed = F.floor((n + 1) / 2).cast("long")
    status = (
        F.when(n == 0, "all_models_failed")
        .when(F.col("issue_count") == 0, "no_issue")
        .when((q >= needed) & (q == n), "all_models_agreed")
        .when(q >= needed, "partial_agreement")
        .when(F.col("best_confidence") >= strong, "single_model_strong")
        .when(q == 1, "rejected_single_model_low_confidence")
        .otherwise("rejected_below_majority")
    )
    out = out.withColumns({"majority_required": needed, "status": status})
    return out.withColumn("keep", F.col("status").isin("all_models_agreed", "partial_agreement", "single_model_strong"))


def weighted_types(verdicts: DataFrame, issue: str, model: str, kind: str, p: str, models: int) -> DataFrame:
    """Score of each type of an issue: equal weights, rounded; a model without a verdict takes its weight along."""
    weight = F.round(F.lit(1.0) / models, 6)
    return verdicts.groupBy(issue, kind).agg(F.round(F.sum(weight * F.coalesce(F.col(p), F.lit(0.0))), 6).alias("score"), F.count_distinct(model).alias("models"))


def final_types(scores: DataFrame, tops: DataFrame, issue: str, kind: str, order: Column, models: int, low: float = 0.1, composite: str = "composite_issue") -> DataFrame:
    """The type of each issue from its ``scores``, and ``composite`` where the choice is close or all models differ.

    ``tops`` has each model's own top type. The choice is close if the best score leads by less than ``low``; all
    differ if two models or more answered, all of them did, and no two name the same type.
    """
    by = Window.partitionBy(issue).orderBy(F.col("score").desc(), order)
    best = scores.withColumns({"nr": F.row_number().over(by), "second": F.coalesce(F.lead("score").over(by), F.lit(0.0))}).filter("nr = 1")
    best = best.select(issue, F.col(kind).alias("top_type"), F.col("score").alias("top_score"), F.round(F.col("score") - F.col("second"), 6).alias("margin"))
    told = tops.groupBy(issue).agg(F.count("*").alias("answered"), F.count_distinct("top").alias("different"))
    out = best.join(told, issue, "left")
    close = F.col("margin") < low
    differ = (F.col("answered") >= 2) & (F.col("answered") == models) & (F.col("different") == F.col("answered"))
    reasons = F.array_compact(F.array(F.when(close, "low_margin"), F.when(differ, "model_disagreement")))
    out = out.withColumns({"low_margin": close, "reasons": F.array_join(reasons, ",")})
    return out.withColumn("final_type", F.when(close | differ, composite).otherwise(F.col("top_type")))


def severity(scores: DataFrame, issue: list[str], score: str, models: Column, flag: float = 0.35) -> DataFrame:
    """Weighted score, disagreement and status of each issue; missing models keep their weight and add nothing."""
    out = scores.groupBy(*issue).agg(
        F.round(F.sum(F.col(score) / models), 6).alias("final_score"),
        F.round(F.max(score) - F.min(score), 6).alias("disagreement"),
        F.count(score).alias("judged"),
    )
    return out.withColumns({"flagged": F.col("disagreement") >= flag, "status": status_of(F.col("final_score"))})


def composite(parts: DataFrame, issue: str, kind: str, weight: str, score: str) -> DataFrame:
    """Expected severity over the types that an issue may be, and the type that gives most of it.

    Weights are scaled to 1 within the issue; all-zero ones count the same.
    """
    by = Window.partitionBy(issue)
    total = F.sum(weight).over(by)
    share = F.when(total > 0, F.col(weight) / total).otherwise(1.0 / F.count("*").over(by))
    parts = parts.withColumn("share", share).withColumn("part", F.col("share") * F.col(score))
    order = F.struct(F.round("part", 9).alias("x"), F.col(score).alias("s"), F.round("share", 9).alias("w"))
    best = Window.partitionBy(issue).orderBy(order.desc(), F.col(kind))
    parts = parts.withColumn("nr", F.row_number().over(best))
    return parts.groupBy(issue).agg(F.round(F.sum("part"), 9).alias("expected"), F.max(F.when(F.col("nr") == 1, F.col(kind))).alias("primary_type"))


def trial_decision(trials: DataFrame, issue: str, relation: str, priority: str) -> DataFrame:
    """Evidence trials of an issue: only those of the best priority vote, and they must agree."""
    best = F.min(priority).over(Window.partitionBy(issue))
    voting = trials.withColumn("best_priority", best).filter(F.col(priority) == F.col("best_priority"))
    out = voting.groupBy(issue, "best_priority").agg(F.count_if(F.col(relation) == "supports").alias("supporting"), F.count_if(F.col(relation) == "refutes").alias("refuting"))
    s, r = F.col("supporting") > 0, F.col("refuting") > 0
    return out.withColumn("decision", F.when(s & ~r, "supports_issue").when(r & ~s, "refutes_issue").otherwise("insufficient_evidence"))


def missing_verdicts(issues: DataFrame, models: DataFrame, verdicts: DataFrame, issue: str, model: str) -> DataFrame:
    """The (issue, model) pairs without a verdict; ``models`` names the reviewers, all of them, in one row's array."""
    every = models.agg(F.collect_set(model).alias("_models")).withColumn("_key", F.lit(1))
    wanted = issues.select(issue, F.lit(1).alias("_key")).join(F.broadcast(every), "_key").select(issue, F.explode("_models").alias(model))
    return wanted.join(verdicts.select(issue, model), [issue, model], "left_anti")
