"""Decisions over sources, frames and answers: what counts, what is missing and what moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import domain

#: Sources up to this priority (government) need no repair.
GOVERNMENT = 2
#: Numbers of one block where rows are put in order block by block.
BLOCK = 4096


def source_status(sources: DataFrame, key: str, matched: str, eligible: str, priority: str, passages: str) -> DataFrame:
    """Each key's ``status``, ``direct_evidence`` passages and ``best_priority`` of its matched, eligible sources.

    A key without sources has no row: the caller's outer join tells ``no_sources``. Null flags don't hold.
    """
    direct = F.coalesce(F.col(matched), F.lit(False))
    return sources.groupBy(key).agg(
        F.when(F.max(direct), "verified").otherwise("no_direct_passage").alias("status"),
        F.sum(F.when(direct, F.coalesce(passages, F.lit(0))).otherwise(0)).cast("long").alias("direct_evidence"),
        F.min(F.when(direct & F.col(eligible), F.col(priority))).alias("best_priority"),
    )


def needs_repair(best: Column, directed: Column, weak_official: Column, status: Column) -> Column:
    """Whether better sources are to be sought: never with a best priority up to government, else for a directed status, an
    official source that failed or doesn't match, or no direct passage at all."""
    some = directed | weak_official | status.isin("no_sources", "no_direct_passage")
    return F.when(best <= GOVERNMENT, False).otherwise(F.coalesce(some, F.lit(False)))


def passages_of(sources: DataFrame, passages: DataFrame, url: str, *told: Column) -> DataFrame:
    """Each address with what is ``told`` (aggregates) of the passages reported for it or for its domain.

    Equal addresses have equal domains, so one equi-join on the domain finds both; addresses without a domain need
    equal ones. Passages are aggregated before the join, so a domain of very many pages costs one row.
    """
    key = lambda c: F.coalesce(F.nullif(domain(F.col(c)), F.lit("")), F.col(c))
    own = sources.select(F.col(url).alias("url"), key(url).alias("_d")).filter("url <> ''").distinct()
    return own.join(passages.filter(F.col(url) != "").groupBy(key(url).alias("_d")).agg(*told), "_d").drop("_d")


def clean_finals(rows: DataFrame, scene: str, kind: str, name: str, order: Sequence[str]) -> DataFrame:
    """Each frame with its scene's base (the first one, or the first frame of all) as ``clean_final`` and whether it is that.

    Null scenes are scene 0. The base is an aggregate, so a scene of very many frames is never in one task.
    """
    rows = rows.withColumn(scene, F.coalesce(scene, F.lit(0)))
    place = F.struct((F.coalesce(F.col(kind), F.lit("")) != "base").alias("late"), *order, name)
    first = rows.groupBy(scene).agg(F.min(place).alias("_first"))
    out = rows.join(first, scene).withColumns({"clean_final": F.col(f"_first.{name}"), "is_clean_final": place.eqNullSafe(F.col("_first"))})
    return out.drop("_first")


def natural_ends(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, start: str, end: str, pause: float) -> DataFrame:
    """``natural``: whether a row ends a sentence or is followed by a pause; a key's last row ends nothing."""
    by = Window.partitionBy(*keys).orderBy(*order)
    after = F.lead(start).over(by)
    ends = F.rtrim(F.coalesce(text, F.lit(""))).rlike(r"[.!?。！？]$") | F.coalesce(after - F.col(end) >= pause, F.lit(False))
    return rows.withColumn("natural", ends & F.lead(F.lit(1)).over(by).isNotNull())


def moved_to_next(frames: DataFrame, bases: DataFrame, scene: str, vector: str, least_gain: float) -> DataFrame:
    """Annotations (``scene``, ``vector``) with ``moved`` where the next scene's base is nearer than their own by ``least_gain``.

    ``bases`` has one row a scene; scenes need not be numbered without gaps. Distances are mean squares.
    """
    # Scenes are led on within blocks of numbers; only each block's first scene is ordered over all.
    own = bases.withColumns({"_block": F.floor(F.col(scene) / BLOCK), "_base": F.struct(F.col(scene).alias("scene"), F.col(vector).alias("vector"))})
    heads = own.groupBy("_block").agg(F.min("_base").alias("_head"))
    heads = heads.select("_block", F.lead("_head").over(Window.orderBy("_block")).alias("_first"))
    after = F.coalesce(F.lead("_base").over(Window.partitionBy("_block").orderBy(scene)), F.col("_first"))
    pairs = own.join(heads, "_block").withColumn("_after", after).select(scene, F.col(vector).alias("_own"), F.col("_after.vector").alias("_next"), F.col("_after.scene").alias("next_scene"))
    gap = lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size(vector)
    out = frames.join(pairs, scene, "left").withColumn("gain", F.round(gap("_own") - gap("_next"), 6))
    return out.withColumn("moved", F.coalesce(F.col("gain") >= least_gain, F.lit(False))).drop("_own", "_next")


def element_lines(elements: Column, fields: Sequence[str]) -> Column:
    """Structs as lines of their filled fields, joined by bars; elements without any give no line."""
    line = lambda e: F.array_join(F.filter(F.array(*[F.trim(F.coalesce(e[f].cast("string"), F.lit(""))) for f in fields]), lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform(elements, line), lambda x: x != ""), "\n")


def slides_of_files(files: DataFrame, name: str) -> DataFrame:
    """Slides told from file names alone: ``slide, base, builds`` by number and ``annotated``; slides without a base are left out."""
    pick = lambda pattern, k: F.regexp_extract(F.col(name), rf"(?i)^slide_(\d+)_{pattern}\.(?:jpg|png)", k)
    slide = F.coalesce(*[F.nullif(pick(p, 1), F.lit("")) for p in ("base", r"build_(\d+)", r"annot_(\d+)")]).cast("long")
    rows = files.select(slide.alias("slide"), name, (pick("base", 1) != "").alias("is_base"), F.nullif(pick(r"build_(\d+)", 2), F.lit("")).cast("long").alias("build"), (pick(r"annot_(\d+)", 1) != "").alias("annot"))
    build = F.when(F.col("build").isNotNull(), F.struct("build", name))
    out = rows.filter("slide is not null").groupBy("slide").agg(F.max(F.when(F.col("is_base"), F.col(name))).alias("base"), F.array_sort(F.collect_list(build)).alias("builds"), F.max("annot").alias("annotated"))
    return out.filter("base is not null").withColumn("builds", F.transform("builds", lambda b: b[name]))


def merged_rounds(rounds: Sequence[DataFrame], model: str) -> DataFrame:
    """Rounds ``model, status, errors, calls, tokens`` merged by model: failed in part if one was, numbers added up."""
    every = rounds[0]
    for other in rounds[1:]:
        every = every.unionByName(other)
    failed = F.coalesce(F.max(F.col("status") == "partial_failed"), F.lit(False))
    return every.groupBy(model).agg(F.when(failed, "partial_failed").otherwise("ok").alias("status"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("errors", "calls", "tokens")])


def keyword_sums(texts: DataFrame, counts: DataFrame, key: str, words: Column) -> DataFrame:
    """Of each text, the known keywords (``word, n``) in it, each once: how many and the sum of their counts; none are zeros."""
    own = texts.select(key, F.explode(F.array_distinct(words)).alias("word")).join(counts, "word")
    sums = own.groupBy(key).agg(F.count("*").alias("keywords"), F.sum("n").alias("total"))
    return texts.select(key).join(sums, key, "left").na.fill(0, ["keywords", "total"])
