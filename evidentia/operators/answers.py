"""Assessments that reviewers give of evidence, what of it is kept, and summaries of views."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import clamp01
from evidentia.functions.text import without_fence

#: Relations of a source to a claim, and names of fields that hold addresses and queries.
RELATIONS = ("supports_claim", "contradicts_claim", "irrelevant")
URL_NAMES = ("url", "source_url", "sourceurl")
QUERY_NAMES = ("query", "search_query", "searchquery")
SEARCHES = ("search_call", "websearch_call")
#: Parts that a key's rows are dealt out to before their tops are put together.
PARTS = 32


def assessed(excerpts: DataFrame, answers: DataFrame, keys: Sequence[str], source: str, payload: str) -> DataFrame:
    """``excerpts`` with ``relation, confidence, reason, answered`` from each key's JSON answer.

    Of a source's several rows in an answer the first counts; unknown relations are irrelevant, so are sources that
    the answer leaves out and all of an answer that can't be read (confidence 0). Rows of sources that aren't among
    the excerpts go. Repeated excerpts are judged alike; null keys are never answered.
    """
    kind = "assessments array<struct<source_id string, relation string, confidence string, reason string>>"
    rows = answers.select(*keys, F.posexplode(F.from_json(without_fence(F.col(payload)), kind)["assessments"]).alias("_at", "_row"))
    rows = rows.withColumn(source, F.trim("_row.source_id")).filter(F.col(source) != "")
    first = rows.groupBy(*keys, source).agg(F.min_by("_row", "_at").alias("_row"))
    said = F.lower(F.trim("_row.relation"))
    out = excerpts.join(first, [*keys, source], "left").withColumns(
        {
            "relation": F.when(said.isin(*RELATIONS), said).otherwise("irrelevant"),
            "confidence": F.round(clamp01(F.col("_row.confidence")), 4),
            "reason": F.coalesce("_row.reason", F.lit("")),
            "answered": F.col("_row").isNotNull(),
        }
    )
    return out.drop("_row")


def kept_evidence(rows: DataFrame, key: str, source: str, strong: str, priority: str, url: str, least: float, most: int) -> DataFrame:
    """Each key's ``status``, ``mixed`` relations and the ``most`` best rows as ``evidence`` (``place, source, relation, confidence``).

    Irrelevant rows and those below ``least`` are no evidence. Strong sources come first, then small priorities (none
    and 0 last), sure relations, addresses and sources. The top ``most`` are the feature; ``mixed`` is told of all
    rows. Rows are told once: a key's are dealt out by source, each part keeps its own top, and the parts' tops are put
    together. So a key of very many rows is cut in many tasks, and no row is joined with another.
    """
    counts = F.coalesce((F.col("relation") != "irrelevant") & (F.col("confidence") >= least), F.lit(False))
    order = [F.when(F.col(strong), 0).otherwise(1).alias("o1"), F.coalesce(F.nullif(F.col(priority), F.lit(0)), F.lit(99)).alias("o2"), (-F.col("confidence")).alias("o3"), F.coalesce(url, F.lit("")).alias("o4"), F.col(source).alias("source"), "relation", "confidence"]
    own = rows.select(key, F.pmod(F.xxhash64(source), F.lit(PARTS)).alias("_part"), counts.alias("_counts"), F.struct(*order).alias("_row"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.col("_counts").desc(), "_row"))
    has = lambda r: F.max(F.col("_counts") & (F.col("_row.relation") == r)).alias(r)
    kept = F.collect_list(F.when(F.col("_counts") & (F.col("_place") <= most), F.col("_row")))
    parts = own.withColumn("_place", place).groupBy(key, "_part").agg(kept.alias("_top"), *[has(r) for r in RELATIONS[:2]])
    told = parts.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_top"))), 1, most).alias("_top"), *[F.max(r).alias(r) for r in RELATIONS[:2]])
    placed = F.transform("_top", lambda x, i: F.struct((i + 1).alias("place"), x["source"].alias("source"), x["relation"].alias("relation"), x["confidence"].alias("confidence")))
    none = F.size("_top") == 0
    mixed = F.coalesce(F.col(RELATIONS[0]) & F.col(RELATIONS[1]), F.lit(False))
    return told.select(key, mixed.alias("mixed"), F.when(~none, placed).alias("evidence"), F.when(none, "insufficient_evidence").otherwise("verified").alias("status"))


def _traced(payload: str | None) -> tuple[int, list[str], list[str]]:
    try:
        todo = [("", json.loads(payload or "null"))]
    except (ValueError, RecursionError):
        todo = []
    calls, queries, urls = 0, {}, {}
    while todo:
        name, value = todo.pop()
        said = "" if value is None or isinstance(value, (dict, list)) else str(value).strip()
        if name in URL_NAMES and said.startswith(("http://", "https://")):
            urls[said] = None
        elif name in QUERY_NAMES and said:
            queries[said] = None
        if isinstance(value, dict):
            kind = str(value.get("type") or "").lower()
            calls += "web_search" in kind or kind in SEARCHES
            todo += [(k.lower(), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [("", v) for v in reversed(value)]
    return calls, list(queries), list(urls)


def _traces(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_traced(x) for x in payload], columns=["calls", "queries", "urls"])


def search_traces(payload: Column) -> Column:
    """``calls, queries, urls`` of searches anywhere in a JSON answer, in the order of the text and each once.

    A JSON of unknown depth can't be walked by built-in functions. What isn't JSON, or is nested beyond what the JSON
    reader takes, has none.
    """
    return F.pandas_udf(_traces, "calls long, queries array<string>, urls array<string>")(payload)


def breakdown(items: DataFrame, others: DataFrame, keys: Sequence[str], bucket: str, kind: str, known: Sequence[str], other_kind: str) -> DataFrame:
    """``keys, bucket, kind, n``: items of known kinds counted, with the counts ``n`` of ``others`` added to ``other_kind``."""
    own = items.filter(F.col(kind).isin(*known) & F.col(bucket).isNotNull()).groupBy(*keys, bucket, kind).agg(F.count("*").alias("n"))
    more = others.filter(F.col("n") > 0).select(*keys, bucket, F.lit(other_kind).alias(kind), "n")
    return own.unionByName(more).groupBy(*keys, bucket, kind).agg(F.sum("n").alias("n"))


def comparison(view: DataFrame, label: str, rows: str, counts: Sequence[str]) -> DataFrame:
    """One row over a view's rows: ``totals`` (a map of the ``counts`` columns), ``most_label`` by the mean of all counts, and it.

    Rows without ``rows`` have no mean; of equal means the smallest label counts. An empty view has null means.
    """
    mean = F.when(F.col(rows) > 0, sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0)) / F.col(rows))
    best = F.min(F.when(mean.isNotNull(), F.struct((-mean).alias("down"), F.col(label).alias("label"))))
    totals = F.map_from_arrays(F.array(*[F.lit(c) for c in counts]), F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in counts]))
    return view.agg(totals.alias("totals"), best["label"].alias("most_label"), F.round(-best["down"], 6).alias("most_mean"))


def trend(view: DataFrame, first: str, second: str, length: str) -> DataFrame:
    """One row over a view's rows: seconds a minute of ``length``, and the gap from the least to the most of either phase."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    own = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rate = F.when(whole(length) > 0, (whole(first) + whole(second)) / whole(length) * 60).otherwise(F.lit(0.0))
    gap = lambda c: F.round(F.max(own(c)) - F.min(own(c)), 6)
    return view.agg(F.round(rate, 6).alias("seconds_a_minute"), gap(first).alias("first_gap"), gap(second).alias("second_gap"))


def difference(a: Column, b: Column, changed: float) -> Column:
    """``square, share, bits`` of two vectors: mean square, share of places that differ by ``changed``, signs that differ."""
    n = F.size(a)
    both = F.zip_with(a, b, lambda x, y: F.struct((x.cast("double") - y).alias("d"), ((x > 0) != (y > 0)).alias("s")))
    square = F.aggregate(both, F.lit(0.0), lambda s, x: s + x["d"] * x["d"]) / n
    share = F.size(F.filter(both, lambda x: F.abs(x["d"]) >= changed)) / n
    return F.when(a.isNotNull() & b.isNotNull() & (n > 0), F.struct(square.alias("square"), share.alias("share"), F.size(F.filter(both, lambda x: x["s"])).alias("bits")))
