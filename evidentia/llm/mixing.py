"""Mixing sources to target weights: budgets down a domain-language-source tree, token prefixes of seeded epochs.

DataFrame functions only. All amounts are integers, so every engine that follows the same rules gets the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.session import checkpointed

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target weights and amounts.

    Weights are integers that only matter within one parent; a child that isn't named gets ``other``. Domains are
    told by the number that a source's name ends in, ``per_domain`` numbers each; other names fall to "other".
    ``share`` percent of all tokens are asked for and a leaf gives at most ``epochs`` times its own tokens.
    """

    domains: tuple[str, ...] = ("web", "news", "books", "code")
    per_domain: int = 5
    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"web": 40, "news": 20, "books": 25, "code": 10})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    other: int = 5
    share: int = 60
    epochs: int = 3
    seed: str = "mix-1"

    def domain(self, source: Column) -> Column:
        number = F.regexp_extract(source, r"^[a-z]+([0-9]{1,6})$", 1)
        nth = F.floor(F.try_to_number(number, F.lit("999999")) / self.per_domain).cast("int")
        return F.coalesce(F.get(F.array(*[F.lit(d) for d in self.domains]), nth), F.lit("other"))

    def weight(self, weights: Mapping[str, int], name: Column) -> Column:
        out = F.lit(self.other)
        for key, value in weights.items():
            out = F.when(name == key, F.lit(value)).otherwise(out)
        return out.cast("long")


def leaves(docs: DataFrame, mix: Mix) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens`` of each row; tokens are words ``[^\\x20\\x09-\\x0D]+`` of the whole text."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        mix.domain(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        source.alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    )


def _shared(nodes: DataFrame, parent: list[str], own: str) -> DataFrame:
    """Each node's part ``budget`` of its parent's ``total``: by weight, no node over its ``cap``.

    Nodes are taken by rising cap per weight. While a node's cap is within its part of what is left, it is full
    and the rest goes to its siblings; from the first node on that can hold its part, all get it by weight,
    rounded down. A node of weight 0 gets nothing.
    """
    none = nodes.filter("weight = 0").withColumn("budget", F.lit(0).cast("long")).drop("total", "weight")
    nodes = nodes.filter("weight > 0")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(own).asc())
    nodes = nodes.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
            "weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    full = F.col("cap") * F.col("weights") <= F.col("weight") * (F.col("total") - F.col("before"))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumns({"taken": F.min(F.when(~F.col("full"), F.col("before"))).over(by), "open": F.max(F.when(~F.col("full"), F.col("weights"))).over(by)})
    part = F.expr("(weight * (total - taken)) div open")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("before", "weights", "full", "taken", "open", "total", "weight").unionByName(none)


def budgets(sizes: DataFrame, mix: Mix, total: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of each leaf of ``sizes`` (``domain, lang, source, tokens``).

    Domains share ``total``, languages what their domain got, sources what their language got, so a shortage is
    made up by siblings first and only what they can't give goes up to the parent's siblings.
    """
    caps = sizes.withColumn("cap", F.col("tokens") * mix.epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    tops = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    tops = _shared(tops.withColumns({"weight": mix.weight(mix.domain_weights, F.col("domain")), "total": F.lit(total).cast("long")}), [], "domain")
    langs = langs.join(tops.select("domain", F.col("budget").alias("total")), "domain").withColumn("weight", mix.weight(mix.lang_weights, F.col("lang")))
    langs = _shared(langs, ["domain"], "lang")
    caps = caps.join(langs.select("domain", "lang", F.col("budget").alias("total")), ["domain", "lang"]).withColumn("weight", mix.weight(mix.source_weights, F.col("source")))
    return _shared(caps, ["domain", "lang"], "source").select(*LEAF, "tokens", "budget")


def select(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, n_tokens``: one row for each use of a document in the mix.

    A leaf with budget b and t tokens gives b div t whole epochs, then the longest prefix of the next epoch that
    holds at most b mod t tokens. An epoch's order is the md5 of seed, epoch and id, ties by id and tokens, and
    equal rows go together. Prefix sums are taken over 65,536 ranges of the order in two steps, so a leaf with a
    third of all rows is spread like any other.

    Null sources and languages are leaves of their own ("unknown", "und"), null texts have no tokens, a leaf
    without tokens gives nothing, repeated rows count each, an empty table gives no rows.
    """
    mix = mix or Mix()
    rows = checkpointed(leaves(docs, mix))
    sizes = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shares = budgets(sizes, mix, tokens * mix.share // 100).filter("budget > 0")
    shares = shares.select(*LEAF, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"))
    shares = checkpointed(shares)
    rows = rows.join(shares, list(LEAF))
    rows = rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(mix.seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumns({"b1": F.substring("place", 1, 2), "b2": F.substring("place", 3, 2)})
    fine = rows.groupBy(*LEAF, "b1", "b2").agg(F.sum("n_tokens").alias("n"))
    coarse = fine.groupBy(*LEAF, "b1").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    coarse = coarse.select(*LEAF, "b1", F.coalesce(F.sum("n").over(Window.partitionBy(*LEAF).orderBy("b1").rowsBetween(*before)), F.lit(0)).alias("at1"))
    fine = fine.select(*LEAF, "b1", "b2", F.coalesce(F.sum("n").over(Window.partitionBy(*LEAF, "b1").orderBy("b2").rowsBetween(*before)), F.lit(0)).alias("at2"))
    at = fine.join(coarse, [*LEAF, "b1"]).select(*LEAF, "b1", "b2", (F.col("at1") + F.col("at2")).alias("at"))
    own = Window.partitionBy(*LEAF, "b1", "b2").orderBy("place", "doc_id", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(at, [*LEAF, "b1", "b2"]).withColumn("upto", F.col("at") + F.sum("n_tokens").over(own))
    uses = F.col("whole") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    rows = rows.withColumn("uses", uses).filter("uses > 0")
    return rows.select("doc_id", *LEAF, F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)).alias("epoch"), "n_tokens")
