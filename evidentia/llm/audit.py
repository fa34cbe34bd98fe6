"""Filter interaction audit: five-bit failure masks, a histogram of 32 cells for each part, all orders from the cells.

DataFrame functions only. Texts are read once; from then on only digests, masks and counts move.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.sources.session import stored

#: Bit k of a mask is set where filter ``FILTERS[k]`` fails.
FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: under 50 words; under 65 % distinct words; over 5 % `[A-Z]`; any of ``#$%&*|``."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    failed = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * upper > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of each document; copies are told by the SHA-256 of the whole text.

    The smallest id of each text is a grouped minimum, joined back only for texts that occur more than once. The
    join is an equi-join on the digest, so a text that a third of all rows share is split like any skewed key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("most > least").select("digest", "least")
    rows = rows.join(firsts, "digest", "left").join(marks, "doc_id", "left")
    later = F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    return rows.select("part", (F.col("mask") + later).alias("mask"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def cells(rows: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows for each part, combined before the shuffle."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _steps() -> Column:
    """All orders and steps: the filter's bit and the bits of the filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append(f"('{name}', {step}, {1 << k}, {before})")
            before |= 1 << k
    return F.expr(f"transform(array({', '.join(out)}), s -> named_struct('filter_order', s.col1, 'step', s.col2, 'bit', s.col3, 'before', s.col4))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of all 120 orders, for each part of ``docs``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; the filter
    of a step is that letter of the order. ``shapley`` sums what the filter removes over all orders: a document that
    fails f filters is removed by each of them in 120 / f orders.

    A null text is empty, a null source is the part "" (as an empty one is). A null id is no document's smaller id
    and has none; rows that repeat an id aren't copies of one another, and count each. An id with several label rows
    is good or toxic if one of them says so; null labels say nothing. Other columns don't matter; an empty table has
    no parts and gives no rows.
    """
    # Sums of at most 32 cells: groups of bounded size whatever the input.
    by_part = cells(masks(docs, labels)).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = by_part.select("part", "cells", F.explode(_steps()).alias("s")).select("part", "cells", "s.*")

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({condition}, c.{value}, 0L))")

    removed = "(c.mask & bit) != 0 and (c.mask & before) = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", "(c.mask & (bit | before)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(c.mask & bit) != 0 and (c.mask & before) != 0").alias("redundant"),
        total("n", "c.mask = bit").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.expr("aggregate(cells, 0L, (a, c) -> a + if((c.mask & bit) != 0, c.n * (120 div bit_count(c.mask)), 0L))").alias("shapley"),
    )
