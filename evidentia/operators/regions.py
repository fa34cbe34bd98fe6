"""Boxes and regions: epochs of boxes, areas of unions, kinds of windows, changes of presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.nested import once
from evidentia.operators.results import first_match

#: The thresholds of a window's kind.
VIDEO_MOTION, VIDEO_STRONG, VIDEO_CHANGED = 0.42, 0.18, 0.006
SLIDE_MOTION, SLIDE_CHANGED, UNKNOWN_MARGIN, ACTIVE = 0.18, 0.003, 0.08, 0.25


def box_epochs(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], box: Sequence[str], most_gap: float, most_jump: float, quantile: float, pad: int, width: int, height: int) -> DataFrame:
    """One fixed box for each run of boxes: a new run begins after ``most_gap`` or where the centre jumps ``most_jump``.

    Its corners are quantiles (linear; rounded to six digits, then outwards to whole numbers), widened by ``pad`` within
    the frame; empty ones go. ``box`` names x1, y1, x2, y2; rows with a null corner are left out.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    x1, y1, x2, y2 = box
    rows = rows.dropna(subset=[*box]).withColumns({"_x": (F.col(x1) + F.col(x2)) / 2, "_y": (F.col(y1) + F.col(y2)) / 2})
    jump = F.greatest(F.abs(F.col("_x") - F.lag("_x").over(by)), F.abs(F.col("_y") - F.lag("_y").over(by)))
    new = F.when((F.col(at) - F.lag(at).over(by) <= most_gap) & (jump <= most_jump), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("epoch", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    corner = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    low, high = 1 - quantile, quantile
    out = runs.groupBy(*keys, "epoch").agg(
        F.min(at).alias("start_at"),
        F.max(at).alias("end_at"),
        *[F.greatest(F.lit(0), F.floor(corner(c, low)).cast("long") - pad).alias(n) for c, n in ((x1, "left"), (y1, "top"))],
        *[F.least(F.lit(most), F.ceil(corner(c, high)).cast("long") + pad).alias(n) for c, n, most in ((x2, "right", width), (y2, "bottom", height))],
    )
    return out.filter("right > left and bottom > top")


def union_area(boxes: Column) -> Column:
    """The area that an array of boxes ``struct<x1,y1,x2,y2>`` covers: strips between neighbouring edges, merged downwards.

    Edges and the boxes by their upper side are sorted once an array, not once a strip.
    """
    plain = lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("y1", "y2", "x1", "x2")])

    def covered(own: Column, left: Column, right: Column) -> Column:
        start = F.struct(F.lit(float("-inf")).alias("reach"), F.lit(0.0).alias("sum"))
        step = lambda s, b: F.struct(F.greatest(s["reach"], b["y2"]).alias("reach"), (s["sum"] + F.greatest(F.lit(0.0), b["y2"] - F.greatest(b["y1"], s["reach"]))).alias("sum"))
        return F.aggregate(F.filter(own, lambda b: (b["x1"] <= left) & (b["x2"] >= right)), start, step)["sum"]

    def strips(own: Column, xs: Column) -> Column:
        ends = F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.aggregate(ends, F.lit(0.0), lambda s, e: s + (e["y"] - e["x"]) * covered(own, e["x"], e["y"]))

    edges = lambda own: F.sort_array(F.array_distinct(F.concat(F.transform(own, lambda b: b["x1"]), F.transform(own, lambda b: b["x2"]))))
    return once(F.sort_array(F.transform(boxes, plain)), lambda own: once(edges(own), lambda xs: strips(own, xs)))


def window_kind(motion: Column, strong: Column, changed: Column, active: Column) -> tuple[Column, Column]:
    """A window's kind (video, slide or unknown) by its shares of motion, and the confidence (six digits)."""
    lasting = (motion >= VIDEO_MOTION) | (strong >= VIDEO_STRONG) | (changed >= VIDEO_CHANGED)
    still = (motion <= SLIDE_MOTION) & (changed <= SLIDE_CHANGED)
    some = (motion >= SLIDE_MOTION + UNKNOWN_MARGIN) | (active >= ACTIVE)
    over = F.greatest(motion - VIDEO_MOTION, strong - VIDEO_STRONG, (changed - VIDEO_CHANGED) / VIDEO_CHANGED)
    under = F.least(SLIDE_MOTION - motion, (SLIDE_CHANGED - changed) / SLIDE_CHANGED)
    within = lambda x, least: F.round(F.round(F.least(F.lit(0.98), F.greatest(F.lit(least), x)), 9), 6)
    kind = F.when(lasting, "video").when(still, "slide").when(some, "video").otherwise("unknown")
    sure = F.when(lasting, within(0.72 + over * 0.35, 0.62)).when(still, within(0.74 + under * 0.45, 0.58)).when(some, 0.6).otherwise(0.45)
    return kind, sure


def presence_change(before: Column, after: Column, raw_changed: Column, masked_same: Column) -> Column:
    """``person_reveal`` or ``person_cover`` where a presence falls or rises by 0.05 to or from little, the raw frames differ and the masked ones don't."""
    step = F.round(after - before, 9)
    little = lambda x, y: (y >= 0.03) & (x <= F.greatest(F.lit(0.01), y * 0.35))
    told = raw_changed & masked_same
    return first_match([("person_reveal", told & (step <= -0.05) & little(after, before)), ("person_cover", told & (step >= 0.05) & little(before, after))])
