"""Interval, nearest and neighbourhood joins, within keys or over whole tables; none compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_in_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, ident: str) -> DataFrame:
    """``ident`` of the last range that starts at or before each point, of the first range for earlier points.

    For ranges that follow one another this is the range that holds the point, and the last one beyond all. One
    union and one window a key: rows are sorted, not paired.
    """
    r = ranges.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(ident).alias("_id"))
    p = points.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_id": F.lit(None).cast(ranges.schema[ident].dataType)})
    both = p.unionByName(r, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_at", "_kind")
    held = F.last("_id", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_id", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn(ident, F.coalesce(held, first)).filter("_kind = 1").drop("_at", "_kind", "_id")


def bins(lo: Column, hi: Column, width: float) -> Column:
    """The time bins that a range touches."""
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def overlap_assign(segments: DataFrame, spans: DataFrame, keys: list[str], ident: str, span: str, width: float, lead: float = 1.0, tail: float = 0.2, reach: float = 3.0) -> DataFrame:
    """The span that each segment belongs to; both have ``start_sec, end_sec``.

    The span of largest overlap (the later one on ties), unless a span that starts within the segment takes over:
    the earliest such one does if the segment starts within ``lead`` of it, lasts ``tail`` into it, or overlaps it by
    three quarters of the largest overlap. Without overlap the span nearest to the segment's point at 65 % is taken
    if it is within ``reach``. Pairs meet in time bins of ``width``, so a key's segments only see spans nearby.
    """
    seg = segments.select(*keys, ident, F.col("start_sec").alias("s"), F.greatest("start_sec", "end_sec").alias("e"))
    occ = spans.select(*keys, span, F.col("start_sec").alias("os"), F.col("end_sec").alias("oe"))
    one = seg.withColumn("bin", F.explode(bins(F.col("s") - reach, F.col("e") + reach, width)))
    two = occ.withColumn("bin", F.explode(bins(F.col("os"), F.col("oe"), width)))
    near = one.join(two, [*keys, "bin"]).drop("bin").dropDuplicates([*keys, ident, span])
    near = near.withColumn("overlap", F.least("e", "oe") - F.greatest("s", "os"))
    anchor = F.col("s") + (F.col("e") - F.col("s")) * 0.65
    distance = F.when(anchor.between(F.col("os"), F.col("oe")), 0.0).otherwise(F.least(F.abs(anchor - F.col("os")), F.abs(anchor - F.col("oe"))))
    later = (F.col("overlap") > 0) & (F.col("os") > F.col("s")) & (F.col("os") <= F.col("e"))
    told = near.groupBy(*keys, ident).agg(
        F.max(F.when(F.col("overlap") > 0, F.struct("overlap", F.col("os").alias("o"), F.col(span).alias("id")))).alias("best"),
        F.min(F.when(later, F.struct(F.col("os").alias("o"), "overlap", F.col(span).alias("id")))).alias("later"),
        F.min(F.when(F.col("overlap") <= 0, F.struct(distance.alias("d"), F.col("os").alias("o"), F.col(span).alias("id")))).alias("nearest"),
        F.first("s").alias("s"),
        F.first("e").alias("e"),
    )
    b, a, n = F.col("best"), F.col("later"), F.col("nearest")
    takes = a.isNotNull() & ((F.col("s") >= a["o"] - lead) | (a["overlap"] >= b["overlap"] * 0.75) | (F.col("e") - a["o"] >= tail))
    pick = F.when(takes, a["id"]).when(b.isNotNull(), b["id"]).when(n["d"] <= reach, n["id"])
    return segments.select(*keys, ident).join(told.select(*keys, ident, pick.alias(span)), [*keys, ident], "left")


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: str) -> DataFrame:
    """``value`` of the mark nearest to each point; the later mark on ties; null if the key has none."""
    kinds = marks.schema[value].dataType
    m = marks.select(*keys, F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(mark_at).alias("t"), F.col(value).alias("v")).alias("_m"))
    p = points.withColumns({"_at": F.col(at), "_kind": F.lit(1)})
    both = p.unionByName(m, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_at", "_kind")
    back = F.last("_m", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", F.col("_kind").desc()).rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"_b": back, "_a": ahead}).filter("_kind = 1")
    right = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a.t") - F.col("_at") <= F.col("_at") - F.col("_b.t")))
    return both.withColumn(value, F.when(right, F.col("_a.v")).otherwise(F.col("_b.v")).cast(kinds)).drop("_at", "_kind", "_m", "_b", "_a")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], text: str, reach: int) -> DataFrame:
    """The texts of the rows up to ``reach`` before and after each row, joined by line breaks."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(by), "\n"))


def halo_batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Batches of ``size`` rows, each with the row before and after it; ``core`` tells the batch's own rows."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = rows.withColumn("_nr", nr)
    own = F.floor(F.col("_nr") / size).cast("long")
    touched = F.array_distinct(F.array(F.floor((F.col("_nr") + 1) / size).cast("long"), own, F.floor((F.col("_nr") - 1) / size).cast("long")))
    last = F.floor(F.max("_nr").over(Window.partitionBy(*keys)) / size).cast("long")
    rows = rows.withColumns({"_own": own, "_last": last}).withColumn("batch", F.explode(touched))
    return rows.filter("batch between 0 and _last").withColumn("core", F.col("batch") == F.col("_own")).drop("_nr", "_own", "_last")


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Number, from 0, of each row's chunk of ``size`` rows within its keys."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def estimated(rows: DataFrame, known: DataFrame, key: str, value: str, step: int) -> DataFrame:
    """A known value by key, else an estimate: the key over ``step``, rounded, 1 at least."""
    return rows.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.greatest(F.lit(1), F.round(F.col(key) / step).cast("int"))))


def _levelled(side: DataFrame, lo: str, hi: str, width: float, others: DataFrame | None) -> DataFrame:
    """Intervals with their ``_own`` level and a row for each ``_level`` and ``_bin`` that they are looked up in.

    Bins of level k are ``width * 2 ** k`` wide; an interval's own level is the first whose bins are no narrower, so at
    it and all above it lies in two bins at most. ``others`` are the levels that the other side has.
    """
    length = F.col(hi) - F.col(lo)
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(width)) / width))).cast("int")
    side = side.filter((F.col(lo) <= F.col(hi)) & (length < float("inf"))).withColumn("_own", own)
    # The logarithm may round down to the level below.
    side = side.withColumn("_own", F.when(length > width * F.pow(F.lit(2.0), F.col("_own")), F.col("_own") + 1).otherwise(F.col("_own")))
    if others is None:
        return side
    side = side.crossJoin(F.broadcast(others)).withColumn("_level", F.explode(F.array_union(F.array("_own"), F.filter("_levels", lambda x: x > F.col("_own"))))).drop("_levels")
    wide = width * F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col(lo) / wide).cast("long"), F.floor(F.col(hi) / wide).cast("long")
    return side.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence("_first", last)))


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """All pairs of rows whose ranges overlap, each pair once; no key has to be equal.

    Ranges of any length meet in bins: two that overlap share a bin at the level of the longer one, where each lies in
    two bins at most, and of the shared ones only the first counts. So a range costs two rows a level, however long it
    is, and rows that are far apart never meet. Levels are at most one for each doubling of the length; ``width`` is
    that of the narrowest bins and changes the speed only. ``closed`` ranges also overlap where one ends and the other
    begins. Rows with a null or reversed range are in no pair; columns of both sides must differ in name. A theta join
    ``abs(a - b) <= d`` is a closed one of ``a - d, a + d`` and ``b, b``.
    """
    (llo, lhi), (rlo, rhi) = left_range, right_range
    levels = [_levelled(side, lo, hi, width, None).agg(F.sort_array(F.collect_set("_own")).alias("_levels")) for side, lo, hi in ((left, llo, lhi), (right, rlo, rhi))]
    one = _levelled(left, llo, lhi, width, levels[1]).withColumnsRenamed({"_own": "_lown", "_first": "_lfirst"})
    two = _levelled(right, rlo, rhi, width, levels[0]).withColumnsRenamed({"_own": "_rown", "_first": "_rfirst"})
    met = one.join(two, ["_level", "_bin"])
    once = (F.col("_level") == F.greatest("_lown", "_rown")) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    overlap = (F.col(llo) <= F.col(rhi)) & (F.col(rlo) <= F.col(lhi)) if closed else (F.col(llo) < F.col(rhi)) & (F.col(rlo) < F.col(lhi))
    return met.filter(once & overlap).select(*left.columns, *right.columns)
