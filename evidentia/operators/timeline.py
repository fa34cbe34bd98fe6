"""Ordered rows: ranges, islands, gaps, windows and time maps. ``keys`` part the rows, so no window is global."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.folds import ddl, folded


def next_start_ranges(rows: DataFrame, keys: list[str], start: str, order: list[str], last: Column) -> DataFrame:
    """``end_sec`` of each row: the next row's start, ``last`` for the final one; two digits."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("end_sec", F.round(F.coalesce(F.lead(start).over(by), last), 2))


def islands(rows: DataFrame, keys: list[str], order: list[str], kind: str, name: str = "island") -> DataFrame:
    """Number, from 0, of each run of rows with one ``kind``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(kind).over(by).eqNullSafe(F.col(kind)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def gap_islands(rows: DataFrame, keys: list[str], at: Column, order: list[str], most: float, name: str = "cluster") -> DataFrame:
    """Number, from 0, of each run of rows that follow one another within ``most``; ``at`` is a number."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_at", at)
    new = F.when(F.col("_at") - F.lag("_at").over(by) <= most, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new", "_at")


def clusters(rows: DataFrame, keys: list[str], at: Column, order: list[str], most: float, least: int = 3) -> DataFrame:
    """Runs of ``least`` rows or more: size, first and last time, and how many lie in the middle."""
    told = gap_islands(rows, keys, at, order, most).withColumn("_t", at)
    out = told.groupBy(*keys, "cluster").agg(F.count("*").alias("members"), F.min("_t").alias("first_at"), F.max("_t").alias("last_at"))
    return out.filter(F.col("members") >= least).withColumn("middle", F.col("members") - 2)


def absorbed(groups: DataFrame, keys: list[str], kind: str, start: str, end: str, least: float) -> DataFrame:
    """Islands after short ones between two of one kind were absorbed, again and again, from left to right.

    The rule goes over all of a key's islands again until none is absorbed, so these (runs, not rows) are held at once.
    """

    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = [list(r) for r in rows]
        while len(own) > 2:
            out: list[list] = []
            i = 0
            while i < len(own):
                here = own[i]
                if out and i + 1 < len(own) and here[2] - here[1] < least and own[i - 1][0] == own[i + 1][0]:
                    out[-1] = [out[-1][0], out[-1][1], own[i + 1][2]]
                    i += 2
                else:
                    out.append(list(here))
                    i += 1
            if len(out) == len(own):
                break
            own = out
        yield from ((k, *row) for k, row in enumerate(own))

    names = [kind, start, end]
    return folded(groups, keys, [start], names, rule, f"segment long, {ddl(groups, names)}")


def row_windows(rows: DataFrame, keys: list[str], order: list[str], size: int, value: str) -> DataFrame:
    """Tumbling windows of ``size`` rows: count, mean, median and 90th percentile (linear) of a value."""
    by = Window.partitionBy(*keys).orderBy(*order)
    nr = F.floor((F.row_number().over(by) - 1) / size).cast("long")
    rows = rows.withColumn("window_index", nr)
    return rows.groupBy(*keys, "window_index").agg(
        F.count("*").alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.percentile(value, F.lit(0.5)), 4).alias("median"),
        F.round(F.percentile(value, F.lit(0.9)), 4).alias("p90"),
    )


def first_seen_numbers(rows: DataFrame, keys: list[str], group: str, order: list[str]) -> DataFrame:
    """Groups numbered from 1 by their first appearance within a key."""
    first = rows.groupBy(*keys, group).agg(F.min(F.struct(*order)).alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("first")


def guarded(rows: DataFrame, keys: list[str], order: list[str], kind: str, wanted: str, start: str, end: str, guard: float) -> DataFrame:
    """Intervals of one kind, shrunk by ``guard`` where a neighbour is of another; emptied ones go."""
    by = Window.partitionBy(*keys).orderBy(*order)
    left, right = F.lag(kind).over(by), F.lead(kind).over(by)
    rows = rows.withColumns({"_s": F.col(start) + F.when(left != wanted, guard).otherwise(0.0), "_e": F.col(end) - F.when(right != wanted, guard).otherwise(0.0)})
    return rows.filter((F.col(kind) == wanted) & (F.col("_e") > F.col("_s"))).withColumns({start: F.col("_s"), end: F.col("_e")}).drop("_s", "_e")


def complement(cuts: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """What is left of [0, total) of each key without its cuts, as ``piece, lo, hi``; ``total`` is a column of the cuts.

    Cuts may overlap; a key whose cuts cover all has no piece.
    """
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = cuts.select(*keys, reach.alias("lo"), F.least(F.col(start), F.col(total)).alias("hi"))
    tail = cuts.groupBy(*keys).agg(F.max(end).alias("lo"), F.max(total).alias("hi"))
    out = before.unionByName(tail).filter("hi > lo")
    return out.withColumn("piece", F.row_number().over(Window.partitionBy(*keys).orderBy("lo")) - 1)


def padded(pieces: DataFrame, keys: list[str], pad: float, total: float) -> DataFrame:
    """Pieces ``lo, hi`` widened by ``pad`` on both sides, within [0, total] and never over the piece before."""
    before = F.lag("hi").over(Window.partitionBy(*keys).orderBy("lo"))
    start = F.greatest(F.lit(0.0), F.col("lo") - pad, F.coalesce(F.when(before.isNotNull(), F.least(F.lit(total), before + pad)), F.lit(0.0)))
    return pieces.withColumns({"_lo": start, "_hi": F.least(F.lit(total), F.col("hi") + pad)}).withColumns({"lo": F.col("_lo"), "hi": F.col("_hi")}).drop("_lo", "_hi")


def time_map(pieces: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Where each kept piece lies once the pieces are stitched together: ``offset`` is the time before it."""
    by = Window.partitionBy(*keys).orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(F.col(hi) - F.col(lo)).over(by), F.lit(0.0)))


def speech_chunks(pieces: DataFrame, keys: list[str], most: float = 180.0, least: float = 30.0) -> DataFrame:
    """Pieces ``lo, hi`` packed in order into chunks of up to ``most`` seconds; a short last one joins its neighbour.

    Longer pieces are split first. The last two chunks of a key are held at a time.
    """
    size = lambda chunk: sum(hi - lo for lo, hi in chunk)

    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        nr, before, chunk, held = 0, [], [], 0.0
        for lo, hi in rows:
            while lo < hi:
                end = min(hi, lo + most)
                if chunk and held + end - lo > most:
                    yield from ((nr, *x) for x in before)
                    nr, before, chunk, held = nr + bool(before), chunk, [], 0.0
                chunk.append((lo, end))
                held += end - lo
                lo = end
        yield from ((nr, *x) for x in before)
        joined = before and size(chunk) < least and size(before) + size(chunk) <= most
        yield from ((nr + bool(before and not joined), *x) for x in chunk)

    return folded(pieces, keys, ["lo"], ["lo", "hi"], rule, "chunk long, lo double, hi double")


def context_groups(rows: DataFrame, keys: list[str], order: list[str], chars: str, boundary: str, soft: int, hard: int) -> DataFrame:
    """Number of the context that each row falls in: past ``soft`` characters the next boundary ends it, past ``hard`` any row."""
    names = [*order, chars, boundary]

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        nr, held = 0, 0
        for row in own:
            size, ends = row[-2] or 0, row[-1]
            if held and held + size > hard:
                nr, held = nr + 1, 0
            yield (*row, nr)
            held += size
            if ends and held >= soft:
                nr, held = nr + 1, 0

    return folded(rows, keys, order, names, rule, f"{ddl(rows, names)}, context long")


def spaced(rows: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """Rows in order, less those within ``least`` (to nine digits) of the last one kept; rows without a time are left out."""
    names = [at, *(c for c in rows.columns if c not in (*keys, at))]

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for row in own:
            if row[0] is not None and (last is None or round(row[0] - last, 9) > least):
                last = row[0]
                yield row

    return folded(rows, keys, names, names, rule, ddl(rows, names)).select(*rows.columns)


def nearest_filled(rows: DataFrame, keys: list[str], order: str, value: str, most: float) -> DataFrame:
    """Null values filled from the nearest known neighbour within ``most``; the earlier one on ties."""
    by = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    d1, d2 = F.col(order) - back["o"], ahead["o"] - F.col(order)
    pick = F.when((d1 <= F.coalesce(d2, d1)) & (d1 <= most), back["v"]).when(d2 <= most, ahead["v"])
    return rows.withColumn("filled", F.coalesce(F.col(value), pick))


def packed(rows: DataFrame, keys: list[str], order: list[str], sizes: list[str], limits: list[float]) -> DataFrame:
    """Rows packed in order into batches that keep every sum within its limit; a row over a limit is alone."""
    names = [*order, *sizes]

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        nr, held = 0, [0.0] * len(sizes)
        for row in own:
            asked = [x or 0.0 for x in row[len(order) :]]
            if any(held) and any(h + x > most for h, x, most in zip(held, asked, limits, strict=True)):
                nr, held = nr + 1, [0.0] * len(sizes)
            held = [h + x for h, x in zip(held, asked, strict=True)]
            yield (*row, nr)

    return folded(rows, keys, order, names, rule, f"{ddl(rows, names)}, batch long")


def tracked_state(rows: DataFrame, keys: list[str], order: list[str], value: str, high: float, low: float) -> DataFrame:
    """Writing episodes: one begins at a value of ``high`` or more, ends at ``low`` or less; start, end, peak and rows."""

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        state = None
        for at, x in own:
            if x is None:
                continue
            if state is not None:
                state = (state[0], at, max(state[2], x), state[3] + 1)
                if x <= low:
                    yield state
                    state = None
            elif x >= high:
                state = (at, at, x, 1)
        if state is not None:
            yield state

    o = rows.schema[order[-1]].dataType.simpleString()
    return folded(rows.withColumn(value, F.col(value).cast("double")), keys, order, [*order[-1:], value, *order[:-1]], lambda own: rule(r[:2] for r in own), f"start_at {o}, end_at {o}, peak double, n long")