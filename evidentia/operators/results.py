"""Results as they are shown and passed on: lookups, bundles, views, decision lists and running numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: Sequence[str], name: str) -> DataFrame:
    """Each parent with the array ``name`` of its children's structs by ``order``; childless parents have an empty one.

    A parent's children are one record that the caller asks for whole; null keys have none.
    """
    gathered = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    empty = F.array().cast(gathered.schema[name].dataType)
    return parents.join(gathered, key, "left").withColumn(name, F.coalesce(name, empty))


def overriding(payloads: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """One row a key: of each column the value of the last payload in which it is neither null nor empty."""
    every = None
    for nr, payload in enumerate(payloads):
        own = payload.select(key, F.lit(nr).alias("_nr"), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
        every = own if every is None else every.unionByName(own)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_nr", c)))[c].alias(c)
    return every.groupBy(key).agg(*[last(c) for c in columns])


def numbered_contexts(rows: DataFrame, group: str, order: Sequence[str], given: str, name: str) -> DataFrame:
    """Contexts re-numbered within their group; one without an id gets ``S<group>-C<number>``."""
    rows = rows.withColumn("context_index", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    made = F.format_string("S%03d-C%03d", F.col(group), F.col("context_index"))
    return rows.withColumn(name, F.coalesce(F.nullif(F.trim(given), F.lit("")), made))


def bundled(issues: DataFrame, slides: DataFrame, contexts: DataFrame, slide: str, index: str, text: str, reach: int = 1) -> DataFrame:
    """Each issue with its slide and the contexts up to ``reach`` places around its own, in order.

    ``issues`` and ``contexts`` have the slide's key and a place in it. An issue asks for 2 * reach + 1 places, so the
    join is on equal keys and its rows grow with the issues alone.
    """
    wanted = issues.withColumn("_at", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_place", F.col(index) + F.col("_at"))
    own = contexts.select(slide, F.col(index).alias("_place"), F.col(text).alias("_text"))
    found = wanted.join(own, [slide, "_place"], "left").groupBy(slide, index).agg(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_at", "_text")))).alias("window"))
    return issues.join(found, [slide, index], "left").join(slides, slide, "left")


def neighbours(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``key, number, previous, next``: the numbers beside each one among those that have rows."""
    by = Window.partitionBy(key).orderBy(number)
    return rows.select(key, number).distinct().withColumns({"previous": F.lag(number).over(by), "next": F.lead(number).over(by)})


def shared_evidence(members: DataFrame, key: Column, order: str) -> DataFrame:
    """Members with the first member of their group by ``key`` as the one whose evidence all of them share, and its size."""
    keyed = members.withColumn("_key", key)
    groups = keyed.groupBy("_key").agg(F.min(order).alias("evidence_of"), F.count("*").alias("group_size"))
    return keyed.join(groups, "_key").drop("_key")


def first_match(rules: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """An ordered decision list: the name of the first rule that holds; a null condition doesn't hold."""
    out = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules], F.lit(otherwise))
    return out


def labelled(code: Column, labels: Mapping[str, str]) -> Column:
    """A code's label, in any case and with blanks around it; the code itself if it has none."""
    own = F.lower(F.trim(code))
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels.values()]), F.array_position(F.array(*[F.lit(x) for x in labels]), own).cast("int") - 1), code)


def compact_json(columns: Sequence[str]) -> Column:
    """The named columns as a JSON object without those that are null or empty strings."""
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))


def running_ids(rows: DataFrame, batch: str, coarse: Column, order: Sequence[str], pattern: str) -> DataFrame:
    """Ids that run on over all batches. Rows are numbered within (batch, coarse), then moved by the counts before.

    ``coarse`` must not fall while ``order`` rises within a batch; only its counts are ordered as a whole.
    """
    rows = rows.withColumn("_coarse", coarse)
    counts = rows.groupBy(batch, "_coarse").agg(F.count("*").alias("_n"))
    totals = counts.groupBy(batch).agg(F.sum("_n").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    totals = totals.select(batch, F.coalesce(F.sum("_n").over(Window.orderBy(batch).rowsBetween(*before)), F.lit(0)).alias("_batch_at"))
    counts = counts.select(batch, "_coarse", F.coalesce(F.sum("_n").over(Window.partitionBy(batch).orderBy("_coarse").rowsBetween(*before)), F.lit(0)).alias("_at"))
    own = F.row_number().over(Window.partitionBy(batch, "_coarse").orderBy(*order))
    rows = rows.join(totals, batch).join(counts, [batch, "_coarse"])
    return rows.withColumn("display_id", F.format_string(pattern, F.col("_batch_at") + F.col("_at") + own)).drop("_coarse", "_batch_at", "_at")


def without_short(scenes: DataFrame, key: str, scene: str, start: str, end: str, kind: str, least: float, kept: str) -> DataFrame:
    """Scenes that last longer than ``least`` or are of the kind that always stays, numbered anew within their key."""
    left = scenes.filter((F.col(end) - F.col(start) > least) | (F.col(kind) == kept))
    return left.withColumn("scene_number", F.dense_rank().over(Window.partitionBy(key).orderBy(start, scene)))


def stitched_back(times: DataFrame, pieces: DataFrame, key: str, time: str) -> DataFrame:
    """Times on a stitched track mapped to the track that its pieces (``key, lo, hi``, in order) were cut from.

    A piece begins on the stitched track where those before it add up to; a time beyond the last one is clamped to
    its end, one between two pieces' ends belongs to the later. Keys without pieces give null.
    """
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0))
    by = Window.partitionBy(key).orderBy("lo", "hi")
    laid = pieces.withColumn("_at", F.coalesce(F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    marks = laid.select(key, F.col("_at").alias("_t"), F.lit(0).alias("_side"), F.struct("_at", "lo", "hi").alias("_piece"))
    asked = times.select(F.struct(*[F.col(c) for c in times.columns]).alias("_row"), F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_side"))
    both = marks.select(key, "_t", "_side", "_piece", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    both = both.unionByName(asked.select(key, "_t", "_side", F.lit(None).cast(marks.schema["_piece"].dataType).alias("_piece"), "_row"))
    last = F.last("_piece", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_piece", last).filter("_side = 1")
    back = F.least(F.col("_piece.lo") + F.col("_t") - F.col("_piece._at"), F.col("_piece.hi"))
    return out.select("_row.*", back.alias("original"))


def chunk_specs(rows: DataFrame, duration: str, size: float, overlap: float) -> DataFrame:
    """Chunks of ``size`` with ``overlap`` on both sides: ``chunk, core_start, core_end, start, end``."""
    n = F.greatest(F.ceil(F.col(duration) / size).cast("int"), F.lit(1))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    core = {"core_start": F.col("chunk") * size, "core_end": F.least((F.col("chunk") + 1) * size, F.col(duration))}
    rows = rows.withColumns(core)
    return rows.withColumns({"start": F.greatest(F.col("core_start") - overlap, F.lit(0.0)), "end": F.least(F.col("core_end") + overlap, F.col(duration))})


def kept_terms(terms: Column) -> Column:
    """Terms that no other, longer one of the array contains."""
    return F.filter(terms, lambda x: ~F.exists(terms, lambda y: (F.length(y) > F.length(x)) & y.contains(x)))


def applied_edits(text: Column, edits: Column) -> Column:
    """The text with span edits ``array<struct<start,end,said>>`` (characters from 0) applied from right to left.

    Of two that overlap the one further right is applied; what reaches beyond the text is left out.
    """
    start = F.struct(text.alias("text"), F.length(text).cast("int").alias("free"))

    def step(done: Column, x: Column) -> Column:
        fits = (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= done["free"])
        new = F.concat(F.substring(done["text"], F.lit(1), x["start"]), x["said"], F.substring(done["text"], x["end"] + 1, F.length(done["text"])))
        return F.when(fits, F.struct(new.alias("text"), x["start"].alias("free"))).otherwise(done)

    return F.aggregate(F.reverse(F.array_sort(edits)), start, step)["text"]
