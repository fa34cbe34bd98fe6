"""The metadata of a recording's captures: one timeline of scenes and videos, numbers, ranges and counts.

All functions take ``keys``, the columns that tell recordings apart. Windows are over the scenes of one recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.numbers import hours_text


def attached_samples(rows: DataFrame, manifest: DataFrame, keys: Sequence[str], frame: str, sample: str) -> DataFrame:
    """``rows`` with ``sample`` and ``inferred``: rows without a sample get that of the nearest frame of the manifest.

    Of two frames as near the later one counts; a frame number under 1 gets nothing. ``manifest`` has ``keys``,
    ``frame`` and ``sample``; of several samples of one frame the last counts. A key's distinct frames, asked or known,
    are sorted together, not its rows, and read once in either direction: Spark tells a window that runs from a row to
    the end anew at each row, so the way back is a window that runs from the start of the other order.
    """
    missing = (F.coalesce(sample, F.lit(0)) <= 0) & (F.col(frame) > 0)
    known = manifest.filter(F.col(frame).isNotNull() & F.col(sample).isNotNull()).groupBy(*keys, frame).agg(F.max(sample).alias("_sample"))
    marks = known.select(*keys, F.col(frame).alias("_at"), F.struct(F.col(frame).alias("at"), "_sample").alias("_mark"))
    asked = rows.filter(missing).select(*keys, F.col(frame).alias("_at")).distinct()
    points = asked.unionByName(marks, allowMissingColumns=True).groupBy(*keys, "_at").agg(F.max("_mark").alias("_mark"), F.max(F.col("_mark").isNull()).alias("_asked"))
    nearest = lambda order: F.last("_mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    points = points.withColumn("_before", nearest(F.col("_at").asc())).withColumn("_after", nearest(F.col("_at").desc())).filter("_asked")
    near = F.when(F.col("_after").isNotNull() & (F.col("_before").isNull() | (F.col("_after.at") - F.col("_at") <= F.col("_at") - F.col("_before.at"))), F.col("_after._sample")).otherwise(F.col("_before._sample"))
    found = points.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_at", near.alias("_near")).filter("_near is not null")
    same = missing & (F.col(frame) == F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = rows.join(found, same, "left").withColumn("inferred", F.col("_near").isNotNull())
    return out.withColumn(sample, F.coalesce("_near", sample)).select(*rows.columns, "inferred")


def timeline_units(scenes: DataFrame, videos: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, kind, source_index, timestamp_sec, frame_no, scene_index, start_sec, end_sec``: scenes and videos on one timeline.

    ``scenes`` have ``scene_index, timestamp_sec, frame_no``, ``videos`` ``segment_index, start_sec, end_sec,
    start_frame_no, end_frame_no``, ``durations`` ``duration_sec``. Units are numbered from 1 by time, a scene before a
    video at the same time. A video lasts as long as it says, a scene until the next unit begins, the last one to the
    recording's end. Recordings without a duration end at 0.
    """
    one = scenes.select(*keys, F.lit("slide").alias("kind"), F.col("scene_index").cast("long").alias("source_index"), F.col("timestamp_sec").cast("double").alias("timestamp_sec"), F.col("frame_no").cast("long").alias("frame_no"), F.lit(None).cast("double").alias("until"))
    middle = F.greatest(F.lit(1), F.bround((F.col("start_frame_no") + F.col("end_frame_no")) / 2)).cast("long")
    two = videos.select(*keys, F.lit("video").alias("kind"), F.col("segment_index").cast("long").alias("source_index"), F.col("start_sec").cast("double").alias("timestamp_sec"), middle.alias("frame_no"), F.col("end_sec").cast("double").alias("until"))
    by = Window.partitionBy(*keys).orderBy("timestamp_sec", "kind", "source_index")
    units = one.unionByName(two).withColumns({"scene_index": F.row_number().over(by).cast("long"), "after": F.lead("timestamp_sec").over(by)})
    units = units.join(durations.select(*keys, "duration_sec"), list(keys), "left")
    end = F.coalesce("until", "after", F.col("duration_sec").cast("double"), F.lit(0.0))
    return units.select(*keys, "kind", "source_index", "timestamp_sec", "frame_no", "scene_index", F.round("timestamp_sec", 3).alias("start_sec"), F.round(end, 3).alias("end_sec"))


def _named(pattern: str, *columns: str) -> Column:
    return F.format_string(pattern, *[F.col(c) for c in columns])


def video_records(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The captures of videos: one at the middle of each."""
    own = units.filter("kind = 'video'")
    return own.select(*keys, _named("scene_%03d_video.jpg", "scene_index").alias("filename"), "scene_index", F.lit("base").alias("capture_type"), F.lit("video").alias("scene_type"), "frame_no", F.round("timestamp_sec", 3).alias("timestamp_sec"), F.col("source_index").alias("region_segment_index"), "start_sec", "end_sec")


def capture_records(units: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The captures of scenes: a base each and the writing on it, under the timeline's numbers.

    ``annotations`` have ``scene_index`` (as in the scenes), ``annot_index, timestamp_sec, frame_no``. Writing on a scene
    that isn't on the timeline keeps its number and has itself as its range. Counts are those of the scene; the
    columns are ``filename, scene_index, source_scene_index, capture_type, annot_index, frame_no, timestamp_sec,
    annotation_count, annotation_first, annotation_last, scene_start_sec, scene_end_sec``.
    """
    slides = units.filter("kind = 'slide'").select(*keys, F.col("source_index").alias("source_scene_index"), "scene_index", "frame_no", "timestamp_sec", "start_sec", "end_sec")
    bases = slides.select(*keys, "source_scene_index", "scene_index", F.lit("base").alias("capture_type"), F.lit(0).cast("long").alias("annot_index"), "frame_no", "timestamp_sec", _named("scene_%03d_base.jpg", "scene_index").alias("filename"))
    notes = annotations.select(*keys, F.col("scene_index").cast("long").alias("source_scene_index"), F.col("annot_index").cast("long").alias("annot_index"), F.col("frame_no").cast("long").alias("frame_no"), F.col("timestamp_sec").cast("double").alias("timestamp_sec"))
    notes = notes.join(slides.select(*keys, "source_scene_index", "scene_index"), [*keys, "source_scene_index"], "left").withColumn("scene_index", F.coalesce("scene_index", "source_scene_index"))
    notes = notes.select(*keys, "source_scene_index", "scene_index", F.lit("annotation").alias("capture_type"), "annot_index", "frame_no", "timestamp_sec", _named("scene_%03d_annot_%02d.jpg", "scene_index", "annot_index").alias("filename"))
    rows = bases.unionByName(notes)
    counts = notes.groupBy(*keys, "scene_index").agg(F.count("*").alias("annotation_count"))
    ranges = units.select(*keys, "scene_index", "start_sec", "end_sec")
    rows = rows.join(counts, [*keys, "scene_index"], "left").join(ranges, [*keys, "scene_index"], "left")
    count = F.coalesce("annotation_count", F.lit(0)).cast("long")
    own = F.round("timestamp_sec", 3)
    return rows.select(
        *keys,
        "filename",
        "scene_index",
        "source_scene_index",
        "capture_type",
        "annot_index",
        "frame_no",
        own.alias("timestamp_sec"),
        count.alias("annotation_count"),
        F.when(count > 0, 1).otherwise(0).cast("long").alias("annotation_first"),
        count.alias("annotation_last"),
        F.coalesce("start_sec", own).alias("scene_start_sec"),
        F.coalesce("end_sec", "start_sec", own).alias("scene_end_sec"),
    )


def finalized(rows: DataFrame, keys: Sequence[str], canonical: str) -> DataFrame:
    """Captures with the numbers of their slides: ``slide_number, slide_annot_index``, and counts over the whole slide.

    ``canonical`` names the scene that stands for the slide a scene shows (null: the scene itself). Slides are numbered
    by their first scene's start. Writing is counted on through a slide's scenes, in order of their first capture:
    ``scene_annotations`` and ``slide_annotations``, and ``first_annotation`` to ``last_annotation`` of the slide's (0 where
    a scene has none). A base has the index 0.
    """
    rows = rows.withColumn("_slide", F.coalesce(F.col(canonical), F.col("scene_index")).cast("long"))
    written = F.col("capture_type").isin("annotation", "build")
    base = F.struct((F.col("capture_type") != "base").cast("int"), "filename", F.col("_slide").alias("slide"), F.coalesce("scene_start_sec", "timestamp_sec", F.lit(0.0)).alias("start"))
    scenes = rows.groupBy(*keys, "scene_index").agg(F.min(base).alias("b"), F.min("timestamp_sec").alias("_first"), F.count_if(written).alias("scene_annotations"))
    scenes = scenes.select(*keys, "scene_index", "_first", "scene_annotations", F.col("b.slide").alias("slide_canonical"), F.col("b.start").alias("_start"))
    slide = Window.partitionBy(*keys, "slide_canonical")
    upto = F.sum("scene_annotations").over(slide.orderBy("_first", "scene_index").rowsBetween(Window.unboundedPreceding, 0))
    scenes = scenes.withColumns({"last_annotation": upto, "slide_annotations": F.sum("scene_annotations").over(slide), "_seen": F.min(F.struct("_start", "scene_index")).over(slide)})
    scenes = scenes.withColumn("slide_number", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_seen")).cast("long"))
    none = F.col("scene_annotations") == 0
    before = F.col("last_annotation") - F.col("scene_annotations")
    scenes = scenes.select(*keys, "scene_index", "slide_canonical", "slide_number", "scene_annotations", "slide_annotations", F.when(none, 0).otherwise(before + 1).alias("first_annotation"), F.when(none, 0).otherwise(F.col("last_annotation")).alias("last_annotation"))
    nth = F.row_number().over(Window.partitionBy(*keys, "scene_index", written).orderBy("annot_index", "timestamp_sec", "filename"))
    rows = rows.withColumn("_nth", nth).join(scenes, [*keys, "scene_index"])
    index = F.when(written, F.col("first_annotation") - 1 + F.col("_nth")).otherwise(0)
    return rows.withColumn("slide_annot_index", index.cast("long")).drop("_slide", "_nth")


def scene_slide_map(final: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each scene of finalized captures: its slide, its range as text, and how often the slide was shown by then."""
    rank = F.struct((F.col("capture_type") != "base").cast("int"), "filename", "slide_number", "slide_canonical", "scene_start_sec", "scene_end_sec", "scene_annotations", "slide_annotations")
    rows = final.groupBy(*keys, "scene_index").agg(F.min(rank).alias("b")).select(*keys, "scene_index", F.col("b.slide_number").alias("slide_number"), F.col("b.slide_canonical").alias("slide_canonical"), F.col("b.scene_start_sec").alias("start"), F.col("b.scene_end_sec").alias("end"), F.col("b.filename").alias("base_filename"), F.col("b.scene_annotations").alias("scene_annotations"), F.col("b.slide_annotations").alias("slide_annotations"))
    slide = Window.partitionBy(*keys, "slide_canonical")
    order = slide.orderBy("scene_index")
    visit = F.row_number().over(order).cast("long")
    return rows.select(*keys, "scene_index", "slide_number", "slide_canonical", hours_text(F.col("start")).alias("start_formatted"), hours_text(F.col("end")).alias("end_formatted"), "base_filename", "scene_annotations", "slide_annotations", visit.alias("visit_order"), (visit > 1).alias("is_revisit"), F.lag("scene_index").over(order).alias("previous_scene"), F.lead("scene_index").over(order).alias("next_scene"), F.count("*").over(slide).alias("group_size"))


def dense_numbers(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``keys, old, new``: the numbers that are left in ``column``, from 1 without gaps."""
    left = rows.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("old")).distinct()
    return left.withColumn("new", F.row_number().over(Window.partitionBy(*keys).orderBy("old")).cast("long"))


def renumbered(table: DataFrame, numbers: DataFrame, keys: Sequence[str], column: str, old: str, new: str, drop: bool = True) -> DataFrame:
    """``table`` with ``column`` (a number or an array of numbers) moved from the ``old`` numbers of ``numbers`` to the ``new``.

    Rows whose number is gone are dropped (``drop``) or keep a null; numbers that are gone leave an array, which stays
    in order and without repeats. Null keys never match.
    """
    pairs = numbers.select(*keys, F.col(old).alias("_old"), F.col(new).alias("_new"))
    if table.schema[column].dataType.typeName() != "array":
        how = "inner" if drop else "left"
        moved = table.withColumn("_old", F.col(column)).join(pairs, [*keys, "_old"], how)
        return moved.withColumn(column, F.col("_new")).drop("_old", "_new").select(*table.columns)
    # The numbers of one recording: a map of its scenes.
    maps = pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_old", "_new"))).alias("_map"))
    moved = table.join(maps, list(keys), "left")
    return moved.withColumn(column, F.array_sort(F.array_distinct(F.filter(F.transform(column, lambda x: F.try_element_at("_map", x)), lambda x: x.isNotNull())))).select(*table.columns)
