"""Queries over captures: a user's events as one recording with scenes, videos and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import graph, metadata
from evidentia.plans.timelines import _E, _events
from evidentia.sources.session import table

KEYS = ["user_id"]


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Views as scenes, purchases as videos, clicks as writing on the scene shown last, and how long all lasted."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumn("at", F.round(F.col("sec") - F.min("sec").over(Window.partitionBy("user_id")), 3))
    rows = rows.withColumns({"frame": F.floor(F.col("at") * 30).cast("long") + 1, "scene": F.count_if(F.col("event_type") == "view").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    scenes = rows.filter("event_type = 'view'").select("user_id", F.col("scene").alias("scene_index"), F.col("at").alias("timestamp_sec"), F.col("frame").alias("frame_no"), (F.col("event_id") % 7).alias("look"))
    own = rows.filter("event_type = 'purchase'")
    nth = F.row_number().over(by)
    videos = own.select("user_id", nth.alias("segment_index"), F.col("at").alias("start_sec"), F.round(F.col("at") + F.col("value") * 100, 3).alias("end_sec"), F.col("frame").alias("start_frame_no"), (F.col("frame") + F.floor(F.col("value") * 3000)).cast("long").alias("end_frame_no"))
    clicks = rows.filter("event_type = 'click' and scene > 0")
    notes = clicks.select("user_id", F.col("scene").alias("scene_index"), F.row_number().over(Window.partitionBy("user_id", "scene").orderBy("ts", "event_id")).alias("annot_index"), F.col("at").alias("timestamp_sec"), F.col("frame").alias("frame_no"))
    return scenes, videos, notes, rows.groupBy("user_id").agg((F.max("at") + 60).alias("duration_sec"))


def unit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes and videos of each user on one timeline."""
    scenes, videos, _, durations = _recordings(spark, sf_dir)
    return metadata.timeline_units(scenes, videos, durations, KEYS)


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, videos, notes, durations = _recordings(spark, sf_dir)
    rows = metadata.capture_records(metadata.timeline_units(scenes, videos, durations, KEYS), notes, KEYS)
    looks = scenes.select("user_id", F.col("scene_index").alias("source_scene_index"), "look")
    rows = rows.join(looks, ["user_id", "source_scene_index"])
    rows = rows.withColumn("canonical", F.min("scene_index").over(Window.partitionBy("user_id", "look")))
    return metadata.finalized(rows, KEYS, "canonical")


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all users' scenes with the numbers of their slides; scenes that look alike are one slide."""
    return _final(spark, sf_dir).select("user_id", "filename", "scene_index", "capture_type", "scene_start_sec", "scene_end_sec", "slide_number", "slide_annot_index", "scene_annotations", "slide_annotations", "first_annotation", "last_annotation")


def scene_slide_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's scenes with their slide and its other showings."""
    return metadata.scene_slide_map(_final(spark, sf_dir), KEYS)


def dense_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes numbered anew once those without writing are gone, wherever their numbers stand."""
    rows = metadata.scene_slide_map(_final(spark, sf_dir), KEYS).select("user_id", "scene_index", "slide_canonical", F.array("previous_scene", "scene_index", "next_scene").alias("near"), "scene_annotations")
    left = rows.filter("scene_annotations > 0")
    numbers = metadata.dense_numbers(left, KEYS, "scene_index")
    for column, drop in (("scene_index", True), ("slide_canonical", False), ("near", False)):
        left = metadata.renumbered(left, numbers, KEYS, column, "old", "new", drop)
    return left.select("user_id", "scene_index", "slide_canonical", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


def sample_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line has no sample and gets that of the nearest line by day, among those of parts that end alike."""
    rows = _lines(spark, sf_dir)
    asked = rows.withColumn("sample", F.when(F.col("l_linenumber") % 3 != 0, F.col("sample")))
    manifest = rows.filter("l_linenumber % 3 <> 0").select("part", "frame", "sample")
    return metadata.attached_samples(asked, manifest, ["part"], "frame", "sample").select("l_orderkey", "l_linenumber", "sample", "inferred")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("part"), days.alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"))


def resolved_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenes, their orders as reviews of neighbouring ones: groups under vetoes and dropped scenes."""
    orders = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("same_slide", "different_slide", "uncertain", "transition_noise", "same_slide")]), (F.col("o_orderkey") % 31 % 5 + 1).cast("int"))
    reviews = orders.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("b"), kind.alias("decision"), (F.col("o_totalprice") % 100 / 100).alias("confidence"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("representative"))
    return graph.resolved_groups(table(spark, sf_dir, "customer"), reviews, "c_custkey", 0.9)


QUERIES = {"resolved_scenes": resolved_scenes, "unit_ranges": unit_ranges, "capture_records": capture_records, "scene_slide_map": scene_slide_map, "dense_scenes": dense_scenes, "sample_indices": sample_indices}
_UNITS = f"""
with {_E}, f as (select *, round(sec - min(sec) over (partition by user_id), 3) "at" from e),
r as (select *, floor("at" * 30)::bigint + 1 frame, count(*) filter (event_type = 'view') over (partition by user_id order by ts, event_id rows unbounded preceding) scene from f),
sc as (select user_id, 'slide' kind, scene source_index, "at" t, frame frame_no, null::double until, event_id % 7 look from r where event_type = 'view'),
vi as (select user_id, 'video' kind, row_number() over (partition by user_id order by ts, event_id) source_index, "at" t, greatest(1, round_even((frame + frame + floor(value * 3000)::bigint) / 2::double, 0))::bigint frame_no, round("at" + value * 100, 3) until, null look from r where event_type = 'purchase'),
du as (select user_id, max("at") + 60 d from r group by 1),
un as (select *, row_number() over w scene_index, round(t, 3) start_sec, round(coalesce(until, lead(t) over w, d), 3) end_sec from (select * from sc union all select * from vi) join du using (user_id) window w as (partition by user_id order by t, kind, source_index))"""
_FINAL = f"""{_UNITS},
sl as (select *, min(scene_index) over (partition by user_id, look) canon from un where kind = 'slide'),
cl as (select user_id, scene, row_number() over (partition by user_id, scene order by ts, event_id) annot_index, "at" t from r where event_type = 'click' and scene > 0),
ca as (
  select user_id, source_index, scene_index, canon, start_sec, end_sec, 'base' capture_type, 0 annot_index, t, printf('scene_%03d_base.jpg', scene_index) filename from sl
  union all
  select sl.user_id, source_index, scene_index, canon, start_sec, end_sec, 'annotation', cl.annot_index, cl.t, printf('scene_%03d_annot_%02d.jpg', scene_index, cl.annot_index) from cl join sl on sl.user_id = cl.user_id and sl.source_index = cl.scene),
ss as (select user_id, scene_index, canon, start_sec, end_sec, min(t) t, count(*) filter (capture_type = 'annotation') n from ca group by all),
su as (select *, sum(n) over (partition by user_id, canon order by t, scene_index rows unbounded preceding)::bigint upto, sum(n) over (partition by user_id, canon)::bigint total, min(row(start_sec, scene_index)) over (partition by user_id, canon) seen from ss),
nu as (select *, dense_rank() over (partition by user_id order by seen) slide_number from su)"""
_MAP = """
mp as (select user_id, scene_index, slide_number, canon, start_sec, end_sec, printf('scene_%03d_base.jpg', scene_index) base_filename, n, total, row_number() over w visit, lag(scene_index) over w p, lead(scene_index) over w x, count(*) over (partition by user_id, canon) size from nu window w as (partition by user_id, canon order by scene_index))"""
_HMS = "printf('%02d:%02d:%02d', round({0})::bigint // 3600, round({0})::bigint % 3600 // 60, round({0})::bigint % 60)"
ORACLES = {
    "resolved_scenes": """
with recursive t as (select o_custkey a, o_custkey + o_orderkey % 3 + 1 b, (['same_slide', 'different_slide', 'uncertain', 'transition_noise', 'same_slide'])[(o_orderkey % 31 % 5 + 1)::int] d,
  o_totalprice % 100 / 100 >= 0.9 sure, case when o_orderkey % 4 = 0 then o_custkey + o_orderkey % 3 + 1 end rep from orders),
own as (select c_custkey scene from customer), gone as (select distinct a scene from t where d = 'transition_noise' and sure),
free as (select scene from own where scene not in (select scene from gone)),
p as (select a, b, min(rep) filter (d = 'same_slide') rep from t where sure group by a, b having bool_or(d = 'same_slide') and not bool_or(d = 'different_slide')),
e as (select * from p where a in (select scene from free) and b in (select scene from free)),
r as (select scene x, scene y from own union select r.x, case when e.a = r.y then e.b else e.a end from r join e on e.a = r.y or e.b = r.y),
g as (select x scene, min(y) comp from r group by x),
h as (select g.comp, min(m.scene) head from e join g on g.scene = e.a join g m on m.scene = e.rep and m.comp = g.comp group by 1),
m as (select scene, bool_or(sure and d = 'different_slide') vetoed, bool_or(d = 'uncertain') open from (select unnest([a, b]) scene, d, sure from t) group by 1)
select g.scene, coalesce(head, g.comp) canonical, count(*) over (partition by g.comp) group_size, row_number() over w visit_order, lag(g.scene) over w previous, lead(g.scene) over w "next",
  coalesce(vetoed, false) vetoed, gone.scene is not null dropped, coalesce(head = g.scene, false) preferred, coalesce(open, false) and gone.scene is null manual
from g left join h using (comp) left join m on m.scene = g.scene left join gone on gone.scene = g.scene window w as (partition by g.comp order by g.scene)""",
    "unit_ranges": f"{_UNITS} select user_id, kind, source_index, t timestamp_sec, frame_no, scene_index, start_sec, end_sec from un",
    "capture_records": f"""{_FINAL}
select user_id, filename, scene_index, capture_type, ca.start_sec scene_start_sec, ca.end_sec scene_end_sec, slide_number, case when capture_type = 'base' then 0 else upto - n + annot_index end::bigint slide_annot_index,
  n scene_annotations, total slide_annotations, case when n = 0 then 0 else upto - n + 1 end::bigint first_annotation, case when n = 0 then 0 else upto end::bigint last_annotation
from ca join nu using (user_id, scene_index)""",
    "scene_slide_map": f"""{_FINAL},{_MAP}
select user_id, scene_index, slide_number, canon slide_canonical, {_HMS.format('start_sec')} start_formatted, {_HMS.format('end_sec')} end_formatted, base_filename, n scene_annotations, total slide_annotations,
  visit visit_order, visit > 1 is_revisit, p previous_scene, x next_scene, size group_size from mp""",
    "dense_scenes": f"""{_FINAL},{_MAP},
de as (select user_id, scene_index old, row_number() over (partition by user_id order by scene_index) nr from mp where n > 0)
select mp.user_id, de.nr scene_index, c.nr slide_canonical, concat_ws(',', a.nr, de.nr, b.nr) near
from mp join de on de.user_id = mp.user_id and de.old = scene_index left join de c on c.user_id = mp.user_id and c.old = canon
left join de a on a.user_id = mp.user_id and a.old = p left join de b on b.user_id = mp.user_id and b.old = x""",
    "sample_indices": """
with l as (select l_orderkey, l_linenumber, l_partkey % 50 part, datediff('day', date '1990-01-01', l_shipdate::date) frame, l_orderkey * 10 + l_linenumber sample from lineitem),
m as (select part, frame, max(sample) sample from l where l_linenumber % 3 <> 0 group by 1, 2),
a as (select l.*, b.frame bf, b.sample bs from l asof left join m b on l.part = b.part and l.frame >= b.frame),
c as (select a.*, n.frame nf, n.sample ns from a asof left join m n on a.part = n.part and a.frame <= n.frame)
select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then sample when nf is not null and (bf is null or nf - frame <= frame - bf) then ns else bs end sample, l_linenumber % 3 = 0 and (nf is not null or bf is not null) inferred from c""",
}
