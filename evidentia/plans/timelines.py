"""Timeline queries: ranges, islands, windows, interval joins, neighbourhoods. Events of a user stand for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import joins, timeline
from evidentia.sources.session import table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("ts").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", seconds.alias("sec"))


_E = "e as (select event_id, user_id, ts, event_type, value, epoch(ts) sec from events)"


def slide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event lasts until the user's next one, the last one an hour."""
    out = timeline.next_start_ranges(_events(spark, sf_dir), KEYS, "sec", ORDER, F.col("sec") + 3600)
    return out.select("event_id", "user_id", F.round("sec", 2).alias("start_sec"), "end_sec")


SLIDE_RANGES = f"with {_E} select event_id, user_id, round(sec, 2) start_sec, round(coalesce(lead(sec) over (partition by user_id order by ts, event_id), sec + 3600), 2) end_sec from e"


def type_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type: size, bounds, mean value."""
    told = timeline.islands(_events(spark, sf_dir), KEYS, ORDER, "event_type")
    return told.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("sec").alias("last_sec"), F.round(F.avg("value"), 4).alias("mean_value"))


_ISLANDS = f"""{_E}, f as (select *, case when lag(event_type) over w = event_type then 0 else 1 end n from e window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint - 1 island from f)"""
TYPE_ISLANDS = f"with {_ISLANDS} select user_id, island, first(event_type) event_type, count(*) n, min(event_id) first_id, max(sec) last_sec, round(avg(value), 4) mean_value from i group by user_id, island"


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more events of a user within six hours of one another."""
    return timeline.clusters(_events(spark, sf_dir), KEYS, F.col("sec"), ORDER, 21600)


GAP_CLUSTERS = f"""
with {_E}, f as (select *, case when sec - lag(sec) over w <= 21600 then 0 else 1 end n from e window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint - 1 cluster from f)
select user_id, cluster, count(*) members, min(sec) first_at, max(sec) last_at, count(*) - 2 middle from i group by user_id, cluster having count(*) >= 3"""


def row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten events: mean, median and 90th percentile."""
    return timeline.row_windows(_events(spark, sf_dir), KEYS, ORDER, 10, "value")


ROW_WINDOWS = f"""
with {_E}, w as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 window_index from e)
select user_id, window_index, count(*) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.9), 4) p90 from w group by all"""


def absorbed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of cheap and dear events after short ones between two of a kind were absorbed."""
    rows = _events(spark, sf_dir).withColumn("kind", F.when(F.col("value") > 20, "slide").otherwise("video"))
    told = timeline.islands(rows, KEYS, ORDER, "kind").groupBy("user_id", "island").agg(F.first("kind").alias("kind"), F.min("sec").alias("start_sec"), F.max("sec").alias("end_sec"))
    return timeline.absorbed(told, KEYS, "kind", "start_sec", "end_sec", 7200.0)


def first_seen_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types numbered by first appearance."""
    return timeline.first_seen_numbers(_events(spark, sf_dir), KEYS, "event_type", ORDER)


FIRST_SEEN = f"""with {_E}, f as (select user_id, event_type, min(row(ts, event_id)) first from e group by all)
select user_id, event_type, row_number() over (partition by user_id order by first) number from f"""


def guarded_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views shrunk by a minute where the neighbour is of another type."""
    rows = timeline.next_start_ranges(_events(spark, sf_dir), KEYS, "sec", ORDER, F.col("sec") + 3600).withColumn("start_sec", F.round("sec", 2))
    return timeline.guarded(rows, KEYS, ORDER, "event_type", "view", "start_sec", "end_sec", 60.0).select("event_id", F.round("start_sec", 2).alias("start_sec"), F.round("end_sec", 2).alias("end_sec"))


GUARDED = f"""
with {_E}, r as (select *, round(sec, 2) s, round(coalesce(lead(sec) over w, sec + 3600), 2) t, lag(event_type) over w l, lead(event_type) over w n from e window w as (partition by user_id order by ts, event_id)),
g as (select event_id, event_type, s + case when l <> 'view' then 60 else 0 end s, t - case when n <> 'view' then 60 else 0 end t from r)
select event_id, round(s, 2) start_sec, round(t, 2) end_sec from g where event_type = 'view' and t > s"""


def speech_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January without each user's error hours, and where the pieces lie once stitched together."""
    start = F.lit(1704067200.0)
    cuts = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", (F.floor("sec") - start).alias("s"), (F.floor("sec") - start + 3600).alias("e"), F.lit(2678400.0).alias("total"))
    pieces = timeline.complement(cuts, KEYS, "s", "e", "total")
    return timeline.time_map(pieces, KEYS, "lo", "hi")


SPEECH = f"""
with {_E}, c as (select user_id, floor(sec) - 1704067200 s, floor(sec) - 1704067200 + 3600 t, 2678400.0::double total from e where event_type = 'error'),
b as (select user_id, coalesce(max(t) over (partition by user_id order by s, t rows between unbounded preceding and 1 preceding), 0) lo, least(s, total) hi from c
  union all select user_id, max(t), max(total) from c group by user_id),
p as (select *, row_number() over (partition by user_id order by lo) - 1 piece from b where hi > lo)
select user_id, lo, hi, piece, coalesce(sum(hi - lo) over (partition by user_id order by lo rows between unbounded preceding and 1 preceding), 0) "offset" from p"""


def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces packed into chunks of up to two days."""
    return timeline.speech_chunks(speech_pieces(spark, sf_dir), KEYS, 172800.0, 21600.0)


def filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown values (those under 5) taken from the user's nearest event within a day."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "sec", F.when(F.col("value") >= 5, F.col("value")).alias("known"))
    rows = rows.groupBy("user_id", "sec").agg(F.max("known").alias("known"), F.min("event_id").alias("event_id"))
    return timeline.nearest_filled(rows, KEYS, "sec", "known", 86400.0).select("event_id", "known", "filled")


FILLED = """
with r as (select user_id, epoch(ts) sec, max(case when value >= 5 then value end) known, min(event_id) event_id from events group by all),
n as (select *, last_value(case when known is not null then {'o': sec, 'v': known} end ignore nulls) over (partition by user_id order by sec rows unbounded preceding) b,
  first_value(case when known is not null then {'o': sec, 'v': known} end ignore nulls) over (partition by user_id order by sec rows between current row and unbounded following) a from r),
d as (select *, sec - b.o d1, a.o - sec d2 from n)
select event_id, known, coalesce(known, case when d1 <= coalesce(d2, d1) and d1 <= 86400 then b.v when d2 <= 86400 then a.v end) filled from d"""


def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase that each event of a user belongs to: the last one before it, or the first."""
    events = _events(spark, sf_dir)
    ranges = events.filter("event_type = 'purchase'").select("user_id", "sec", F.col("event_id").alias("scene"))
    points = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "sec")
    return joins.point_in_range(points, ranges, KEYS, "sec", "sec", "sec", "scene").select("event_id", "scene")


POINT = f"""
with {_E}, r as (select user_id, sec, event_id scene from e where event_type = 'purchase'), f as (select user_id, first(scene order by sec) scene from r group by user_id)
select p.event_id, coalesce(r.scene, f.scene) scene from (select * from e where event_type <> 'purchase') p
asof left join r on p.user_id = r.user_id and p.sec >= r.sec left join f on f.user_id = p.user_id"""


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = timeline.next_start_ranges(_events(spark, sf_dir), KEYS, "sec", ORDER, F.col("sec") + 3600)
    spans = timeline.next_start_ranges(_events(spark, sf_dir).filter("event_type = 'purchase'"), KEYS, "sec", ORDER, F.col("sec") + 7200)
    segments = events.filter("event_type = 'view'").select("user_id", "event_id", F.round("sec", 2).alias("start_sec"), F.least("end_sec", F.round("sec", 2) + 5000).alias("end_sec"))
    return segments, spans.select("user_id", F.col("event_id").alias("span"), F.round("sec", 2).alias("start_sec"), F.least("end_sec", F.round("sec", 2) + 40000).alias("end_sec"))


def overlap_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase span of each view: largest overlap, later spans near a boundary, else the nearest."""
    segments, spans = _segments(spark, sf_dir)
    return joins.overlap_assign(segments, spans, KEYS, "event_id", "span", 20000.0, 600.0, 3000.0, 1800.0)


OVERLAP = f"""
with {_E}, v as (select *, round(coalesce(lead(sec) over (partition by user_id order by ts, event_id), sec + 3600), 2) t from e),
s as (select user_id, event_id, round(sec, 2) s, greatest(round(sec, 2), least(t, round(sec, 2) + 5000)) t from v where event_type = 'view'),
q as (select *, round(coalesce(lead(sec) over (partition by user_id order by ts, event_id), sec + 7200), 2) t from e where event_type = 'purchase'),
o as (select user_id, event_id span, round(sec, 2) os, least(t, round(sec, 2) + 40000) ot from q),
p as (select s.*, o.span, o.os, o.ot, least(t, ot) - greatest(s, os) ov, s + (t - s) * 0.65 anchor from s left join o using (user_id)),
d as (select *, case when anchor between os and ot then 0 else least(abs(anchor - os), abs(anchor - ot)) end dist from p),
g as (select user_id, event_id, any_value(s) s, any_value(t) t,
  max(case when ov > 0 then {{'v': ov, 'o': os, 'id': span}} end) best, min(case when ov > 0 and os > s and os <= t then {{'o': os, 'v': ov, 'id': span}} end) later,
  min(case when ov <= 0 then {{'d': dist, 'o': os, 'id': span}} end) near from d group by all)
select user_id, event_id, case when later is not null and (s >= later.o - 600 or later.v >= best.v * 0.75 or t - later.o >= 3000) then later.id when best is not null then best.id when near.d <= 1800 then near.id end span from g"""


def nearest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase nearest to each sign-up of a user, the later one on ties."""
    events = _events(spark, sf_dir)
    marks = events.filter("event_type = 'purchase'").groupBy("user_id", "sec").agg(F.min("event_id").alias("mark"))
    points = events.filter("event_type = 'signup'").select("event_id", "user_id", "sec")
    return joins.nearest(points, marks, KEYS, "sec", "sec", "mark").select("event_id", "mark")


NEAREST = f"""
with {_E}, m as (select user_id, sec, min(event_id) mark from e where event_type = 'purchase' group by all), p as (select * from e where event_type = 'signup'),
b as (select p.event_id, p.user_id, p.sec, l.sec ls, l.mark lm from p asof left join m l on p.user_id = l.user_id and p.sec >= l.sec),
c as (select b.*, r.sec rs, r.mark rm from b asof left join m r on b.user_id = r.user_id and b.sec <= r.sec)
select event_id, case when rs is not null and (ls is null or rs - sec <= sec - ls) then rm else lm end mark from c"""


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the five before and after it."""
    rows = joins.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 5)
    return rows.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context_md5"))


CONTEXT = "select conv_id, turn, md5(string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 5 preceding and 5 following)) context_md5 from conversations"


def halo_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of three with a halo of one."""
    return joins.halo_batches(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


HALO = """
with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 nr, (count(*) over (partition by conv_id) - 1) // 3 last from conversations),
b as (select distinct conv_id, turn, nr, last, unnest([(nr + 1) // 3, nr // 3, case when nr = 0 then -1 else (nr - 1) // 3 end]) batch from r)
select conv_id, turn, batch, batch = nr // 3 core from b where batch between 0 and last"""


def role_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation and role in chunks of two."""
    return joins.chunked(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], ["turn"], 2)


CHUNKS = "select conv_id, role, turn, (row_number() over (partition by conv_id, role order by turn) - 1) // 2 chunk from conversations"


def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into contexts by soft and hard limits of characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), F.col("text").rlike(r"[.!?]\s*$").alias("ends"))
    return timeline.context_groups(rows, ["conv_id"], ["turn"], "chars", "ends", 200, 600)


def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed in order under limits of turns and characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1.0).alias("one"), F.length("text").cast("double").alias("chars"))
    return timeline.packed(rows, ["conv_id"], ["turn"], ["one", "chars"], [3.0, 500.0])


def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events less those within a day of the last one kept."""
    return timeline.spaced(_events(spark, sf_dir).select("user_id", "sec", "event_id"), KEYS, "sec", 86400.0)


def writing_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from a dear event to the next cheap one."""
    return timeline.tracked_state(_events(spark, sf_dir), KEYS, ["sec", "event_id"], "value", 60.0, 5.0)


QUERIES = {
    "slide_ranges": slide_ranges,
    "type_islands": type_islands,
    "gap_clusters": gap_clusters,
    "row_windows": row_windows,
    "absorbed_segments": absorbed_segments,
    "first_seen_numbers": first_seen_numbers,
    "guarded_intervals": guarded_intervals,
    "speech_pieces": speech_pieces,
    "speech_chunks": speech_chunks,
    "filled_values": filled_values,
    "point_in_range": point_in_range,
    "overlap_assign": overlap_assign,
    "nearest_mark": nearest_mark,
    "context_windows": context_windows,
    "halo_batches": halo_batches,
    "role_chunks": role_chunks,
    "context_groups": context_groups,
    "packed_batches": packed_batches,
    "spaced_events": spaced_events,
    "writing_episodes": writing_episodes,
}
ORACLES = {
    "slide_ranges": SLIDE_RANGES,
    "type_islands": TYPE_ISLANDS,
    "gap_clusters": GAP_CLUSTERS,
    "row_windows": ROW_WINDOWS,
    "first_seen_numbers": FIRST_SEEN,
    "guarded_intervals": GUARDED,
    "speech_pieces": SPEECH,
    "filled_values": FILLED,
    "point_in_range": POINT,
    "overlap_assign": OVERLAP,
    "nearest_mark": NEAREST,
    "context_windows": CONTEXT,
    "halo_batches": HALO,
    "role_chunks": CHUNKS,
}
