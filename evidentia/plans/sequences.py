"""Queries of regions, loose payloads and sequential rules, with SQL where it can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import payloads
from evidentia.operators import folds, regions
from evidentia.plans.timelines import _E, KEYS, ORDER, _events
from evidentia.sources.session import table


def box_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed boxes of each user's events, whose values place them."""
    rows = _events(spark, sf_dir).withColumns({"x1": F.round("value"), "y1": (F.col("event_id") % 37).cast("double")})
    rows = rows.withColumns({"x2": F.col("x1") + 20, "y2": F.col("y1") + 30})
    return regions.box_epochs(rows, KEYS, "sec", ORDER, ["x1", "y1", "x2", "y2"], 86400.0, 40.0, 0.9, 4, 200, 60).drop("start_at", "end_at")


BOX_EPOCHS = f"""
with {_E}, b as (select *, round(value) x1, (event_id % 37)::double y1 from e),
l as (select *, lag(sec) over w ls, lag(x1) over w lx, lag(y1) over w ly from b window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(case when sec - ls <= 86400 and greatest(abs(x1 - lx), abs(y1 - ly)) <= 40 then 0 else 1 end) over (partition by user_id order by ts, event_id) - 1 epoch from l),
q as (select user_id, epoch::bigint epoch, greatest(0, floor(round(quantile_cont(x1, 1 - 0.9::double), 6))::bigint - 4) "left", greatest(0, floor(round(quantile_cont(y1, 1 - 0.9::double), 6))::bigint - 4) top,
  least(200, ceil(round(quantile_cont(x1 + 20, 0.9), 6))::bigint + 4) "right", least(60, ceil(round(quantile_cont(y1 + 30, 0.9), 6))::bigint + 4) bottom from i group by all)
select * from q where "right" > "left" and bottom > top"""


def covered_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that an order's lines cover together, each a box."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"x": (F.col("l_linenumber") * 3).cast("double"), "y": (F.col("l_partkey") % 10).cast("double")})
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("l_quantity").cast("int") % 7 + 1).alias("x2"), (F.col("y") + F.col("l_suppkey") % 6 + 1).alias("y2"))
    own = lines.groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return own.select("l_orderkey", F.size("boxes").alias("n"), regions.union_area(F.col("boxes")).alias("area"))


COVERED = """
with b as (select l_orderkey, (l_linenumber * 3)::int x, (l_partkey % 10)::int y, (l_quantity::int % 7 + 1)::int w, (l_suppkey % 6 + 1)::int h from lineitem),
c as (select distinct l_orderkey, x, unnest(range(y, y + h)) y from (select l_orderkey, unnest(range(x, x + w)) x, y, h from b)), a as (select l_orderkey, count(*)::double area from c group by 1)
select l_orderkey, n, area from (select l_orderkey, count(*) n from b group by 1) join a using (l_orderkey)"""


def window_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of each user's windows of ten events by how far their values move."""
    by = Window.partitionBy(*KEYS).orderBy(*ORDER)
    rows = _events(spark, sf_dir).withColumns({"nr": F.floor((F.row_number().over(by) - 1) / 10).cast("long"), "move": F.abs(F.col("value") - F.lag("value").over(by))})
    share = lambda most: F.count_if(F.col("move") > most) / F.count("*")
    rows = rows.groupBy(*KEYS, "nr").agg(share(60).alias("motion"), share(120).alias("strong"), F.coalesce(F.percentile("move", F.lit(0.5)) / 6000, F.lit(0.0)).alias("changed"), share(30).alias("active"))
    kind, sure = regions.window_kind(*[F.col(c) for c in ("motion", "strong", "changed", "active")])
    return rows.select(*KEYS, "nr", kind.alias("kind"), sure.alias("confidence"))


WINDOW_KINDS = f"""
with {_E}, m as (select user_id, (row_number() over w - 1) // 10 nr, abs(value - lag(value) over w) move from e window w as (partition by user_id order by ts, event_id)),
s as (select user_id, nr, count(*) filter (move > 60) / count(*) motion, count(*) filter (move > 120) / count(*) strong, coalesce(quantile_cont(move, 0.5) / 6000, 0) changed, count(*) filter (move > 30) / count(*) active from m group by all)
select user_id, nr, case when motion >= 0.42 or strong >= 0.18 or changed >= 0.006 then 'video' when motion <= 0.18 and changed <= 0.003 then 'slide' when motion >= 0.18::double + 0.08::double or active >= 0.25 then 'video' else 'unknown' end kind,
  round(round(case when motion >= 0.42 or strong >= 0.18 or changed >= 0.006 then least(0.98, greatest(0.62, 0.72 + greatest(motion - 0.42, strong - 0.18, (changed - 0.006) / 0.006) * 0.35))
    when motion <= 0.18 and changed <= 0.003 then least(0.98, greatest(0.58, 0.74 + least(0.18 - motion, (0.003 - changed) / 0.003) * 0.45)) when motion >= 0.18::double + 0.08::double or active >= 0.25 then 0.6 else 0.45 end::double, 9), 6) confidence from s"""


def presence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reveals and covers among a user's events, a value's thousandth as the presence."""
    by = Window.partitionBy(*KEYS).orderBy(*ORDER)
    rows = _events(spark, sf_dir).withColumns({"before": F.lag("value").over(by) / 1000, "after": F.col("value") / 1000, "kind": F.lag("event_type").over(by)})
    told = regions.presence_change(F.col("before"), F.col("after"), F.col("event_id") % 3 != 0, F.col("event_type") != F.col("kind"))
    return rows.select("event_id", told.alias("change"))


PRESENCE = f"""
with {_E}, p as (select event_id, event_type, value / 1000 a, lag(value) over w / 1000 b, lag(event_type) over w kind from e window w as (partition by user_id order by ts, event_id))
select event_id, case when event_id % 3 = 0 or event_type = kind or kind is null then null when round(a - b, 9) <= -0.05 and b >= 0.03 and a <= greatest(0.01, b * 0.35) then 'person_reveal'
  when round(a - b, 9) >= 0.05 and a >= 0.03 and b <= greatest(0.01, a * 0.35) then 'person_cover' end change from p"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' JSON of each labelled document brought to one form."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = F.when(F.col("quality") == 1, " valid_issue ").when(F.col("toxic") == 1, "no idea")
    payload = F.to_json(F.struct(said.alias("judgment"), (F.col("n_chars") / 5000).alias("is_valid_issue"), F.when(F.col("toxic") == 1, "high").otherwise("0.8").alias("category_severity"), ((F.col("doc_id") % 10) / 10).alias("context_resolution"), F.col("lang").alias("reason")))
    return rows.select("doc_id", payloads.judgment(payload).alias("j")).select("doc_id", "j.*")


JUDGMENTS = """
with v as (select doc_id, lang, case when quality = 1 then 'valid_issue' else 'insufficient_context' end judgment, round(least(1, n_chars / 5000), 6) valid, case when toxic = 1 then 0.0 else 0.8 end::double severity, round(1 - (doc_id % 10) / 10, 6) unresolved from documents join labels using (doc_id))
select doc_id, judgment, valid, severity, unresolved, round(valid * severity * unresolved, 6) score, coalesce(lang, '') reason from v"""


def evidence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages from answers in several forms, one row each: pages as the evidence, whole html as the quote."""
    rows = table(spark, sf_dir, "pages")
    said = lambda name: F.to_json(F.struct(F.col("url").alias("source_url"), F.col("html").alias(name), F.when(F.col("page_id") % 3 == 0, "supports_issue").otherwise("maybe").alias("status")))
    # Back quotes of the pages are written as escapes, so that they aren't taken for fences.
    own = lambda name: F.replace(said(name), F.lit("`"), F.lit(r"\u0060"))
    fence = lambda c: F.concat(F.lit("Here:\n```json\n"), c, F.lit("\n```"))
    listed = F.concat(F.lit("["), own("paragraph"), F.lit(', {"id": "own", "sentence": "s"}]'))
    payload = F.when(F.col("page_id") % 4 == 0, own("text")).when(F.col("page_id") % 4 == 1, fence(listed)).when(F.col("page_id") % 4 == 2, listed).otherwise("no json")
    rows = rows.select("page_id", F.explode(payloads.passages(payload)).alias("p"))
    return rows.select("page_id", "p.id", "p.url", F.md5(F.col("p.quote").cast("binary")).alias("quote_md5"), "p.key_sentence", "p.stance")


PASSAGES = r"""
with p as (select page_id, url, md5(trim(html, ' ')) quote_md5, case when page_id % 3 = 0 then 'supports_issue' else 'insufficient_evidence' end stance from pages)
select page_id, 'E1' id, url, quote_md5, '' key_sentence, stance from p where page_id % 4 < 3 union all select page_id, 'own', '', md5(''), 's', 'insufficient_evidence' from p where page_id % 4 in (1, 2)"""


def answer_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that a fenced answer holds for each conversation's turns; the last of an index counts."""
    row = F.struct(F.when(F.col("turn") % 5 != 4, (F.col("turn") / 2).cast("int")).alias("index"), F.when(F.col("role") == "user", F.length("text").cast("string")).otherwise("").alias("text"), F.upper("role").alias("decision"))
    answers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))).alias("rows"))
    payload = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("rows", lambda x: x["r"]).alias("corrections"))), F.lit("\n```"))
    return answers.select("conv_id", F.explode(payloads.corrections(payload)).alias("c")).select("conv_id", "c.*")


CORRECTIONS = """
select conv_id, turn // 2 "index", arg_max(length(text)::varchar, turn) "text", 'user' decision from conversations where turn % 5 <> 4 and role = 'user' and text is not null group by all"""


def pair_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results on pairs of lines: of neighbouring pairs the one most preferred stays, others pass."""
    merge, decision = F.col("l_quantity") > 25, F.element_at(F.array(*[F.lit(x) for x in ("same_slide_build", "same_slide_duplicate", "different_slide", "uncertain", "none")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    asked = F.when(F.col("l_returnflag") == "R", "same_slide_build").when(F.col("l_returnflag") == "A", "same_slide_duplicate").otherwise("transition")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_linenumber") / 2).cast("int").alias("scene"), (F.col("l_suppkey") % 3).cast("int").alias("step"), payloads.pair_rank(asked, decision, merge).alias("rank"))
    by = Window.partitionBy("l_orderkey", "scene", "step").orderBy(F.desc("rank"), F.desc("l_discount"), "l_linenumber")
    rows = rows.withColumn("place", F.row_number().over(by)).filter((F.col("step") != 1) | (F.col("place") == 1))
    status = F.element_at(F.array(*[F.lit(x) for x in ("supports_issue", "refutes_issue", "none")]), (F.col("rank") % 3 + 1).cast("int"))
    verdict, holds = payloads.directional(status)
    return rows.select("l_orderkey", "l_linenumber", "rank", verdict.alias("verdict"), holds.alias("holds"))


CONSOLIDATION = """
with a as (select *, l_linenumber // 2 scene, l_suppkey % 3 step, l_quantity > 25 m, l_partkey % 5 d from lineitem),
b as (select *, case when m and d = 0 and l_returnflag = 'R' then 6 when m and d = 1 and l_returnflag = 'A' then 5 when m and d = 0 then 4 when m and d = 1 then 3 when d = 2 then 2 when d = 3 then 1 else 0 end rank from a),
c as (select *, row_number() over (partition by l_orderkey, scene, step order by rank desc, l_discount desc, l_linenumber) place from b)
select l_orderkey, l_linenumber, rank, case rank % 3 when 0 then 'claim_false' when 1 then 'claim_true' end verdict, case rank % 3 when 0 then true when 1 then false end holds from c where step <> 1 or place = 1"""


def payload_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times in events' loose JSON: texts, booleans and broken JSON give none."""
    value = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).when(F.col("event_id") % 4 == 2, "true").otherwise("{")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    payload = F.concat(F.lit('{"a": '), value, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", payloads.loose_number(payload, "$.a").alias("a"), payloads.loose_number(F.col("props"), "$.k").alias("k"), F.date_format(payloads.loose_time(stamp), "yyyy-MM-dd HH:mm:ss").alias("said_at"))


NUMBERS = """
select event_id, case when event_id % 4 = 0 then value end a, case when json_type(props::json, '$.k') in ('BIGINT', 'UBIGINT', 'DOUBLE') then json_extract_string(props::json, '$.k')::double end k, case when event_id % 2 = 0 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end said_at from events"""


def edit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span edits from one change of each document: its third word becomes its first in capitals, at one or all places."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.split("text", " "))
    rows = rows.withColumns({"said": F.coalesce(F.get("w", F.lit(2)), F.lit("")), "new": F.upper(F.get("w", F.lit(0)))})
    nth = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 3).cast("int"))
    made = payloads.edits(F.col("text"), F.col("said"), F.col("new"), nth, F.when(F.col("doc_id") % 5 == 0, F.upper(F.substring("text", 1, 4))))
    spans = F.array_join(F.transform(made, lambda e: F.concat_ws(":", e["start"], e["end"])), ",")
    return rows.select("doc_id", F.size(made).alias("n"), F.md5(spans.cast("binary")).alias("spans_md5"))


_BARE = r"regexp_replace({0}, '[\s.,;:!?。．，、…]+', '', 'g')"
EDITS = rf"""
with w as (select doc_id, coalesce(text, '') text, string_split(coalesce(text, ''), ' ') w from documents), d as (select doc_id, text, coalesce(w[3], '') said, upper(w[1]) "new" from w),
f as (select *, len(said) > 0 and len("new") > 0 and {_BARE.format("said")} <> {_BARE.format('"new"')} and (doc_id % 5 <> 0 or contains(upper(text[:4]), "new")) fine from d),
p as (select doc_id, said, list_transform(string_split(text, said), lambda x: length(x)) p from f where fine),
s as (select doc_id, said, list_transform(range(1, len(p)), lambda i: coalesce(list_sum(p[:i]), 0)::bigint + (i - 1) * length(said)) s from p),
c as (select doc_id, said, case when doc_id % 3 = 0 or len(s) = 1 then s when len(s) >= doc_id % 3 then [s[doc_id % 3]] else [] end s from s)
select f.doc_id, coalesce(len(s), 0) n, md5(coalesce(array_to_string(list_transform(s, lambda x: x::varchar || ':' || (x + length(c.said))::varchar), ','), '')) spans_md5 from f left join c using (doc_id)"""


def limited_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events in contexts: sign-ups end them, from the third event on clicks do, at the fifth with a look at three more."""
    rows = _events(spark, sf_dir).withColumns({"cut": F.col("event_type") == "signup", "natural": F.col("event_type") == "click"})
    return folds.limited_contexts(rows, KEYS, ORDER, "cut", "natural", 3, 5, 3).select(*KEYS, "event_id", "context")


LIMITED = f"""
with recursive {_E}, o as (select *, row_number() over w rn, event_type = 'signup' cut, event_type = 'click' nat, lead(event_id) over w is null final from e window w as (partition by user_id order by ts, event_id)),
r as (select *, coalesce(bool_or((cut or nat) and not final) over (partition by user_id order by rn rows between 1 following and 3 following), false) ahead from o),
f as (select user_id, rn, event_id, 0 context, case when cut then 1 else 0 end nxt, case when cut then 0 else 1 end size, false wait from r where rn = 1
  union all select user_id, rn, event_id, nxt, nxt + ends::int, case when ends then 0 else size + 1 end, not ends and (wait or size + 1 >= 5)
  from (select r.*, f.nxt, f.size, f.wait, r.cut or (r.nat and f.size + 1 >= 3) or (not f.wait and f.size + 1 >= 5 and not r.ahead) ends from f join r on r.user_id = f.user_id and r.rn = f.rn + 1))
select user_id, event_id, context from f"""


def carried_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed with the images around them, two images carried on; every seventh turn is alone."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(*[(F.col("turn") / 2 + k).cast("int").cast("string") for k in range(3)]).alias("images"), (F.col("turn") % 7 == 6).alias("alone"))
    return folds.carried_batches(rows.withColumn("item", F.col("turn")), ["conv_id"], ["turn"], "item", "images", "alone", 6, 4, 2)


def tracked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as boxes of frames, followed by overlap."""
    by = Window.partitionBy(*KEYS).orderBy(*ORDER)
    rows = _events(spark, sf_dir).withColumns({"frame": F.floor((F.row_number().over(by) - 1) / 2).cast("long"), "box": F.array(F.col("value"), F.lit(0.0), F.col("value") + 30, F.lit(30.0)), "moved": F.col("event_type") == "error"})
    return folds.tracked_boxes(rows, KEYS, "frame", "box", "moved", 0.3, 8.0, 0.5, 3)


def frame_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of writing on the vectors of each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("frame"))
    return folds.captures(rows, ["label"], "vec_id", "frame", 0.2, 0.2, 0.25, 0.34, 1, 2, 2, 0.1)


def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of scene over the vectors of each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("frame"))
    return folds.scene_changes(rows, ["label"], "vec_id", "frame", 0.034, 0.031, 0.035, 3, 1)


SPACED = f"""
with recursive {_E}, r as (select user_id, sec, event_id, row_number() over (partition by user_id order by sec, event_id) rn from e),
f as (select *, sec seen, true keep from r where rn = 1 union all select r.*, case when round(r.sec - f.seen, 9) > 86400 then r.sec else f.seen end, round(r.sec - f.seen, 9) > 86400 from f join r on r.user_id = f.user_id and r.rn = f.rn + 1)
select user_id, sec, event_id from f where keep"""
PACKED = """
with recursive r as (select conv_id, turn, 1.0::double one, coalesce(length(text), 0)::double chars, length(text)::double said, row_number() over (partition by conv_id order by turn) rn from conversations),
f as (select *, 0 batch, one a, chars b from r where rn = 1 union all
  select r.*, case when f.a + r.one > 3 or f.b + r.chars > 500 then f.batch + 1 else f.batch end, case when f.a + r.one > 3 or f.b + r.chars > 500 then r.one else f.a + r.one end, case when f.a + r.one > 3 or f.b + r.chars > 500 then r.chars else f.b + r.chars end
  from f join r on r.conv_id = f.conv_id and r.rn = f.rn + 1)
select conv_id, turn, one, said chars, batch from f"""
CONTEXT_GROUPS = r"""
with recursive r as (select conv_id, turn, length(text) chars, coalesce(length(text), 0) size, regexp_matches(text, '[.!?]\s*$') ends, row_number() over (partition by conv_id order by turn) rn from conversations),
s as (select *, 0::bigint nr, size::bigint held, coalesce(ends and size >= 200, false) cut from r where rn = 1 union all
  select conv_id, turn, chars, size, ends, rn, nr, held, coalesce(ends and held >= 200, false) from (select r.*, (case when s.cut or (s.held > 0 and s.held + r.size > 600) then s.nr + 1 else s.nr end)::bigint nr, (case when s.cut or s.held + r.size > 600 then r.size else s.held + r.size end)::bigint held from s join r on r.conv_id = s.conv_id and r.rn = s.rn + 1))
select conv_id, turn, chars, ends, nr context from s"""
EPISODES = f"""
with recursive {_E}, r as (select user_id, event_id, value, row_number() over (partition by user_id order by sec, event_id) rn from e),
f as (select *, (value >= 60)::int ep, value >= 60 own, value >= 60 open from r where rn = 1 union all
  select r.*, f.ep + (not f.open and r.value >= 60)::int, f.open or r.value >= 60, case when f.open then r.value > 5 else r.value >= 60 end from f join r on r.user_id = f.user_id and r.rn = f.rn + 1)
select user_id, arg_min(event_id, rn) start_at, arg_max(event_id, rn) end_at, max(value) peak, count(*) n from f where own group by user_id, ep"""

ORACLES = {
    "box_epochs": BOX_EPOCHS,
    "covered_areas": COVERED,
    "window_kinds": WINDOW_KINDS,
    "presence_changes": PRESENCE,
    "judgments": JUDGMENTS,
    "evidence_passages": PASSAGES,
    "answer_corrections": CORRECTIONS,
    "pair_consolidation": CONSOLIDATION,
    "payload_numbers": NUMBERS,
    "edit_spans": EDITS,
    "limited_contexts": LIMITED,
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "carried_batches", "tracked_boxes", "frame_captures", "scene_changes")}
#: SQL of queries that stand in ``timelines``.
ORACLES |= {"spaced_events": SPACED, "packed_batches": PACKED, "context_groups": CONTEXT_GROUPS, "writing_episodes": EPISODES}
