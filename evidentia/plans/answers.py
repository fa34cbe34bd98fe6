"""Queries of assessments, kept evidence, stage times and changes of frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import timings
from evidentia.operators import answers
from evidentia.sources.session import table

KINDS = ("view", "click", "signup", "purchase", "error")
LIMITS = timings.ChangeLimits(cut=0.033, cut_hash=33, base=0.034, base_share=0.42, strong_share=0.5, base_hash=36, fade=0.032, fade_hash=34)


def kept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sources of their order, assessed by a JSON answer an order (fourth ones are left out, the first is told twice)."""
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    source = F.concat_ws("-", F.lit("S"), n, "l_partkey", "l_suppkey")
    said = F.when(F.col("l_returnflag") == "A", "supports_claim").when(F.col("l_returnflag") == "R", " Contradicts_Claim").otherwise("maybe")
    row = F.struct(source.alias("source_id"), said.alias("relation"), (F.col("l_tax") * 12).cast("string").alias("confidence"))
    again = F.struct(F.get("rows", F.lit(0))["source_id"].alias("source_id"), F.lit("irrelevant").alias("relation"), F.lit("1").alias("confidence"))
    told = lines.filter(n != 4).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    told = told.select("l_orderkey", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat("rows", F.array(again)).alias("assessments"))), F.lit("\n```")).alias("payload"))
    excerpts = lines.select("l_orderkey", source.alias("source"), (F.col("l_linestatus") == "F").alias("strong"), (F.col("l_partkey") % 4).cast("int").alias("priority"), F.col("l_suppkey").cast("string").alias("url"))
    kept = answers.kept_evidence(answers.assessed(excerpts, told, ["l_orderkey"], "source", "payload"), "l_orderkey", "source", "strong", "priority", "url", 0.3, 3)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["place"], e["source"], e["relation"])), ",")
    return kept.select("l_orderkey", "status", "mixed", F.coalesce(shown, F.lit("")).alias("shown"))


KEPT = """
with r as (select l_orderkey, 'S-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey s, case when l_linenumber = 4 then 'irrelevant' when l_returnflag = 'A' then 'supports_claim' when l_returnflag = 'R' then 'contradicts_claim' else 'irrelevant' end relation,
    round(least(1, l_tax * 12), 4) c, l_linestatus = 'F' strong, coalesce(nullif((l_partkey % 4)::int, 0), 99) p, l_suppkey::varchar url from lineitem),
k as (select *, row_number() over (partition by l_orderkey order by strong desc, p, c desc, url, s) place from r where relation <> 'irrelevant' and c >= 0.3),
e as (select l_orderkey, string_agg(place || ':' || s || ':' || relation, ',' order by place) filter (place <= 3) shown, count(distinct relation) > 1 mixed from k group by 1)
select l_orderkey, case when shown is null then 'insufficient_evidence' else 'verified' end status, coalesce(mixed, false) mixed, coalesce(shown, '') shown from (select distinct l_orderkey from lineitem) left join e using (l_orderkey)"""


def search_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches told of in nested answers made of every page."""
    found = F.struct(F.lit("hit").alias("type"), F.col("url").alias("source_url"), F.lit("ftp://none").alias("URL"))
    call = lambda kind, query: F.struct(F.lit(kind).alias("type"), query.alias("Search_Query"), F.array(found).alias("results"))
    own = F.col("page_id").cast("string")
    payload = F.to_json(F.struct(call("x_WEB_SEARCH_y", own).alias("a"), F.array(call("search_call", F.concat(F.lit(" "), own)), call("message", F.lit(""))).alias("b")))
    rows = table(spark, sf_dir, "pages").select("page_id", answers.search_traces(F.when(F.col("page_id") % 9 == 0, "no json").otherwise(payload)).alias("t"))
    return rows.select("page_id", "t.calls", F.array_join("t.queries", ",").alias("queries"), F.array_join("t.urls", ",").alias("urls"))


TRACES = r"""
select page_id, case when page_id % 9 = 0 then 0 else 2 end calls, case when page_id % 9 = 0 then '' else page_id::varchar end queries,
  case when page_id % 9 <> 0 and regexp_matches(trim(url), '^https?://') then trim(url) else '' end urls from pages"""


def lecture_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of both phases for each user: kinds of events as stages, errors as runs, sign-ups as the roll-up."""
    names = {"view": "P1 audio total", "click": "P1A part", "purchase": "V1 input", "error": "V2B judge", "signup": "V2 run_verifier"}
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    rows = table(spark, sf_dir, "events").filter(name.isNotNull()).groupBy("user_id", name.alias("name")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("s"))
    late = F.col("user_id") % 2 == 1
    rows = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.when(~(late & F.col("name").rlike("^V(1|2B)")), F.struct("name", "s")))).alias("times"), F.max("s").alias("most"))
    runs = F.when(F.col("user_id") % 3 == 0, F.array("most", F.lit(0.0), F.lit(None).cast("double")))
    return rows.select("user_id", timings.stage_seconds(F.col("times"), runs, F.when(F.col("user_id") % 3 == 1, 77.0)).alias("t")).select("user_id", "t.*")


SECONDS = """
with s as (select user_id, event_type, sum(value::decimal(18, 2))::double s from events where event_type in ('view', 'click', 'purchase', 'error', 'signup') group by all),
u as (select user_id, max(s) most, coalesce(sum(s) filter (event_type = 'view'), 0) f, coalesce(sum(s) filter (event_type = 'purchase'), 0) + coalesce(sum(s) filter (event_type = 'error'), 0) v, coalesce(sum(s) filter (event_type = 'signup'), 0) r from s group by 1),
w as (select *, case when user_id % 2 = 1 or v = 0 then r else v end w from u)
select user_id, nullif(round(f, 3), 0) "first", nullif(round(w, 3), 0) "second", nullif(round(case when user_id % 3 = 0 then coalesce(nullif(most, 0), f + w) when user_id % 3 = 1 then 77 else f + w end, 3), 0) total from w"""


def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each supplier by verdict and kind, finished ones counted as composite ones too."""
    lines = table(spark, sf_dir, "lineitem")
    bucket = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected")
    items = lines.select("l_suppkey", bucket.alias("bucket"), F.concat(F.lit("k"), F.col("l_linenumber")).alias("kind"))
    finished = lines.groupBy("l_suppkey", F.lit("review").alias("bucket")).agg(F.count_if(F.col("l_linestatus") == "F").alias("n"))
    return answers.breakdown(items, finished, ["l_suppkey"], "bucket", "kind", ["k1", "k2", "k3", "k4", "k5"], "composite")


BREAKDOWN = """
select l_suppkey, case l_returnflag when 'A' then 'confirmed' else 'rejected' end bucket, 'k' || l_linenumber kind, count(*) n from lineitem where l_returnflag in ('A', 'R') and l_linenumber between 1 and 5 group by all
union all select l_suppkey, 'review', 'composite', count(*) from lineitem where l_linestatus = 'F' group by 1"""


def type_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events in order, and the user with most of them a day."""
    view = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), *[F.count_if(F.col("event_type") == k).alias(k) for k in KINDS])
    one = answers.comparison(view, "user_id", "days", KINDS)
    ranked = timings.leading_types(F.col("totals"), KINDS)
    return one.select(F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["type"], x["n"])), ",").alias("ranked"), "most_label", "most_mean")


COMPARISON = """
with u as (select user_id, count(*) filter (event_type in ('view', 'click', 'signup', 'purchase', 'error')) / count(distinct ts::date) m from events group by 1),
k as (select event_type, count(*) n, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) p from events where event_type in ('view', 'click', 'signup', 'purchase', 'error') group by 1)
select (select string_agg(event_type || ':' || n, ',' order by n desc, p) from k) ranked, (select user_id from u order by m desc, user_id limit 1) most_label, (select round(max(m), 6) from u) most_mean"""


def duration_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a minute over order statuses: prices as phases, quantities as lengths."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        *[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(n) for c, n in (("l_tax", "first"), ("l_discount", "second"), ("l_quantity", "minutes"))]
    )
    return answers.trend(rows, "first", "second", "minutes")


TREND = """
with g as (select sum(l_tax::decimal(18, 2))::double f, sum(l_discount::decimal(18, 2))::double s, sum(l_quantity::decimal(18, 2))::double m from lineitem group by l_returnflag, l_linestatus)
select round((sum(f) + sum(s)) / sum(m) * 60, 6) seconds_a_minute, round(max(f) - min(f), 6) first_gap, round(max(s) - min(s), 6) second_gap from g"""


def slide_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a vector begins something new beside the one before, its label's first one and the fifth before."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    by = Window.partitionBy("label").orderBy("vec_id")
    bases = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    rows = rows.withColumns({"previous": F.lag("embedding").over(by), "oldest": F.lag("embedding", 5).over(by)}).join(bases, "label")
    gap = {c: answers.difference(F.col(c), F.col("embedding"), 0.2) for c in ("previous", "base", "oldest")}
    rows = rows.select("label", "vec_id", *[d.alias(c) for c, d in gap.items()])
    reason = timings.change_reason(F.col("previous.square") < 0.02, F.col("previous"), F.col("base"), F.col("oldest"), LIMITS)
    return rows.select("label", "vec_id", reason.alias("reason"), F.col("previous.bits").alias("bits"))


def _gap(c: str) -> str:
    z = f"list_zip({c}, embedding)"
    return f"""list_sum(list_transform({z}, lambda t: (t[1]::double - t[2]) * (t[1]::double - t[2]))) / len(embedding) {c}_q,
  len(list_filter({z}, lambda t: abs(t[1]::double - t[2]) >= 0.2)) / len(embedding) {c}_s, len(list_filter({z}, lambda t: (t[1] > 0) <> (t[2] > 0))) {c}_b"""


CHANGES = f"""
with r as (select label, vec_id, embedding, lag(embedding) over w p, lag(embedding, 5) over w o, first_value(embedding) over w b from embeddings window w as (partition by label order by vec_id)),
d as (select label, vec_id, {_gap("p")}, {_gap("b")}, {_gap("o")}, p is not null hp, o is not null ho from r)
select label, vec_id, case when coalesce(hp and p_q < 0.02, false) then null when hp and p_q >= 0.033 and p_b >= 33 then 'cut'
  when (b_q >= 0.034 and b_s >= 0.42) or (b_s >= 0.5 and b_b >= 18) then 'structure' when hp and b_b >= 36 and p_q >= 0.0165 then 'base' when ho and o_q >= 0.032 and o_b >= 34 then 'fade' end reason, case when hp then p_b end bits from d"""


def shown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the files of a candidate, whose kind is the order's status."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("scenes"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "same_slide_build").when(F.col("o_orderstatus") == "O", "same_slide_duplicate").otherwise("transition_noise")
    files = F.transform("scenes", lambda s: F.concat(F.lit("f"), s.cast("string")))
    before = F.when(F.col("o_orderkey") % 3 == 0, "old").when(F.col("o_orderkey") % 3 == 1, "")
    shown = timings.shown_files(kind, files, F.col("scenes"), F.array(F.lit(4)), before, F.when(F.col("o_orderkey") % 5 == 0, "f1"))
    return rows.select("o_orderkey", F.array_join(shown, ",").alias("shown"))


SHOWN = """
with l as (select l_orderkey o_orderkey, list_sort(list(distinct l_linenumber::int)) s from lineitem group by 1), r as (select o_orderkey, o_orderstatus k, s, list_transform(s, lambda x: 'f' || x) f, len(s) n, list_position(s, 4) p from orders join l using (o_orderkey)),
e as (select *, case when o_orderkey % 3 = 0 then 'old' else f[1] end a, case when o_orderkey % 5 = 0 then 'f1' else f[n] end z from r), g as (select *, list_filter(f, lambda x: x <> a) more from e)
select o_orderkey, array_to_string(case when k = 'F' then case when a <> z then [a, z] else ([a] || more)[:2] end when n <= 2 then f when k = 'O' then case when n > 3 then [f[1], f[n // 2 + 1], f[n]] else f end
  when p > 0 then f[greatest(p - 1, 1):least(p + 1, n)] else f[1:3] end, ',') shown from g"""


QUERIES = {
    "kept_evidence": kept_evidence,
    "search_traces": search_traces,
    "lecture_seconds": lecture_seconds,
    "type_breakdown": type_breakdown,
    "type_comparison": type_comparison,
    "duration_trend": duration_trend,
    "slide_changes": slide_changes,
    "shown_files": shown_files,
}
ORACLES = {
    "kept_evidence": KEPT,
    "search_traces": TRACES,
    "lecture_seconds": SECONDS,
    "type_breakdown": BREAKDOWN,
    "type_comparison": COMPARISON,
    "duration_trend": TREND,
    "slide_changes": CHANGES,
    "shown_files": SHOWN,
}
