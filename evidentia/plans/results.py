"""Queries over results: views, bundles, lookups, decision lists, set operations and statistics rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import results
from evidentia.sources.session import table

LABELS = {"click": "Click", "view": "Page view", "error": "Fault"}
_SEC = "cast(unix_micros(cast(ts as timestamp)) as double) / 1000000"
_SEC_SQL = "epoch_us(ts)::double / 1000000"


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its lines as one list."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_partkey").alias("part"))
    out = results.with_children(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "l_linenumber", ["quantity", "part"], "lines")
    said = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["part"], x["quantity"]))
    return out.select("o_orderkey", "o_orderstatus", F.size("lines").alias("n_lines"), F.array_join(said, ",").alias("lines"))


def slide_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title and language for each id: a page's url goes before a document's source, empty values never do."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("title"), F.lit(None).cast("string").alias("lang"))
    return results.overriding([docs, pages], "id", ["title", "lang"])


def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered within their conversation, with an id made up where none is given."""
    rows = table(spark, sf_dir, "conversations").withColumn("given", F.when(F.col("turn") % 3 == 1, F.concat("role", F.lit("-"), "turn")).when(F.col("turn") % 3 == 2, F.lit(" ")))
    return results.numbered_contexts(rows, "conv_id", ["turn", "role"], "given", "context_id").select("conv_id", "turn", "context_index", "context_id")


def context_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the lengths of the turns around it and its conversation's size."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("string").alias("chars"))
    slides = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    out = results.bundled(rows.filter("role = 'user'").select("conv_id", "turn"), slides, rows, "conv_id", "turn", "chars", 2)
    return out.select("conv_id", "turn", "turns", F.array_join(F.transform("window", lambda x: F.concat_ws(":", x["_at"], x["_text"])), ",").alias("around"))


def adjacent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days before and after each day on which a user has events."""
    return results.neighbours(table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day")), "user_id", "day")


def evidence_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one normalised text share the evidence of the first of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return results.shared_evidence(docs, F.md5(text.compact(F.coalesce("text", F.lit(""))).cast("binary")), "doc_id").select("doc_id", "evidence_of", "group_size")


def verification_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue types with their confirmed, reviewed and rejected issues and shares."""
    status = results.first_match([("rejected", F.col("value") < 5), ("review", F.col("value") < 20)], "confirmed")
    rows = table(spark, sf_dir, "events").withColumn("status", status)
    return rows.groupBy(results.labelled(F.col("event_type"), LABELS).alias("type")).agg(
        F.count("*").alias("issues"), *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "review", "rejected")], F.round(F.count_if(F.col("status") == "confirmed") / F.count("*"), 6).alias("share")
    )


def slim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' short records as JSON without empty fields."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "good").otherwise("").alias("verdict"), F.when(F.col("toxic") == 1, "toxic").alias("flag"))
    return rows.select("doc_id", results.compact_json(["lang", "source", "verdict", "flag"]).alias("issue"))


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width order records with fallbacks and defaults."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(sums, "o_orderkey", "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.lit("unknown")).alias("owner"),
        F.coalesce("c_mktsegment", F.lit("etc")).alias("domain"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
        F.lower("o_orderstatus").alias("status"),
        F.coalesce("n", F.lit(0)).alias("issue_count"),
        F.coalesce("returned", F.lit(0)).alias("rejected_count"),
        F.nvl2("n", F.lit(True), F.lit(False)).alias("complete"),
        F.round("o_totalprice", 2).alias("total"),
    )


def next_stage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items of the next stage: place and context as nested records, read back by path."""
    rows = table(spark, sf_dir, "conversations")
    rows = rows.select(F.struct(F.col("conv_id").alias("slide_number"), F.col("turn").alias("place")).alias("location"), F.struct("role", F.length("text").alias("chars")).alias("context"))
    return rows.select("location.slide_number", "location.place", "context.role", "context.chars")


def flat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five events of a user as one row: first and last bounds, means."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("segment", F.floor((F.row_number().over(by) - 1) / 5).cast("long")).withColumn("place", F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "segment").agg(
        F.min_by("event_type", "place").alias("first_type"), F.max_by("event_type", "place").alias("last_type"), F.min("event_id").alias("least_id"), F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n")
    )


def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors of a label: relaxed prefilter, strict decision, veto, and the reason."""
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, sf_dir, "embeddings").withColumn("other", after).filter("other is not null")
    gap = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    size = F.size("embedding")
    rows = rows.select("vec_id", F.round(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) / size, 4).alias("mean_gap"), F.round(F.array_max(gap), 4).alias("most"), F.round(F.size(F.filter(gap, lambda x: x > 1)) / size, 4).alias("changed"))
    maybe = (F.col("mean_gap") < 1.2) | (F.col("changed") < 0.5) | (F.col("most") < 2.5)
    reason = results.first_match([("near_identical", F.col("mean_gap") < 0.05), ("veto", F.col("most") > 4), ("content", (F.col("changed") < 0.45) & (F.col("mean_gap") < 1.1)), ("prefilter_only", maybe)], "different")
    return rows.select("vec_id", "mean_gap", "changed", maybe.alias("maybe"), reason.alias("reason"), reason.isin("near_identical", "content").alias("duplicate"))


def transition_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a user's event is a change against the one before and the first one; the first rule that holds."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumns({"before": F.lag("value").over(by), "base": F.first("value").over(by), "kind": F.lag("event_type").over(by)})
    step, away = F.abs(F.col("value") - F.col("before")), F.abs(F.col("value") - F.col("base"))
    reason = results.first_match([("cut", step > 60), ("base_structure", (F.col("kind") != F.col("event_type")) & (away > 40)), ("base_strong_change", away > 50), ("subtle_text_change", (step > 2) & (away < 5)), ("base_diff", away > 20), ("edge_break", step > 30)])
    return rows.select("event_id", reason.alias("reason"))


def long_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as scenes; short ones go unless they hold a purchase, the others are numbered densely."""
    rows = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), F.expr(_SEC).alias("sec"), "event_type")
    scenes = rows.groupBy("user_id", "day").agg(F.min("sec").alias("start_sec"), F.max("sec").alias("end_sec"), F.max(F.when(F.col("event_type") == "purchase", "video").otherwise("slide")).alias("kind"))
    return results.without_short(scenes, "user_id", "day", "start_sec", "end_sec", "kind", 3.0, "video").select("user_id", "day", "kind", "scene_number")


def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's summed times of two stages told by key patterns, zero as null, and the last time that isn't zero."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.round("value").cast("long").alias("took"), F.struct("ts", "event_id").alias("place"))
    keyed = rows.groupBy("user_id", "event_type").agg(F.sum("took").alias("took"), F.max(F.when(F.col("took") > 0, F.struct("place", "took"))).alias("last"))
    total = lambda pattern: F.nullif(F.sum(F.when(F.col("event_type").rlike(pattern), F.col("took")).otherwise(0)), F.lit(0).cast("long"))
    return keyed.groupBy("user_id").agg(total("^(view|click)").alias("preprocess"), total("^(purchase|signup)$").alias("verify"), F.max("last")["took"].alias("last_took"))


def model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by priority as a pivot, with what has none of the named ones."""
    rows = table(spark, sf_dir, "orders").withColumn("kind", F.lower(F.substring("o_orderpriority", 3, 20)))
    out = rows.groupBy(F.col("o_orderstatus").alias("model")).pivot("kind", ["urgent", "high", "medium"]).count().na.fill(0)
    every = rows.groupBy(F.col("o_orderstatus").alias("model")).count().withColumnRenamed("count", "n")
    return out.join(every, "model").withColumn("others", F.col("n") - F.col("urgent") - F.col("high") - F.col("medium"))


def media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of every supplier's account as a duration."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.round("c_acctbal", 2), F.lit(0.0)).alias("duration"))
    return results.chunk_specs(rows, "duration", 1800.0, 30.0).select("c_custkey", "chunk", *[F.round(c, 2).alias(c) for c in ("core_start", "core_end", "start", "end")])


def stitched_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times on a stitched track of each order's lines mapped back to where the lines were cut from."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), (F.col("l_linenumber") * 100.0).alias("lo"), (F.col("l_linenumber") * 100.0 + F.col("l_quantity")).alias("hi"))
    times = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), F.explode(F.array(*[F.lit(x) for x in (0.0, 10.0, 33.5, 5000.0)])).alias("t"))
    return results.stitched_back(times, lines, "track", "t")


def display_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ids that run on over all event types."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return results.running_ids(rows, "event_type", F.to_date("ts"), ["ts", "event_id"], "CL%04d").select("event_id", "display_id")


def preferred_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's preferred event by kind, size and number."""
    rank = F.when(F.col("event_type") == "purchase", 0).when((F.col("event_type") == "click") & (F.col("value") > 20), 1).when(F.col("event_type") == "error", 3).otherwise(2)
    by = Window.partitionBy("user_id").orderBy(rank, F.col("value").desc(), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", rank).withColumn("nr", F.row_number().over(by)).filter("nr = 1").select("user_id", "event_id", "rank")


def representative_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each benchmark text less those that a longer one contains."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.terms(F.col("text")).alias("terms"))
    return rows.select("item_id", F.size("terms").alias("n"), F.array_join(F.array_sort(results.kept_terms(F.col("terms"))), ",").alias("kept"))


def edited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with three span edits, two of which overlap in short texts."""
    edit = lambda a, b, said: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(said).alias("said"))
    said = results.applied_edits(F.coalesce("text", F.lit("")), F.array(edit(0, 2, "<a>"), edit(5, 9, ""), edit(8, 12, "<c>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(said.cast("binary")).alias("digest"))


def issue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as entries of one list with common columns, by size with nulls last."""
    docs = table(spark, sf_dir, "documents").select(F.lit("knowledge").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("lang").alias("category"))
    pages = table(spark, sf_dir, "pages").select(F.lit("slide").alias("kind"), F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.length("html").cast("long")).alias("size"))
    return docs.unionByName(pages, allowMissingColumns=True).orderBy(F.desc_nulls_last("size"), "kind", "id")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each of their several categories, and how many of those are good."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tags = F.array_compact(F.array("lang", F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good")))
    rows = rows.select("doc_id", tags.alias("tags")).withColumn("good", F.array_contains("tags", "good"))
    return rows.select(F.explode("tags").alias("category"), "good").groupBy("category").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))


def set_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by union, intersection and difference of what they did."""
    events = table(spark, sf_dir, "events")
    one, two = (events.filter(F.col("event_type") == k).select("user_id") for k in ("click", "purchase"))
    named = lambda df, name: df.select("user_id", F.lit(name).alias("part"))
    return named(one.union(two).distinct(), "union").unionByName(named(one.intersect(two), "intersect")).unionByName(named(one.exceptAll(two).distinct().subtract(two), "except"))


def profile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation in the order of a settings page: active first, then last used with nulls last."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_used"))
    rows = table(spark, sf_dir, "customer").join(last, "c_custkey", "left").withColumn("active", F.col("c_acctbal") > 5000)
    by = Window.partitionBy("c_nationkey").orderBy(F.desc("active"), F.desc_nulls_last("last_used"), F.desc("c_custkey"))
    return rows.select("c_nationkey", "c_custkey", "active", F.row_number().over(by).alias("place"))


def surface_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose neighbour by id differs in punctuation and white space at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\s\p{P}]+", "").alias("bare"), "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bare").alias("other_bare"), F.col("text").alias("other_text"))
    rows = docs.join(other, "doc_id")
    return rows.select("doc_id", (F.col("bare") == F.col("other_bare")).alias("surface_only"), (F.col("text") == F.col("other_text")).alias("same"))


def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of stages, types and providers with their fallbacks."""
    orders = table(spark, sf_dir, "orders")
    stage = results.first_match([("done", F.col("o_orderstatus") == "F"), ("running", F.col("o_orderstatus") == "P")], "waiting")
    provider = F.initcap(F.lower(F.split("o_orderpriority", "-")[1]))
    return orders.select("o_orderkey", stage.alias("stage"), provider.alias("provider"), results.labelled(F.concat(F.lit(" "), F.upper("o_orderstatus")), {"f": "finished", "o": "open"}).alias("label"))


def mask_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of neighbouring vectors joined by or, their share, and what the change in share says."""
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, sf_dir, "embeddings").withColumn("other", after).filter("other is not null")
    one, two = (F.transform(c, lambda x: x > 0.5) for c in ("embedding", "other"))
    share = lambda m: F.round(F.size(F.filter(m, lambda x: x)) / F.size(m), 6)
    rows = rows.select("vec_id", share(one).alias("before"), share(two).alias("after"), share(F.zip_with(one, two, lambda x, y: x | y)).alias("either"))
    change = F.round(F.col("after") - F.col("before"), 6)
    return rows.withColumn("change", results.first_match([("reveal", change <= -0.05), ("cover", change >= 0.05)], "same"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation's scenes are just two adjacent ones, and the images that stand for them."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    few = F.array_distinct(F.transform("turns", lambda t: F.floor(t / 2)))
    pick = F.when(F.size("turns") <= 3, F.col("turns")).otherwise(F.array(F.element_at("turns", 1), F.element_at("turns", (F.floor(F.size("turns") / 2) + 1).cast("int")), F.element_at("turns", -1)))
    return rows.select("conv_id", ((F.size(few) == 2) & (F.array_max(few) - F.array_min(few) == 1)).alias("adjacent"), F.array_join(pick.cast("array<string>"), ",").alias("images"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage added up by kind and flag with all subtotals."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))


def grouped_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their most frequent event type, unclassified without one, each group's members as a digest of its list."""
    counts = table(spark, sf_dir, "events").filter("value > 10").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"].alias("type"))
    every = table(spark, sf_dir, "events").select("user_id").distinct().join(best, "user_id", "left")
    return every.groupBy(F.coalesce("type", F.lit("unclassified")).alias("type")).agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"), F.sum("user_id").alias("users"))


_BARE = r"regexp_replace(text, '[\s\p{P}]+', '', 'g')"
_G = "list_transform(list_zip(embedding, other), lambda t: abs(t[1]::double - t[2]::double))"
_LEAD = "select vec_id, embedding, lead(embedding) over (partition by label order by vec_id) other from embeddings"
ORACLES = {
    "order_details": """
select o_orderkey, o_orderstatus, count(l_linenumber)::int n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_quantity::bigint, ',' order by l_linenumber, l_quantity, l_partkey), '') as lines
from orders left join lineitem on l_orderkey = o_orderkey group by all""",
    "slide_lookup": """
select coalesce(doc_id, page_id) id, coalesce(case when page_id % 3 = 0 then null else nullif(url, '') end, nullif(source, '')) title, nullif(lang, '') lang
from documents full join pages on doc_id = page_id""",
    "context_lookup": """
with r as (select *, row_number() over (partition by conv_id order by turn, role) context_index, case when turn % 3 = 1 then role || '-' || turn end given from conversations)
select conv_id, turn, context_index, coalesce(given, printf('S%03d-C%03d', conv_id, context_index)) context_id from r""",
    "context_bundles": """
select a.conv_id, a.turn, (select count(*) from conversations c where c.conv_id = a.conv_id) turns, string_agg((b.turn - a.turn) || ':' || length(b.text), ',' order by b.turn) around
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 2 and a.turn + 2 where a.role = 'user' group by a.conv_id, a.turn""",
    "adjacent_days": "select user_id, day, lag(day) over w previous, lead(day) over w \"next\" from (select distinct user_id, day(ts)::int \"day\" from events) window w as (partition by user_id order by day)",
    "evidence_fan_out": r"select doc_id, min(doc_id) over w evidence_of, count(*) over w group_size from (select doc_id, md5(lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))) k from documents) window w as (partition by k)",
    "verification_view": """
with s as (select case event_type when 'click' then 'Click' when 'view' then 'Page view' when 'error' then 'Fault' else event_type end "type", case when value < 5 then 'rejected' when value < 20 then 'review' else 'confirmed' end status from events)
select "type", count(*) issues, count(*) filter (status = 'confirmed') confirmed, count(*) filter (status = 'review') review, count(*) filter (status = 'rejected') rejected, round(count(*) filter (status = 'confirmed') / count(*), 6) "share" from s group by 1""",
    "slim_issues": """
select doc_id, '{' || array_to_string(list_filter([case when lang <> '' then '"lang":"' || lang || '"' end, case when source <> '' then '"source":"' || source || '"' end, case when quality = 1 then '"verdict":"good"' end, case when toxic = 1 then '"flag":"toxic"' end], lambda x: x is not null), ',') || '}' issue
from documents left join labels using (doc_id)""",
    "response_rows": """
select o_orderkey id, coalesce(nullif(trim(c_name), ''), 'unknown') "owner", coalesce(c_mktsegment, 'etc') "domain", strftime(o_orderdate, '%Y-%m-%d') created, lower(o_orderstatus) status,
  coalesce(n, 0) issue_count, coalesce(returned, 0) rejected_count, n is not null complete, round(o_totalprice, 2) total
from orders left join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) n, count(*) filter (l_returnflag = 'R') returned from lineitem group by 1) on l_orderkey = o_orderkey""",
    "next_stage_items": "select conv_id slide_number, turn place, role, length(text)::int chars from conversations",
    "flat_segments": """
with r as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5 segment from events)
select user_id, segment, arg_min(event_type, row(ts, event_id)) first_type, arg_max(event_type, row(ts, event_id)) last_type, min(event_id) least_id, round(avg(value), 6) mean_value, count(*) n from r group by 1, 2""",
    "pair_decisions": f"""
with g as (select vec_id, {_G} g from ({_LEAD}) where other is not null),
m as (select vec_id, round(list_sum(g) / len(g), 4) mean_gap, round(list_max(g), 4) most, round(len(list_filter(g, lambda x: x > 1)) / len(g), 4) changed from g),
r as (select *, mean_gap < 1.2 or changed < 0.5 or most < 2.5 maybe, case when mean_gap < 0.05 then 'near_identical' when most > 4 then 'veto' when changed < 0.45 and mean_gap < 1.1 then 'content' when mean_gap < 1.2 or changed < 0.5 or most < 2.5 then 'prefilter_only' else 'different' end reason from m)
select vec_id, mean_gap, changed, maybe, reason, reason in ('near_identical', 'content') duplicate from r""",
    "transition_reasons": """
with r as (select *, abs(value - lag(value) over w) step, abs(value - first_value(value) over w) away, lag(event_type) over w kind from events window w as (partition by user_id order by ts, event_id))
select event_id, case when step > 60 then 'cut' when kind <> event_type and away > 40 then 'base_structure' when away > 50 then 'base_strong_change' when step > 2 and away < 5 then 'subtle_text_change' when away > 20 then 'base_diff' when step > 30 then 'edge_break' end reason from r""",
    "long_scenes": f"""
with s as (select user_id, day(ts)::int "day", min({_SEC_SQL}) a, max({_SEC_SQL}) b, max(case when event_type = 'purchase' then 'video' else 'slide' end) kind from events group by 1, 2)
select user_id, "day", kind, dense_rank() over (partition by user_id order by a, "day")::int scene_number from s where b - a > 3 or kind = 'video'""",
    "timing_stats": """
with r as (select *, round(value)::bigint took from events)
select user_id, nullif(coalesce(sum(took) filter (regexp_matches(event_type, '^(view|click)')), 0), 0)::bigint preprocess, nullif(coalesce(sum(took) filter (event_type in ('purchase', 'signup')), 0), 0)::bigint verify, arg_max(took, row(ts, event_id)) filter (took > 0) last_took from r group by 1""",
    "model_breakdown": """
with r as (select o_orderstatus model, lower(substring(o_orderpriority, 3)) k from orders)
select model, count(*) n, count(*) filter (k = 'urgent') urgent, count(*) filter (k = 'high') high, count(*) filter (k = 'medium') medium, count(*) filter (k not in ('urgent', 'high', 'medium')) others from r group by 1""",
    "media_chunks": """
with d as (select c_custkey, greatest(round(c_acctbal, 2), 0) d from customer), c as (select *, unnest(generate_series(0, greatest(ceil(d / 1800)::int, 1) - 1))::int chunk from d)
select c_custkey, chunk, round(chunk * 1800.0::double, 2) core_start, round(least((chunk + 1) * 1800.0::double, d), 2) core_end, round(greatest(chunk * 1800.0::double - 30, 0), 2) "start", round(least(least((chunk + 1) * 1800.0::double, d) + 30, d), 2) "end" from c""",
    "stitched_times": """
with p as (select l_orderkey track, l_linenumber * 100.0::double lo, l_linenumber * 100.0::double + l_quantity hi, l_quantity q from lineitem),
c as (select *, coalesce(sum(q) over (partition by track order by lo, hi rows between unbounded preceding and 1 preceding), 0)::double laid from p),
t as (select o_orderkey track, unnest([0.0, 10.0, 33.5, 5000.0])::double t from orders)
select t.track, t.t, least(arg_max(c.lo, row(c.laid, c.lo)) + t.t - max(c.laid), arg_max(c.hi, row(c.laid, c.lo))) original from t left join c on c.track = t.track and c.laid <= t.t group by 1, 2""",
    "display_ids": "select event_id, printf('CL%04d', row_number() over (order by event_type, ts, event_id)) display_id from events",
    "preferred_results": """
with r as (select *, case when event_type = 'purchase' then 0 when event_type = 'click' and value > 20 then 1 when event_type = 'error' then 3 else 2 end::int "rank" from events)
select user_id, event_id, "rank" from r qualify row_number() over (partition by user_id order by "rank", value desc, event_id) = 1""",
    "representative_terms": r"""
with t as (select item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}'), lambda x: x not in ('the', 'and', 'of', 'is', 'a', 'an', 'to', 'in')) f from benchmark),
w as (select item_id, list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 24) t from t)
select item_id, len(t)::int n, array_to_string(list_sort(list_filter(t, lambda x: len(list_filter(t, lambda y: length(y) > length(x) and contains(y, x))) = 0)), ',') kept from w""",
    "edited_turns": """
with t as (select conv_id, turn, coalesce(text, '') t from conversations), c as (select *, case when length(t) >= 12 then t[:8] || '<c>' || t[13:] else t end c, case when length(t) >= 12 then 8 else length(t) end free from t),
b as (select *, case when free >= 9 then c[:5] || c[10:] else c end b, case when free >= 9 then 5 else free end free2 from c)
select conv_id, turn, md5(case when free2 >= 2 then '<a>' || b[3:] else b end) digest from b""",
    "issue_entries": "select 'knowledge' kind, doc_id id, n_chars size, lang category from documents union all select 'slide', page_id, case when page_id % 2 = 0 then length(html) end, null from pages",
    "category_counts": """
with r as (select quality = 1 good, list_filter([lang, case when n_chars > 2000 then 'long' end, case when toxic = 1 then 'toxic' end, case when quality = 1 then 'good' end], lambda x: x is not null) tags from documents left join labels using (doc_id))
select category, count(*) n, count(*) filter (good) n_good from (select unnest(tags) category, good from r) group by 1""",
    "set_queries": """
with a as (select user_id from events where event_type = 'click'), b as (select user_id from events where event_type = 'purchase')
select user_id, 'union' part from (select * from a union select * from b) union all select user_id, 'intersect' from (select * from a intersect select * from b) union all select user_id, 'except' from (select * from a except select * from b)""",
    "profile_order": """
select c_nationkey, c_custkey, c_acctbal > 5000 active, row_number() over (partition by c_nationkey order by c_acctbal > 5000 desc, last_used desc nulls last, c_custkey desc)::int place
from customer left join (select o_custkey, max(o_orderdate) last_used from orders group by 1) on o_custkey = c_custkey""",
    "surface_edits": f"with d as (select doc_id, text, {_BARE} bare from documents) select a.doc_id, a.bare = b.bare surface_only, a.text = b.text same from d a join d b on b.doc_id = a.doc_id + 1",
    "stage_labels": """
select o_orderkey, case o_orderstatus when 'F' then 'done' when 'P' then 'running' else 'waiting' end stage, array_to_string(list_transform(string_split(string_split(o_orderpriority, '-')[2], ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') provider,
  case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else ' ' || o_orderstatus end label from orders""",
    "mask_unions": f"""
with m as (select vec_id, list_transform(embedding, lambda x: x > 0.5) a, list_transform(other, lambda x: x > 0.5) b from ({_LEAD}) where other is not null),
s as (select vec_id, round(len(list_filter(a, lambda x: x)) / len(a), 6) before, round(len(list_filter(b, lambda x: x)) / len(b), 6) after, round(len(list_filter(list_zip(a, b), lambda t: t[1] or t[2])) / len(a), 6) either from m)
select *, case when round(after - before, 6) <= -0.05 then 'reveal' when round(after - before, 6) >= 0.05 then 'cover' else 'same' end change from s""",
    "candidate_pairs": """
with t as (select conv_id, list(turn order by turn) t from conversations group by 1), f as (select *, list_distinct(list_transform(t, lambda x: x // 2)) f from t)
select conv_id, len(f) = 2 and list_max(f) - list_min(f) = 1 adjacent, array_to_string(case when len(t) <= 3 then t else [t[1], t[len(t) // 2 + 1], t[-1]] end, ',') images from f""",
    "usage_totals": "select l_returnflag, l_linestatus, count(*) calls, sum(l_quantity::bigint)::bigint tokens from lineitem group by rollup (l_returnflag, l_linestatus)",
    "grouped_issues": """
with c as (select user_id, event_type, count(*) n from events where value > 10 group by 1, 2), b as (select user_id, arg_min(event_type, row(-n, event_type)) "type" from c group by 1)
select coalesce("type", 'unclassified') "type", count(*) n, min(user_id) first_user, max(user_id) last_user, sum(user_id)::bigint users from (select distinct user_id from events) left join b using (user_id) group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
