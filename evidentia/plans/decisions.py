"""Queries of decisions over sources, frames and answers, and of scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import nested, numbers, text
from evidentia.operators import decisions
from evidentia.sources.session import table


def source_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as sources: status, evidence, best priority and whether better ones are to be sought."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("matched"), (F.col("l_linestatus") == "F").alias("eligible"), (F.col("l_suppkey") % 6).cast("int").alias("priority"), F.col("l_linenumber").cast("long").alias("passages"))
    status = decisions.source_status(lines.filter("priority <> 5"), "l_orderkey", "matched", "eligible", "priority", "passages")
    weak = lines.filter("priority <= 2 and not matched").groupBy("l_orderkey").agg(F.lit(True).alias("weak"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").join(status, "l_orderkey", "left").join(weak, "l_orderkey", "left")
    rows = rows.withColumns({"status": F.coalesce("status", F.lit("no_sources")), "direct_evidence": F.coalesce("direct_evidence", F.lit(0))})
    repair = decisions.needs_repair(F.col("best_priority"), F.col("o_orderstatus") == "F", F.coalesce("weak", F.lit(False)), F.col("status"))
    return rows.select("l_orderkey", "status", "direct_evidence", "best_priority", repair.alias("repair"))


REPAIRS = """
with l as (select l_orderkey, l_returnflag = 'R' m, l_linestatus = 'F' e, (l_suppkey % 6)::int p, l_linenumber n from lineitem),
s as (select l_orderkey, case when bool_or(m) then 'verified' else 'no_direct_passage' end status, coalesce(sum(n) filter (m), 0)::bigint d, min(p) filter (m and e) b from l where p <> 5 group by 1),
w as (select l_orderkey, bool_or(p <= 2 and not m) weak from l group by 1),
j as (select o_orderkey l_orderkey, o_orderstatus, coalesce(status, 'no_sources') status, coalesce(d, 0) direct_evidence, b best_priority, coalesce(weak, false) weak from orders left join s on s.l_orderkey = o_orderkey left join w on w.l_orderkey = o_orderkey)
select l_orderkey, status, direct_evidence, best_priority, coalesce(best_priority > 2, true) and (o_orderstatus = 'F' or weak or status <> 'verified') repair from j"""


def reported_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages are reported for every page's address or its domain."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    return decisions.passages_of(pages, pages, "url", F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.sum("page_id").alias("sum_pages"))


REPORTED = """
with p as (select page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') d from pages where url <> ''),
k as (select page_id, url, coalesce(nullif(d, ''), url) d from p), a as (select d, count(*) n, min(page_id) first_page, sum(page_id)::bigint sum_pages from k group by 1)
select distinct url, n, first_page, sum_pages from k join a using (d)"""


def clean_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a frame of its order, the first that was returned early as the base."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "base").otherwise("build").alias("kind"))
    return decisions.clean_finals(rows, "l_orderkey", "kind", "l_linenumber", []).select("l_orderkey", "l_linenumber", "clean_final", "is_clean_final")


FINALS = """
with k as (select l_orderkey, l_linenumber, row((l_returnflag is distinct from 'A')::int, l_linenumber) place from lineitem), f as (select l_orderkey, arg_min(l_linenumber, place) clean_final, min(place) best from k group by 1)
select l_orderkey, l_linenumber, clean_final, place = best is_clean_final from k join f using (l_orderkey)"""


def natural_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that end a sentence or are followed by a pause; a turn's characters are its length in time."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 400).alias("s"), (F.col("turn") * 400 + F.length("text")).alias("e"))
    return decisions.natural_ends(rows, ["conv_id"], ["turn"], "text", "s", "e", 250.0).select("conv_id", "turn", "natural")


NATURAL = r"""
select conv_id, turn, (regexp_matches(rtrim(coalesce(text, ''), ' '), '[.!?。！？]$') or coalesce(lead(turn) over w * 400 - turn * 400 - length(text) >= 250, false)) and lead(turn) over w is not null "natural"
from conversations window w as (partition by conv_id order by turn)"""


def moved_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are nearer to the next label's first vector than to their own label's."""
    rows = table(spark, sf_dir, "embeddings")
    bases = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return decisions.moved_to_next(rows, bases, "label", "embedding", 0.002).select("vec_id", "gain", "next_scene", "moved")


MOVED = """
with b as (select label, arg_min(embedding, vec_id) o from embeddings group by 1), p as (select label, o, lead(o) over (order by label) n, lead(label) over (order by label) next_scene from b),
d as (select vec_id, next_scene, round(list_sum(list_transform(list_zip(embedding, o), lambda t: (t[1]::double - t[2]) * (t[1]::double - t[2]))) / len(embedding) - list_sum(list_transform(list_zip(embedding, n), lambda t: (t[1]::double - t[2]) * (t[1]::double - t[2]))) / len(embedding), 6) gain from embeddings join p using (label))
select vec_id, case when next_scene is not null then gain end gain, next_scene, next_scene is not null and gain >= 0.002 moved from d"""


def element_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's fields as a line of what is filled."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("label"), F.col("p_size").alias("size")).alias("e"))
    return rows.select("p_partkey", decisions.element_lines(F.array("e", F.struct(F.lit(" ").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("size"))), ["kind", "label", "size"]).alias("lines"))


ELEMENTS = "select p_partkey, concat_ws(' | ', case when p_partkey % 3 <> 0 then nullif(trim(p_type), '') end, case when p_partkey % 4 <> 0 then nullif(trim(p_name), '') end, p_size::int::varchar) \"lines\" from part"


def slides_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides from file names made of each line: the first line of an order is the base, others are builds or annotations."""
    ln = F.col("l_linenumber")
    kind = F.when(ln == 1, "base.JPG").when(ln % 3 == 0, F.concat(F.lit("annot_"), ln, F.lit(".png"))).when(ln == 7, "other.png").otherwise(F.concat(F.lit("build_"), ln, F.lit(".png")))
    files = table(spark, sf_dir, "lineitem").filter((F.col("l_orderkey") % 5 != 0) | (ln > 1)).select(F.concat(F.lit("slide_"), F.col("l_orderkey"), F.lit("_"), kind).alias("name"))
    return decisions.slides_of_files(files, "name").select("slide", "base", F.array_join("builds", ",").alias("builds"), "annotated")


FILES = """
select l_orderkey slide, 'slide_' || l_orderkey || '_base.JPG' base, coalesce(string_agg('slide_' || l_orderkey || '_build_' || l_linenumber || '.png', ',' order by l_linenumber) filter (l_linenumber in (2, 4, 5)), '') builds, bool_or(l_linenumber % 3 = 0) annotated
from lineitem where l_orderkey % 5 <> 0 and l_linenumber <> 7 group by 1 having min(l_linenumber) = 1"""


def merged_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of answers merged by model: lines by ship mode and orders by priority as models of their own."""
    failed = lambda c: F.when(F.max(c), "partial_failed").otherwise("ok").alias("status")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(failed(F.col("l_quantity") > 49), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model")).agg(failed(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_orderstatus") == "O").alias("errors"), F.count("*").alias("calls"), F.lit(None).cast("long").alias("tokens"))
    return decisions.merged_rounds([lines, orders], "model")


ROUNDS = """
with r as (select l_suppkey model, bool_or(l_quantity > 49) f, count(*) filter (l_returnflag = 'R') errors, count(*) calls, sum(l_quantity::bigint) tokens from lineitem group by 1
  union all select o_custkey, bool_or(o_orderstatus = 'P'), count(*) filter (o_orderstatus = 'O'), count(*), 0 from orders group by 1)
select model, case when bool_or(f) then 'partial_failed' else 'ok' end status, sum(errors)::bigint errors, sum(calls)::bigint calls, sum(tokens)::bigint tokens from r group by 1"""


def keyword_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that three benchmark texts or more hold, summed up over the documents that hold them too."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), " "), lambda w: F.length(w) >= 2)
    counts = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    return decisions.keyword_sums(table(spark, sf_dir, "documents"), counts, "doc_id", words(F.col("text")))


KEYWORDS = """
with c as (select word, count(*) n from (select item_id, unnest(list_distinct(string_split(lower(coalesce(text, '')), ' '))) word from benchmark) where length(word) >= 2 group by 1 having count(*) >= 3),
s as (select doc_id, count(*) keywords, sum(n)::bigint total from (select doc_id, unnest(list_distinct(string_split(lower(coalesce(text, '')), ' '))) word from documents) join c using (word) group by 1)
select doc_id, coalesce(keywords, 0) keywords, coalesce(total, 0) total from documents left join s using (doc_id)"""


def refreshed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one summary for each lecture (user): high, to review, adjusted either way, and the summed move."""
    score = numbers.clamp01(F.col("value") / 100)
    relation = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "refutes").otherwise("none")
    new, moved = numbers.soft_delta(score, relation)
    rows = table(spark, sf_dir, "events").select("user_id", new.alias("score"), moved.alias("moved"), relation.alias("relation"))
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("score") >= 0.5).alias("high"),
        F.count_if(numbers.status_of(F.col("score"), 0.5, 0.1) == "professor_check").alias("review"),
        F.count_if(F.col("relation") == "supports").alias("supports"),
        F.count_if(F.col("relation") == "refutes").alias("refutes"),
        F.round(F.sum(F.col("moved").cast("decimal(18,6)")).cast("double"), 6).alias("delta"),
    )


SUMMARY = """
with s as (select user_id, event_type, round(least(1, greatest(0, value / 100)), 6) s from events), m as (select user_id, event_type, s, round(least(1, greatest(0, s + case event_type when 'purchase' then 0.1 when 'error' then -0.1 else 0 end::double)), 6) n from s)
select user_id, count(*) filter (n >= 0.5) high, count(*) filter (n > 0.1 and n < 0.5) review, count(*) filter (event_type = 'purchase') supports, count(*) filter (event_type = 'error') refutes, round(sum(round(n - s, 6)::decimal(18, 6))::double, 6) delta from m group by 1"""


def slide_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and reports of corrections: a document's source as what is wrong, its language as what is right."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    wrong, right = F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(" 5 ms"))).otherwise("")
    reason = F.when(F.col("toxic") == 1, "Wrong STYLE").otherwise("wrong word")
    kind = text.error_type(F.when(F.col("doc_id") % 7 == 0, " Visual_Defect ").otherwise(F.col("lang")), wrong, right)
    return rows.select("doc_id", kind.alias("kind"), text.reportable_error(wrong, right, reason, kind).alias("report"), text.severity_name(F.when(F.col("quality") == 1, " Critical").otherwise(F.col("lang")), F.col("n_chars") / 2000).alias("severity"))


ERRORS = r"""
with r as (select doc_id, lang, quality, toxic, n_chars, trim(coalesce(source, '')) p, case doc_id % 3 when 0 then trim(coalesce(lang, '')) when 1 then coalesce(source || ' 5 ms', '') else '' end c from documents join labels using (doc_id)),
k as (select *, case when doc_id % 7 = 0 then 'visual_defect' when c = '' then 'visual_defect' when regexp_matches(p || ' ' || c, '(?i)[0-9]|[%℃°]|(ms|sec|kb|mb|gb|hz|khz|mhz|ghz)\b') then 'numeric_unit' else 'text_error' end kind from r)
select doc_id, kind, case when kind = 'visual_defect' then p <> '' else p <> '' and c <> '' and replace(p, ' ', '') <> replace(c, ' ', '') and regexp_replace(p, '\S+', '') = regexp_replace(c, '\S+', '') and toxic is distinct from 1 end report,
  case when quality = 1 then case when n_chars / 2000 < 0.9 then 'major' else 'critical' end else 'minor' end severity from k"""


def scalar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose fields of lines: probabilities, times of frames, overlaps, filled names, keys and job types."""
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    box = lambda x: {"x1": x, "y1": F.lit(0.0), "x2": x + 20, "y2": F.lit(10.0)}
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        numbers.probability(F.when(F.col("l_linenumber") == 2, "n/a").otherwise((q - 10).cast("string"))).alias("p"),
        numbers.safe_float(F.when(F.col("l_linenumber") == 3, "NaN").otherwise(q.cast("string")), -1.0).alias("x"),
        F.round(numbers.frame_time(q, F.when(F.col("l_linenumber") > 1, F.lit(30.0)).otherwise(0.0)), 6).alias("at"),
        F.round(numbers.box_overlap(box(q), box(q + F.col("l_linenumber") * 8)), 6).alias("iou"),
        F.coalesce(nested.first_filled(F.when(F.col("l_linenumber") == 1, "  ").otherwise(F.col("l_linestatus")), F.col("l_returnflag")), F.lit("")).alias("name"),
        F.array_join(nested.context_ids(F.when(F.col("l_linenumber") == 1, F.array("l_returnflag", "l_linestatus")), F.when(F.col("l_linenumber") == 2, F.col("l_linestatus"))), ",").alias("contexts"),
        F.size(nested.no_repeats(F.array("l_returnflag", F.lit(" "), "l_returnflag", "l_linestatus"))).alias("kept"),
        text.job_type(F.when(F.col("l_linenumber") == 1, " Run-Video ").when(F.col("l_linenumber") == 2, "")).alias("job"),
        text.claim_key(F.when(F.col("l_linenumber") == 1, F.col("l_linestatus")), F.col("l_returnflag"), F.col("l_linestatus")).alias("key"),
        text.issue_identity(F.lit(""), F.when(F.col("l_linenumber") == 1, "C1"), F.lit("list"), F.col("l_linenumber"), F.col("l_linestatus")).alias("identity"),
    )


SCALARS = """
with l as (select *, l_quantity::double q, l_linenumber n from lineitem)
select l_orderkey, l_linenumber, case when n <> 2 and q >= 10 then q - 10 end p, case when n = 3 then -1 else q end x, round(case when n > 1 then q / 30 else 0 end, 6) "at", round(case when n * 8 < 20 then (20 - n * 8) / (20 + n * 8) else 0 end::double, 6) iou,
  coalesce(nullif(trim(case when n = 1 then '  ' else l_linestatus end), ''), l_returnflag, '') "name", case n when 1 then l_returnflag || ',' || l_linestatus when 2 then coalesce(l_linestatus, '') else '' end contexts, case when l_returnflag = l_linestatus then 1 else 2 end kept,
  'full' job, case when n = 1 then l_linestatus else l_returnflag || '::' || l_linestatus end "key", case when n = 1 then 'C1' else 'list:' || n || ':' || sha1(l_linestatus)[:12] end "identity" from l"""

ORACLES = {
    "source_repairs": REPAIRS,
    "reported_passages": REPORTED,
    "clean_finals": FINALS,
    "natural_boundaries": NATURAL,
    "moved_annotations": MOVED,
    "element_lines": ELEMENTS,
    "slides_of_files": FILES,
    "merged_rounds": ROUNDS,
    "keyword_sums": KEYWORDS,
    "refreshed_summary": SUMMARY,
    "slide_errors": ERRORS,
    "scalar_fields": SCALARS,
}
QUERIES = {name: globals()[name] for name in ORACLES}
