"""Verdict queries: votes, ensembles, severity, dedupe, runs, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import nested, numbers
from evidentia.operators import dedupe, evidence, votes
from evidentia.sources.session import table

TYPES = ["error", "view", "click", "purchase", "signup"]
WEEK = "cast(floor((dayofyear(ts) - 1) / 7) as long)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim is a user's week, a model an event type, its confidence the highest value."""
    events = table(spark, sf_dir, "events").select("user_id", F.expr(WEEK).alias("week"), "event_type", "value")
    return events.groupBy("user_id", "week", "event_type").agg(F.least(F.lit(1.0), F.max("value") / 100).alias("confidence")).withColumn("claim", F.concat_ws("-", "user_id", "week"))


_SCORES = """scores as (
  select user_id, (dayofyear(ts) - 1) // 7 as week, event_type, least(1.0, max(value) / 100) confidence from events group by 1, 2, 3),
c as (select *, user_id || '-' || week claim, round(greatest(0, confidence), 6) conf from scores)"""


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-of-n votes of the five event types on every user week."""
    scores = _scores(spark, sf_dir).withColumn("raised", F.col("confidence") > 0.3)
    return votes.consensus(scores, "claim", "event_type", "confidence", "raised", F.lit(len(TYPES)).cast("long"))


CONSENSUS = f"""
with {_SCORES},
g as (select claim, 5::bigint evaluated_count, count(*) filter (confidence > 0.3) issue_count, count(*) filter (confidence > 0.3 and conf >= 0.7) qualified_count,
  coalesce(max(conf) filter (confidence > 0.3 and conf >= 0.7), 0.0) best_confidence,
  coalesce(first(event_type order by conf desc, event_type) filter (confidence > 0.3 and conf >= 0.7), first(event_type order by conf desc, event_type) filter (confidence > 0.3)) strongest
  from c group by claim),
s as (select *, 3::bigint majority_required, case when issue_count = 0 then 'no_issue' when qualified_count = 5 then 'all_models_agreed' when qualified_count >= 3 then 'partial_agreement'
  when best_confidence >= 0.85 then 'single_model_strong' when qualified_count = 1 then 'rejected_single_model_low_confidence' else 'rejected_below_majority' end status from g)
select *, status in ('all_models_agreed', 'partial_agreement', 'single_model_strong') keep from s"""


def consensus_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims got each status."""
    return consensus_vote(spark, sf_dir).groupBy("status", "keep").agg(F.count("*").alias("claims"))


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue is a user, a model a week, its probabilities the shares of the event types."""
    events = table(spark, sf_dir, "events").select("user_id", F.expr(WEEK).alias("week"), "event_type")
    counts = events.groupBy("user_id", "week").pivot("event_type", TYPES).count().na.fill(0)
    raw = F.map_from_arrays(F.array(*[F.lit(t) for t in TYPES]), F.array(*[F.col(t).cast("double") for t in TYPES]))
    return counts.select("user_id", "week", nested.normalised(raw).alias("p")).filter("p is not null")


_PROBS = """p as (
  select w.user_id, week, t.event_type, round(count(e.event_type)::double / max(total), 6) p
  from (select user_id, (dayofyear(ts) - 1) // 7 as week, count(*) total from events group by all) w
  cross join (values ('error', 0), ('view', 1), ('click', 2), ('purchase', 3), ('signup', 4)) t(event_type, o)
  left join events e on e.user_id = w.user_id and (dayofyear(e.ts) - 1) // 7 = w.week and e.event_type = t.event_type
  group by all),
o(event_type, o) as (values ('error', 0), ('view', 1), ('click', 2), ('purchase', 3), ('signup', 4))"""


def ensemble_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted types of every user over five weekly models, with margins and routing."""
    probs = _probabilities(spark, sf_dir)
    verdicts = probs.select("user_id", "week", F.explode("p").alias("event_type", "p"))
    scores = votes.weighted_types(verdicts, "user_id", "week", "event_type", "p", 5)
    tops = probs.select("user_id", nested.top_type(F.col("p"), TYPES).alias("top"))
    order = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type"))
    return votes.final_types(scores, tops, "user_id", "event_type", order, 5)


ENSEMBLE = f"""
with {_PROBS},
s as (select user_id, event_type, round(sum(0.2 * p), 6) score from p group by all),
r as (select s.*, row_number() over w nr, coalesce(lead(score) over w, 0) "second" from s join o using (event_type) window w as (partition by user_id order by score desc, o)),
t as (select user_id, week, first(event_type order by p desc, o) top from p join o using (event_type) group by all),
a as (select user_id, count(*) answered, count(distinct top) different from t group by all),
f as (select user_id, event_type top_type, score top_score, round(score - "second", 6) margin, answered, different from r join a using (user_id) where nr = 1),
g as (select *, margin < 0.1 low_margin, answered >= 2 and answered = 5 and different = answered differ from f)
select user_id, top_type, top_score, margin, answered, different, low_margin,
  concat_ws(',', case when low_margin then 'low_margin' end, case when differ then 'model_disagreement' end) reasons,
  case when low_margin or differ then 'composite_issue' else top_type end final_type from g"""


def probability_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top type and margin of every model's own normalised probabilities."""
    return _probabilities(spark, sf_dir).select("user_id", "week", nested.top_type(F.col("p"), TYPES).alias("top_type"), nested.margin(F.col("p")).alias("margin"))


MARGINS = f"""
with {_PROBS}, r as (select p.*, row_number() over w nr, lead(p) over w "second" from p join o using (event_type) window w as (partition by user_id, week order by p desc, o))
select user_id, week, event_type top_type, round(p - "second", 6) margin from r where nr = 1"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return lines.withColumn("score", numbers.model_score(F.col("l_quantity") / 50, 1 - 2 * F.col("l_discount"), F.col("l_tax") * 10))


_LINES = "lines as (select *, round(least(1, greatest(0, round(l_quantity / 50, 6) * round(1 - 2 * l_discount, 6) * round(l_tax * 10, 6))), 6) score from lineitem)"


def severity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, disagreement and status of an order's lines by return flag."""
    # Counted where the rows of a group lie anyway: lines are dealt out and sorted once, and no task joins or holds groups before.
    lines = _lines(spark, sf_dir).filter("l_orderkey is not null and l_returnflag is not null")
    lines = lines.withColumn("models", F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag")))
    return votes.severity(lines, ["l_orderkey", "l_returnflag"], "score", F.col("models"))


SEVERITY = f"""
with {_LINES}, m as (select l_orderkey, l_returnflag, count(*) models from lines group by all),
s as (select l_orderkey, l_returnflag, round(sum(score / models), 6) final_score, round(max(score) - min(score), 6) disagreement, count(score) judged from lines join m using (l_orderkey, l_returnflag) group by all)
select *, disagreement >= 0.35 flagged, case when final_score >= 0.8 then 'confirmed' when final_score <= 0.2 then 'rejected' else 'professor_check' end status from s"""


def composite_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every order over its return flags, weighted by quantity."""
    parts = _lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("weight"), F.max("score").alias("score"))
    return votes.composite(parts, "l_orderkey", "l_returnflag", "weight", "score")


COMPOSITE = f"""
with {_LINES}, p as (select l_orderkey, l_returnflag, sum(l_quantity) weight, max(score) score from lines group by all),
s as (select *, case when sum(weight) over w > 0 then weight / sum(weight) over w else 1.0 / count(*) over w end share from p window w as (partition by l_orderkey)),
r as (select *, share * score part, row_number() over (partition by l_orderkey order by round(share * score, 9) desc, score desc, round(share, 9) desc, l_returnflag) nr from s)
select l_orderkey, round(sum(part), 9) expected, max(case when nr = 1 then l_returnflag end) primary_type from r group by l_orderkey"""


def evidence_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line scores moved by evidence: accepted lines support, returned ones refute."""
    lines = _lines(spark, sf_dir)
    relation = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "refutes").otherwise("none")
    new, moved = numbers.soft_delta(F.col("score"), relation)
    out = lines.select("l_orderkey", "l_linenumber", "score", new.alias("adjusted"), moved.alias("moved"))
    return out.withColumn("status", numbers.status_of(F.col("adjusted")))


DELTA = f"""
with {_LINES}, a as (select l_orderkey, l_linenumber, score, round(least(1, greatest(0, score + case l_returnflag when 'A' then 0.1 when 'R' then -0.1 else 0 end)), 6) adjusted from lines)
select *, round(adjusted - score, 6) moved, case when adjusted >= 0.8 then 'confirmed' when adjusted <= 0.2 then 'rejected' else 'professor_check' end status from a"""


def keep_best_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of highest value of each type, user and half hour; the earlier one on ties."""
    events = table(spark, sf_dir, "events").withColumn("slot", F.floor(F.unix_timestamp("ts") / 1800))
    return dedupe.keep_best(events, ["event_type", "user_id", "slot"], "value", "event_id").select("event_id", "event_type", "user_id", "value")


KEEP_BEST = """
select event_id, event_type, user_id, value from events
qualify row_number() over (partition by event_type, user_id, floor(floor(epoch(ts)) / 1800) order by value desc nulls last, event_id) = 1"""


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event types that recur over the five weeks."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.expr(WEEK).alias("week"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))
    return dedupe.merged_runs(rows, ["user_id", "event_type"], "week", "confidence", 5)


MERGED = """
with g as (select user_id, event_type, count(distinct (dayofyear(ts) - 1) // 7) seen, round(avg(least(1.0, value / 100)), 9) mean_confidence, max(least(1.0, value / 100)) best_confidence from events group by all)
select *, round(seen / 5, 6) rate from g where round(seen / 5, 6) >= 0.5 or (seen >= 2 and mean_confidence >= 0.9)"""

_CLASSES = "case when url like '%://blog.%' then 'https://blog.naver.com/' || page_id when url like '%://www.%' then 'https://docs.python.org/' || page_id when url like '%://m.%' then 'https://ko.wikipedia.org/wiki/' || page_id when page_id % 7 = 0 then 'ftp://x.org/' when page_id % 7 = 1 then 'https://www.nist.gov/a' when page_id % 7 = 2 then 'https://cs.mit.edu/b' when page_id % 7 = 3 then 'https://arxiv.org/abs/1' when page_id % 7 = 4 then 'https://bbc.com/news' else url end"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_CLASSES).alias("url"))


def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust of page addresses, with sub-domains standing for real source classes."""
    return evidence.with_trust(_sources(spark, sf_dir), "url")


_EX = " ".join(f"when {' or '.join(f'''d = '{x}' or d like '%.{x}' ''' for x in v)} then '{k}'" for k, v in evidence.EXCLUDED.items())
_TRUST = f"""
s as (select page_id, {_CLASSES} url from pages),
d as (select *, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), '^www\\.', '') d from s),
x as (select *, case when d = '' then 'invalid_url' {_EX} when not regexp_matches(url, '(?i)^https?://') then 'invalid_url' end ex from d)"""
_any = lambda names, how: "(" + " or ".join(how.format(n) for n in names) + ")"
_SUB, _UNDER = "contains(d, '{}')", "(d = '{0}' or d like '%.{0}')"
SOURCE_TRUST = f"""
with {_TRUST},
l as (select *, case when ex = 'tutorial' then 'tutorial' when ex in ('forum', 'user_wiki') then 'forum' when ex = 'personal_blog' then 'blog' when contains(d, 'wikipedia.org') then 'encyclopedia'
  when {_any(evidence.STANDARDS, _SUB)} then 'standards' when {_any(evidence.INTERGOVERNMENTAL, _UNDER)} then 'government'
  when d like '%.gov' or d like '%.go.kr' or d like '%.gov.kr' or regexp_matches(d, '(^|\\.)gov\\.[a-z]{{2,}}$') or {_any(evidence.AGENCIES, _UNDER)} then 'government'
  when {_any(evidence.MUSEUMS, _UNDER)} then 'official_docs' when {_any(evidence.ACADEMIC, _UNDER)} or d like '%.edu' or d like '%.ac.kr' then 'academic'
  when {_any(evidence.DOCUMENTATION, _SUB)} then 'official_docs' when {_any(evidence.EDUCATIONAL, _SUB)} then 'educational' when {_any(evidence.NEWS, _SUB)} then 'news' else 'secondary' end trust_level from x)
select page_id, url, d "domain", trust_level, case trust_level {' '.join(f"when '{k}' then {v}" for k, v in evidence.TRUST.items())} end::double trust_score,
  case trust_level {' '.join(f"when '{k}' then {v}" for k, v in evidence.PRIORITY.items())} end priority,
  trust_level in ({', '.join(f"'{k}'" for k in evidence.PRIORITY)}) eligible from l"""


def source_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses with the reason of their exclusion."""
    return evidence.prefiltered(_sources(spark, sf_dir), "url")


PREFILTER = f"with {_TRUST} select distinct trim(url) url, coalesce(ex, 'accepted') category from x where trim(url) <> ''"


def ranked_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best suppliers of each nation as labelled evidence."""
    rows = table(spark, sf_dir, "supplier").withColumns({"confidence": F.round(F.abs("s_acctbal") / 10000, 4), "priority": (F.col("s_suppkey") % 5).cast("int")})
    rows = rows.withColumns({"class": F.when(F.col("s_suppkey") % 3 == 0, "scholarly").otherwise("general_secondary"), "authority": F.when(F.col("s_suppkey") % 11 == 0, "low").otherwise("high")})
    rows = rows.withColumn("strength", evidence.source_strength(F.col("class"), F.col("authority"), F.col("confidence"), 0.2))
    return evidence.ranked(rows, ["s_nationkey"], "strength", "priority", "confidence", "s_name", 3).select("s_nationkey", "s_suppkey", "strength", "priority", "confidence", "label")


EXCERPTS = """
with r as (select s_nationkey, s_suppkey, s_name, round(abs(s_acctbal) / 10000, 4) confidence, (s_suppkey % 5)::int priority,
  case when s_suppkey % 11 = 0 or round(abs(s_acctbal) / 10000, 4) < 0.2 then 'excluded' when s_suppkey % 3 = 0 then 'strong' else 'supporting' end strength from supplier)
select s_nationkey, s_suppkey, strength, priority, confidence, 'E' || row_number() over w label from r where strength <> 'excluded'
window w as (partition by s_nationkey order by (strength <> 'strong')::int, priority, confidence desc, s_name) qualify row_number() over w <= 3"""


def trial_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of each part's trials: supplier classes vote, the best class only."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    rows = lines.select("l_partkey", (F.col("l_suppkey") % 4 + 1).cast("int").alias("priority"), F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "refutes").otherwise("none").alias("relation"))
    return votes.trial_decision(rows, "l_partkey", "relation", "priority")


TRIALS = """
with r as (select l_partkey, (l_suppkey % 4 + 1)::int priority, l_returnflag f from lineitem),
b as (select *, min(priority) over (partition by l_partkey) best_priority from r),
g as (select l_partkey, best_priority, count(*) filter (f = 'A') supporting, count(*) filter (f = 'R') refuting from b where priority = best_priority group by all)
select *, case when supporting > 0 and refuting = 0 then 'supports_issue' when refuting > 0 and supporting = 0 then 'refutes_issue' else 'insufficient_evidence' end decision from g"""


def missing_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and event type pairs without an event in the first week."""
    events = table(spark, sf_dir, "events")
    users, kinds = events.select("user_id").distinct(), events.select("event_type").distinct()
    first = events.filter("dayofyear(ts) <= 7").select("user_id", "event_type").distinct()
    return votes.missing_verdicts(users, kinds, first, "user_id", "event_type")


MISSING = """
select u.user_id, t.event_type from (select distinct user_id from events) u cross join (select distinct event_type from events) t
where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = t.event_type and dayofyear(ts) <= 7)"""

QUERIES = {
    "consensus_vote": consensus_vote,
    "consensus_status_counts": consensus_status_counts,
    "ensemble_types": ensemble_types,
    "probability_margins": probability_margins,
    "severity_scores": severity_scores,
    "composite_severity": composite_severity,
    "evidence_delta": evidence_delta,
    "keep_best_issues": keep_best_issues,
    "merged_runs": merged_runs,
    "source_trust": source_trust,
    "source_prefilter": source_prefilter,
    "ranked_excerpts": ranked_excerpts,
    "trial_aggregation": trial_aggregation,
    "missing_verdicts": missing_verdicts,
}
ORACLES = {
    "consensus_vote": CONSENSUS,
    "consensus_status_counts": f"select status, keep, count(*) claims from ({CONSENSUS}) group by all",
    "ensemble_types": ENSEMBLE,
    "probability_margins": MARGINS,
    "severity_scores": SEVERITY,
    "composite_severity": COMPOSITE,
    "evidence_delta": DELTA,
    "keep_best_issues": KEEP_BEST,
    "merged_runs": MERGED,
    "source_trust": SOURCE_TRUST,
    "source_prefilter": PREFILTER,
    "ranked_excerpts": EXCERPTS,
    "trial_aggregation": TRIALS,
    "missing_verdicts": MISSING,
}
