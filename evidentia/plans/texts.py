"""Text and group queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import nested, numbers, text
from evidentia.operators import graph
from evidentia.sources.session import table


def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of every document's text, as digests."""
    t = F.col("text")
    forms = {"compact": text.compact(t), "collapsed": text.collapsed(t), "shortened": text.shortened(t, 60), "slug": text.slug(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c.cast("binary")).alias(name) for name, c in forms.items()])


COMPACT = r"""
with c as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') k from documents)
select doc_id, md5(lower(regexp_replace(text, '\s+', '', 'g'))) compact, md5(k) collapsed,
  md5(case when length(k) > 60 then rtrim(left(k, 59), ' ') || '...' else k end) shortened,
  md5(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')) slug from c"""


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document: how many and the longest."""
    lengths = F.transform(text.sentences(F.col("text")), lambda s: F.length(s))
    return table(spark, sf_dir, "documents").select("doc_id", lengths.alias("lengths")).select("doc_id", F.size("lengths").alias("n"), F.array_max("lengths").alias("longest"))


SENTENCES = r"""
with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') s from documents)
select doc_id, len(s)::int n, list_max(list_transform(s, lambda x: length(x)))::int longest from s"""


def passage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every document put together to 900 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.passages(F.col("text"))).alias("nr", "passage"))
    return docs.select("doc_id", "nr", F.length("passage").alias("chars"), F.md5(F.col("passage").cast("binary")).alias("digest"))


def passage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of each benchmark text that hold most terms of its first sentence."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.sentences(F.col("text")).alias("s"))
    rows = rows.select("item_id", text.terms(F.get("s", F.lit(0))).alias("wanted"), F.explode("s").alias("sentence"))
    rows = rows.withColumn("score", text.passage_score(F.col("sentence"), F.col("wanted")))
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.length("sentence"), "sentence")
    return rows.withColumn("rank", F.row_number().over(by)).filter("rank <= 3").select("item_id", "rank", "score", "sentence")


PASSAGES = r"""
with s as (select item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') s from benchmark),
t as (select item_id, s, list_filter(regexp_extract_all(lower(s[1]), '[\p{L}\p{N}]{2,}'), lambda x: x not in ('the', 'and', 'of', 'is', 'a', 'an', 'to', 'in')) f from s),
w as (select item_id, s, list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 24) wanted from t),
e as (select item_id, wanted, unnest(s) sentence from w),
r as (select item_id, sentence, len(list_filter(wanted, lambda x: contains(lower(sentence), x))) + 1.5::double * len(list_filter(wanted, lambda x: contains(lower(sentence), x) and regexp_matches(x, '[0-9]'))) score from e)
select item_id, row_number() over w "rank", score, sentence from r window w as (partition by item_id order by score desc, length(sentence), sentence) qualify row_number() over w <= 3"""


def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before: token overlap, containment, and edit similarity of the whole texts."""
    rows = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.select("conv_id", "turn", "text", before.alias("previous")).filter("previous is not null")
    a, b = (F.regexp_replace(c, r"[^\x00-\x7F]", "_") for c in ("text", "previous"))
    return rows.select("conv_id", "turn", text.similar_claims(F.col("text"), F.col("previous")).alias("similar"), F.round(text.edit_similarity(a, b), 6).alias("alike"), text.text_merge(a, b, 0.3).alias("decision"))


SIMILAR = r"""
with r as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) p from conversations),
n as (select *, lower(regexp_replace(text, '\s+', '', 'g')) ca, lower(regexp_replace(p, '\s+', '', 'g')) cb, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) ta,
  list_distinct(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) tb, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') a, regexp_replace(p, '[^\x00-\x7F]', '_', 'g') b from r where p is not null),
m as (select *, regexp_replace(lower(a), '[^\p{L}\p{N}]+', '', 'g') na, regexp_replace(lower(b), '[^\p{L}\p{N}]+', '', 'g') nb from n),
k as (select *, case when greatest(length(na), length(nb)) = 0 then 1.0 else 1 - levenshtein(na, nb) / greatest(length(na), length(nb)) end x from m)
select conv_id, turn, ca <> '' and cb <> '' and (contains(ca, cb) or contains(cb, ca) or coalesce(len(list_intersect(ta, tb)) / nullif(least(len(ta), len(tb)), 0), 0) >= 0.65) as similar,
  round(case when greatest(length(a), length(b)) = 0 then 1.0 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end, 6) alike,
  case when na = '' or nb = '' then 'unavailable' when na = nb or x >= 0.3 then 'merge' when x <= 0.25 then 'reject' else 'uncertain' end decision from k"""


def bracket_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the brackets in every page's whole html and in every document's whole text."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("html").alias("said"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("said"))
    return pages.unionByName(docs).select("kind", "id", text.bracket_mismatch(F.col("said")).alias("mismatch"))


BRACKETS = r"""
with t as (select 'page' kind, page_id::bigint id, html said from pages union all select 'document', doc_id::bigint, text from documents),
r as (select kind, id, list_reduce(list_prepend('', regexp_extract_all(coalesce(said, ''), '[\[\](){}]')), lambda s, x: case
  when s[1] = '!' then s when x in ('(', '[', '{') then s || x when s = '' then '!no_opener'
  when s[-1] = case x when ')' then '(' when ']' then '[' else '{' end then s[:-2] else '!mismatch' end) s from t)
select kind, id, case when s = '' then null when s[1] = '!' then s[2:] else 'unclosed' end mismatch from r"""


def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim types told from the whole text of every turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.claim_type(F.col("text")).alias("claim_type"))


_TRIMMED = r"lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
CLAIM_TYPES = (
    f"select conv_id, turn, case when t = 'no_claim' then null when t in ({', '.join(repr(x) for x in text.CLAIM_TYPES)}) then t "
    + " ".join(f"when regexp_matches(t, '{words}') or t in ({', '.join(repr(x) for x in text._CLAIM_NAMES.get(name, ('-',)))}) then '{name}'" for name, words in text._CLAIM_WORDS)
    + f" else 'definition' end claim_type from (select conv_id, turn, {_TRIMMED} t from conversations)"
)


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct n-grams of up to three words in each line of each benchmark text, with how many texts have them."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("item_id", F.explode(text.ngram_terms(F.col("line"))).alias("term")).distinct()
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


GLOSSARY = r"""
with w as (select item_id, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') w from (select item_id, unnest(string_split(text, chr(10))) line from benchmark)),
g as (select distinct item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') term from (select item_id, w, unnest(generate_series(1, len(w))) i from w), (select unnest([1, 2, 3]) n) where i + n - 1 <= len(w))
select term, count(*) n, min(item_id) first_item from g where length(term) <= 28 group by term"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page by the plain rule: no scripts, styles and tags."""
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), F.md5(text.visible_text(F.col("html")).cast("binary")).alias("digest"))


PAGE_TEXTS = r"""
with b as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') t from pages),
e as (select *, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') x from b)
select page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), '^www\.', '') "domain", md5(trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')) digest from e"""


def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from the events' JSON, clamped and formatted."""
    events = table(spark, sf_dir, "events")
    k = numbers.safe_int(F.get_json_object("props", "$.k"))
    return events.select("event_id", k.alias("k"), numbers.clamp01(F.col("value") / 50).alias("clamped"), numbers.minutes_text(F.col("value") * 10).alias("mmss"), numbers.hours_text(F.col("value") * 100).alias("hhmmss"), numbers.status_of(F.col("value") / 100).alias("status"))


SAFE = """
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) k, round(least(1, greatest(0, value / 50)), 6) clamped,
  printf('%02d:%02d', floor(value * 10)::bigint // 60, floor(value * 10)::bigint % 60) mmss,
  printf('%02d:%02d:%02d', round(value * 100)::bigint // 3600, round(value * 100)::bigint % 3600 // 60, round(value * 100)::bigint % 60) hhmmss,
  case when value / 100 >= 0.8 then 'confirmed' when value / 100 <= 0.2 then 'rejected' else 'professor_check' end status from events"""


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", bit.alias("hash"))


def hash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next of its label: bits in which their signs differ, cosine and mean difference."""
    rows = _signs(spark, sf_dir)
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = rows.withColumns({"h2": F.lead("hash").over(by), "e2": F.lead("embedding").over(by)}).filter("h2 is not null")
    return rows.select("vec_id", numbers.hash_distance(F.col("hash"), F.col("h2")).alias("bits"), F.round(nested.cosine(F.col("embedding"), F.col("e2")), 4).alias("cosine"), F.round(nested.mean_difference(F.col("embedding"), F.col("e2")), 4).alias("mse"))


HASHES = """
with e as (select vec_id, label, embedding a, lead(embedding) over (partition by label order by vec_id) b from embeddings),
p as (select vec_id, list_zip(a, b) z from e where b is not null),
s as (select vec_id, list_sum(list_transform(z, lambda t: ((t[1] > 0) <> (t[2] > 0))::int))::int bits, list_sum(list_transform(z, lambda t: (t[1]::float * t[2]::float)::double)) ab,
  list_sum(list_transform(z, lambda t: (t[1]::float * t[1]::float)::double)) aa, list_sum(list_transform(z, lambda t: (t[2]::float * t[2]::float)::double)) bb, list_sum(list_transform(z, lambda t: ((t[1] - t[2]) * (t[1] - t[2]))::double)) d from p)
select vec_id, bits, round(ab / (sqrt(aa) * sqrt(bb)), 4) cosine, round(d / 64, 4) mse from s"""


def scene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a long first line as scenes of one slide: component, visit order, canonical."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.split("text", "\n")[0].alias("line"))
    long = docs.filter(F.length("line") >= 8)
    low = long.groupBy("line").agg(F.min("doc_id").alias("a"))
    edges = long.join(low, "line").select("a", F.col("doc_id").alias("b")).filter("a <> b")
    return graph.grouped_scenes(docs.select("doc_id", "n_chars"), edges, "doc_id", "n_chars")


SCENES = """
with d as (select doc_id, n_chars, string_split(text, chr(10))[1] line from documents),
c as (select doc_id, n_chars, case when length(line) >= 8 then min(doc_id) over (partition by line) else doc_id end component from d)
select doc_id, n_chars, component, row_number() over w visit_order, lag(doc_id) over w "previous", lead(doc_id) over w "next", count(*) over (partition by component) group_size,
  first(doc_id) over (partition by component order by n_chars, doc_id rows between unbounded preceding and unbounded following) canonical from c window w as (partition by component order by doc_id)"""


def adjacent_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events, each within a day of the one before, by their first event."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.withColumn("merged", F.abs(F.col("sec") - F.lag("sec").over(by)) <= 86400)
    return graph.adjacent_components(rows, ["user_id"], "event_id", "merged").select("event_id", "component")


ADJACENT = """
with e as (select event_id, user_id, floor(epoch(ts))::bigint sec from events),
m as (select *, case when abs(sec - lag(sec) over (partition by user_id order by event_id)) <= 86400 then null else event_id end s from e)
select event_id, last_value(s ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) component from m"""


def pair_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part numbers within an order, with how many orders have them; pairs of neighbours are marked."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("parts"))
    pairs = orders.select(F.explode(nested.pair_keys(F.col("parts"))).alias("p"))
    out = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("orders"))
    return out.withColumn("adjacent", nested.adjacent_pair(F.array("a", "b")))


PAIRS = """
with p as (select distinct l_orderkey, l_partkey % 50 x from lineitem)
select l.x a, r.x b, count(*) orders, r.x - l.x = 1 adjacent from p l join p r on l.l_orderkey = r.l_orderkey and l.x < r.x group by all"""

QUERIES = {f.__name__: f for f in (compact_texts, sentence_counts, passage_lists, passage_ranks, similar_turns, bracket_checks, claim_types, glossary_terms, page_texts, safe_numbers, hash_distances, scene_groups, adjacent_scenes, pair_conflicts)}
ORACLES = {
    "compact_texts": COMPACT,
    "sentence_counts": SENTENCES,
    "passage_ranks": PASSAGES,
    "similar_turns": SIMILAR,
    "bracket_checks": BRACKETS,
    "claim_types": CLAIM_TYPES,
    "glossary_terms": GLOSSARY,
    "page_texts": PAGE_TEXTS,
    "safe_numbers": SAFE,
    "hash_distances": HASHES,
    "scene_groups": SCENES,
    "adjacent_scenes": ADJACENT,
    "pair_conflicts": PAIRS,
}
