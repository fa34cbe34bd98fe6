"""Queries over the boundary to external compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import blocks, external, frames
from evidentia.operators import hamming
from evidentia.sources.session import table

MODELS = ["reviewer-a", "reviewer-b", "reviewer-c"]


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every embedding, read as a frame of eight by eight."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", frames.features(F.col("embedding"), 8).alias("f"))
    return rows.select("vec_id", F.round("f.mean", 6).alias("mean"), F.round("f.deviation", 5).alias("deviation"), "f.difference_hash", F.round("f.edges", 6).alias("edges"))


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each embedding against the next of its label."""
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("other", F.lead("embedding").over(by)).filter("other is not null")
    rows = rows.select("vec_id", frames.pair_metrics(F.col("embedding"), F.col("other")).alias("m"))
    return rows.select("vec_id", F.round("m.mse", 4).alias("mse"), F.round("m.changed", 6).alias("changed"), F.round("m.histogram", 4).alias("histogram"))


def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes of every vector as a frame of eight by eight, and how far the next of its label is from it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", frames.perceptual_hash(F.col("embedding"), 8, 8).alias("hash"))
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = rows.withColumns({"after": F.lead("hash").over(by), "other": F.lead("embedding").over(by)})
    overlap = frames.edge_overlap(F.col("embedding"), F.col("other"), 8, 0.4)
    return rows.select("vec_id", hamming.digits(F.col("hash")).alias("hash"), hamming.distance(F.col("hash"), F.col("after")).alias("away"), F.round(overlap, 6).alias("edge_overlap"))


def model_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stand-in reviewers on every benchmark text, failures as rows."""
    return external.reviewed(table(spark, sf_dir, "benchmark"), "item_id", "text", MODELS)


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reviewers answered for each text and their mean confidence."""
    return external.stitched(model_reviews(spark, sf_dir), MODELS, "item_id")


def turn_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks ratio of each turn's whole text against the turn before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("previous", before).filter("previous is not null")
    return rows.select("conv_id", "turn", F.round(blocks.matching_ratio(F.col("text"), F.col("previous")), 6).alias("ratio"))


QUERIES = {"frame_features": frame_features, "frame_hashes": frame_hashes, "frame_pairs": frame_pairs, "model_reviews": model_reviews, "review_summary": review_summary, "turn_ratios": turn_ratios}
_SHA = "sha256('{m}' || chr(10) || coalesce(text, ''))"
_N = "('0x' || left(sha256(model || chr(10) || coalesce(text, '')), 12))::bigint"
_REVIEWS = f"select item_id, model, case when n % 23 = 0 then 'failed' else 'ok' end status, case when n % 23 <> 0 then round(n % 10007 / 10006, 6) end confidence, case when n % 23 = 0 then 'the model gave no answer' end reason from (select item_id, model, {_N} n from benchmark, (select unnest({MODELS}) model))"
#: Cells of a frame that lie within a reach of each cell, and a mask grown by it.
_NEAR = "list_transform(range(64), lambda i: list_filter(range(64), lambda j: abs(i // 8 - j // 8) <= {r} and abs(i % 8 - j % 8) <= {r}))"
_GROWN = "list_transform({near}, lambda n: list_bool_or(list_transform(n, lambda j: {mask}[j + 1])))"
ORACLES = {
    "frame_features": """
with f as (select vec_id, embedding::double[] f from embeddings), s as (select *, list_filter(range(64), lambda i: i % 8 < 7) i from f)
select vec_id, round(list_avg(f), 6) mean, round(list_stddev_pop(f), 5) deviation, list_sum(list_transform(i, lambda k, n: case when f[k + 2] > f[k + 1] then 1::bigint << (56 - n)::int else 0 end))::bigint difference_hash,
  round(list_avg(list_transform(i, lambda k: (abs(f[k + 2] - f[k + 1]) > 1)::int)), 6) edges from s""",
    "frame_hashes": f"""
with c as (select list_transform(range(8), lambda u: list_transform(range(8), lambda x: 2 * cos(pi() * u * (2 * x + 1) / 16))) c, {_NEAR.format(r=1)} one, {_NEAR.format(r=2)} two),
f as (select vec_id, label, embedding::double[] f, c, one, two from embeddings, c),
a as (select *, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda y: f[k // 8 * 8 + y + 1] * c[k % 8 + 1][y + 1]))) a from f),
d as (select *, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda x: c[k // 8 + 1][x + 1] * a[x * 8 + k % 8 + 1]))) d,
  list_transform(range(64), lambda k: (k % 8 < 7 and abs(f[k + 2] - f[k + 1]) > 0.4) or (k < 56 and abs(f[k + 9] - f[k + 1]) > 0.4)) e from a),
h as (select vec_id, label, two, array_to_string(list_transform(d, lambda x: case when x > list_median(d) then '1' else '0' end), '') h, {_GROWN.format(near='one', mask='e')} e from d),
w as (select *, {_GROWN.format(near='two', mask='e')} g from h),
n as (select *, lead(h) over w h2, lead(e) over w e2, lead(g) over w g2 from w window w as (partition by label order by vec_id))
select vec_id, array_to_string(list_transform(range(16), lambda k: substring('0123456789ABCDEF', (substring(h, (k * 4 + 1)::int, 4)::bit::int + 1)::int, 1)), '') hash, bit_count(xor(h::bit, h2::bit))::int away,
  case when e2 is not null then round(least(list_sum(list_transform(range(64), lambda k: (e[k + 1] and g2[k + 1])::int)) / greatest(list_sum(list_transform(e, lambda x: x::int)), 1),
    list_sum(list_transform(range(64), lambda k: (e2[k + 1] and g[k + 1])::int)) / greatest(list_sum(list_transform(e2, lambda x: x::int)), 1)), 6) end edge_overlap from n""",
    "frame_pairs": """
with e as (select vec_id, embedding a, lead(embedding) over (partition by label order by vec_id) b from embeddings),
z as (select vec_id, list_zip(a, b) z, a, b, least(list_min(a), list_min(b))::double lo, greatest(list_max(a), list_max(b))::double + 1e-9 hi from e where b is not null),
h as (select *, list_transform(generate_series(0, 15), lambda k: len(list_filter(a, lambda x: least(15, floor((x::double - lo) / (hi - lo) * 16)) = k))) ha, list_transform(generate_series(0, 15), lambda k: len(list_filter(b, lambda x: least(15, floor((x::double - lo) / (hi - lo) * 16)) = k))) hb from z),
d as (select *, list_transform(list_zip(ha, hb), lambda t: (t[1] - 4.0) * (t[2] - 4.0)) xy, list_transform(ha, lambda t: (t - 4.0) * (t - 4.0)) xx, list_transform(hb, lambda t: (t - 4.0) * (t - 4.0)) yy from h)
select vec_id, round(list_avg(list_transform(z, lambda t: (t[1]::double - t[2]::double) ** 2)), 4) mse, round(list_avg(list_transform(z, lambda t: (abs(t[1]::double - t[2]::double) > 1)::int)), 6) changed,
  round(list_sum(xy) / sqrt(list_sum(xx)::double * list_sum(yy)::double), 4) histogram from d""",
    "model_reviews": _REVIEWS,
    "review_summary": f"select item_id, count(*) filter (status = 'ok') answered, round(avg(confidence), 6) mean_confidence, count(*) filter (status = 'ok') = 3 complete from ({_REVIEWS}) group by item_id",
}
