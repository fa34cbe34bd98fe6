"""Queries over frames: rasters of pages, their hashes and what looks alike."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import external
from evidentia.operators import hamming, joins, machines
from evidentia.sources import frames
from evidentia.sources.session import shared_dir, stored, table

#: Bits of a raster's hash, and the distance within which two frames are one slide.
BITS, WITHIN = 256, 8


def visual_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames: hashes of 256 bits, and classes of frames within 8 bits of one another."""
    cells = table(spark, sf_dir, "documents").select("doc_id", external.raster(F.col("text"), BITS + 1).alias("cells"))
    rows = stored(cells.select("doc_id", hamming.difference_hash(F.col("cells"), BITS).alias("words")))
    out = hamming.classes(rows, "doc_id", "words", WITHIN)
    return out.select("doc_id", hamming.digits(F.col("words")).alias("hash"), "representative", "class_size")


#: Thresholds on mean squared differences of the frames of one recording.
CUT, BASE, STILL, SAME, RIPE, MOST = 0.033, 0.032, 0.03, 0.028, 2, 5


def scene_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as the frames of one recording: the bases of its scenes, numbered, when and why they were told."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("recording").alias("recording"), "vec_id", F.col("embedding").cast("array<double>").alias("frame"))
    machine = machines.SceneDecisions("long", CUT, BASE, STILL, SAME, RIPE, MOST)
    found = machines.piecewise(rows, ["recording"], ["vec_id"], ["vec_id", "frame"], machine)
    number = F.row_number().over(Window.partitionBy("recording").orderBy("at"))
    return found.select(number.cast("long").alias("scene"), "at", "told_at", "reason")


def cached_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors kept as a cache of frames: what a range of positions and some single ones read back."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), (F.col("label") / 2).alias("at"), F.encode(F.array_join(F.transform(F.slice("embedding", 1, 8), lambda x: (x * 1000).cast("int").cast("string")), ","), "utf-8").alias("frame"))
    path = f"{shared_dir(spark).rstrip('/')}/frames-{uuid4().hex}"
    frames.write_cache(rows, path, 16)
    chosen = frames.read_cache(spark, path, 40, 140).unionByName(frames.read_cache(spark, path, positions=[3, 7, 200, 401]))
    return chosen.select("position", "at", F.decode("frame", "utf-8").alias("frame"))


def overlapping_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose range of balances meets a supplier's, of any width and without a common key, counted by supplier."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("c_lo"), (F.col("c_acctbal") + F.col("c_custkey") % 50).alias("c_hi"))
    wide = F.when(F.col("s_suppkey") % 10 == 0, 4000.0).otherwise((F.col("s_suppkey") % 30).cast("double"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("s_lo"), (F.col("s_acctbal") + wide).alias("s_hi"))
    met = joins.overlapping(customers, suppliers, ("c_lo", "c_hi"), ("s_lo", "s_hi"), 16.0)
    return met.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.sum("c_custkey").alias("total"))


QUERIES = {"visual_duplicates": visual_duplicates, "scene_decisions": scene_decisions, "cached_frames": cached_frames, "overlapping_balances": overlapping_balances}
_HASH = f"""
with recursive d as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n from documents),
c as (select doc_id, list_transform(range({BITS + 1}), lambda k: substring(t, (k * n // {BITS + 1} + 1)::int, ((k + 1) * n // {BITS + 1} - k * n // {BITS + 1})::int)) c from d),
v as (select doc_id, list_transform(c, lambda x: 1000 * (length(x) - length(translate(x, '{external.INK}', ''))) // greatest(length(x), 1)) v from c),
h as (select doc_id, array_to_string(list_transform(range({BITS}), lambda k: case when v[k + 1] < v[k + 2] then '1' else '0' end), '') h from v)"""
_GAP = "list_avg(list_transform(list_zip({0}, {1}), lambda z: (z[1]::double - z[2]::double) ** 2))"
ORACLES = {
    "cached_frames": """
select vec_id "position", label / 2::double "at", array_to_string(list_transform(embedding[1:8], lambda x: trunc(x * 1000::float)::int), ',') frame
from embeddings where vec_id >= 40 and vec_id < 140 or vec_id in (3, 7, 200, 401)""",
    "overlapping_balances": """
with c as (select c_custkey, c_acctbal lo, c_acctbal + c_custkey % 50 hi from customer),
s as (select s_suppkey, s_acctbal lo, s_acctbal + case when s_suppkey % 10 = 0 then 4000.0 else s_suppkey % 30 end::double hi from supplier)
select s_suppkey, count(*) n, min(c_custkey) "first", sum(c_custkey)::bigint total from c join s on c.lo < s.hi and s.lo < c.hi group by 1""",
    "scene_decisions": f"""
with recursive r as (select vec_id, embedding::double[] f, row_number() over (order by vec_id) i from embeddings),
m as (
  select 1::bigint i, f base, f before, null::bigint begun, f cand, 0 ripe, 0 seen, vec_id "at", vec_id told_at, 'first_frame' reason from r where i = 1
  union all
  select i, case when fresh then c else base end, case when fresh then c when done then base when open then before else f end, case when done then null when open then begun when starts then vec_id end,
    case when open then c else f end, case when open then n else 1 end, case when open then k else 1 end,
    case when fresh then begun end, case when fresh then vec_id end, case when fresh then case when n >= {RIPE} then 'stabilized' else 'timeout' end end
  from (
    select *, open and (n >= {RIPE} or k >= {MOST}) done, open and (n >= {RIPE} or k >= {MOST}) and {_GAP.format('base', 'c')} >= {SAME} fresh from (
      select r.i, r.vec_id, r.f, base, before, begun, begun is not null open, begun is null and ({_GAP.format('before', 'r.f')} >= {CUT} or {_GAP.format('base', 'r.f')} >= {BASE}) starts,
        case when {_GAP.format('cand', 'r.f')} <= {STILL} then cand else r.f end c, case when {_GAP.format('cand', 'r.f')} <= {STILL} then ripe + 1 else 1 end n, seen + 1 k
      from m join r on r.i = m.i + 1)))
select row_number() over (order by "at") scene, "at", told_at, reason from m where reason is not null""",
    "visual_duplicates": f"""{_HASH},
u as (select h, min(doc_id) node from h group by h),
e as (select a.node a, b.node b from u a join u b on a.node < b.node and bit_count(xor(a.h::bit, b.h::bit)) <= {WITHIN}),
r as (select node x, node y from u union select r.x, case when e.a = r.y then e.b else e.a end from r join e on e.a = r.y or e.b = r.y),
m as (select x node, min(y) rep from r group by x),
o as (select doc_id, array_to_string(list_transform(range({BITS // 4}), lambda k: substring('0123456789ABCDEF', (substring(h, (k * 4 + 1)::int, 4)::bit::int + 1)::int, 1)), '') hash, rep from h join u using (h) join m using (node))
select doc_id, hash, rep representative, count(*) over (partition by rep) class_size from o""",
}
