"""Literal cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.functions import nested, numbers, text
from evidentia.operators import dedupe, evidence, graph, joins, stats, timeline, votes


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_consensus(spark):
    cases = {"C1": (3, [0.9, 0.8], "partial_agreement", True), "C2": (3, [0.86], "single_model_strong", True), "C3": (3, [0.75], "rejected_single_model_low_confidence", False), "C4": (3, [0.71, 0.72, 0.73], "all_models_agreed", True), "C5": (3, [], "no_issue", False), "C6": (5, [0.8, 0.8], "rejected_below_majority", False), "C7": (4, [0.7, 0.7], "partial_agreement", True), "C8": (0, [], "all_models_failed", False)}
    rows = [(c, f"m{k}", v, True, n) for c, (n, scores, _, _) in cases.items() for k, v in enumerate(scores)]
    rows += [(c, "m9", 0.0, False, n) for c, (n, scores, _, _) in cases.items() if not scores]
    out = votes.consensus(spark.createDataFrame(rows, "claim string, model string, c double, raised boolean, n long"), "claim", "model", "c", "raised", F.col("n"))
    assert {r.claim: (r.status, r.keep) for r in out.collect()} == {c: (s, k) for c, (_, _, s, k) in cases.items()}


def test_ensemble(spark):
    verdicts = spark.createDataFrame([(1, "a", "factual", 0.6), (1, "a", "temporal", 0.4), (1, "b", "factual", 0.5), (1, "b", "temporal", 0.5), (2, "a", "factual", 0.52), (2, "a", "temporal", 0.48), (2, "b", "factual", 0.52), (2, "b", "temporal", 0.48)], "issue int, model string, kind string, p double")
    scores = votes.weighted_types(verdicts, "issue", "model", "kind", "p", 2)
    tops = spark.createDataFrame([(1, "factual"), (1, "factual"), (2, "factual"), (2, "factual")], "issue int, top string")
    out = {r.issue: r for r in votes.final_types(scores, tops, "issue", "kind", F.col("kind"), 2).collect()}
    assert (out[1].top_score, out[1].margin, out[1].low_margin, out[1].final_type) == (0.55, 0.1, False, "factual")
    assert (out[2].margin, out[2].final_type, out[2].reasons) == (0.04, "composite_issue", "low_margin")


def test_severity_and_delta(spark):
    df = spark.createDataFrame([(1, 0.9, 0.8, 0.75), (1, 1.0, 1.0, 1.0)], "i int, v double, s double, u double")
    df = df.withColumn("score", numbers.model_score(F.col("v"), F.col("s"), F.col("u")))
    out = votes.severity(df, ["i"], "score", F.lit(2)).first()
    assert (out.final_score, out.disagreement, out.flagged, out.status) == (0.77, 0.46, True, "professor_check")
    new, moved = numbers.soft_delta(F.col("x"), F.lit("refutes"))
    assert tuple(one(spark, 0.05, "double").select(new, moved).first()) == (0.0, -0.05)
    assert [one(spark, x, "double").select(numbers.status_of(F.col("x"))).first()[0] for x in (0.8, 0.2, 0.5)] == ["confirmed", "rejected", "professor_check"]


def test_composite(spark):
    df = spark.createDataFrame([(1, "factual", 0.3, 0.8), (1, "scope", 0.1, 0.4), (2, "a", 0.0, 1.0), (2, "b", 0.0, 0.5)], "i int, k string, w double, s double")
    out = {r.i: (r.expected, r.primary_type) for r in votes.composite(df, "i", "k", "w", "s").collect()}
    assert out == {1: (0.7, "factual"), 2: (0.75, "a")}


def test_point_in_range_and_nearest(spark):
    scenes = spark.createDataFrame([(1, 1.0, 1), (1, 5.0, 2)], "k int, at double, scene int")
    points = spark.createDataFrame([(1, 1.0), (1, 5.0), (1, 0.0), (1, 9.0)], "k int, t double")
    got = joins.point_in_range(points, scenes, ["k"], "t", "at", "at", "scene")
    assert {r.t: r.scene for r in got.collect()} == {1.0: 1, 5.0: 2, 0.0: 1, 9.0: 2}
    frames = spark.createDataFrame([(1, 10, 5), (1, 20, 10)], "k int, f int, s int")
    asked = spark.createDataFrame([(1, 14), (1, 15), (1, 99)], "k int, q int")
    assert {r.q: r.s for r in joins.nearest(asked, frames, ["k"], "q", "f", "s").collect()} == {14: 5, 15: 10, 99: 10}


def test_overlap_assign(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 20.0)], "k int, occ int, start_sec double, end_sec double")
    cases = {(9.5, 12.0): 2, (5.0, 10.1): 1, (8.0, 10.3): 2, (21.0, 22.0): 2, (25.0, 26.0): None}
    seg = spark.createDataFrame([(1, n, a, b) for n, (a, b) in enumerate(cases)], "k int, seg int, start_sec double, end_sec double")
    got = {r.seg: r.occ for r in joins.overlap_assign(seg, spans, ["k"], "seg", "occ", 10.0).collect()}
    assert got == dict(enumerate(cases.values()))


@pytest.mark.parametrize(("kinds", "want"), [([("slide", 0, 20), ("video", 20, 28), ("slide", 28, 48)], [("slide", 0, 48)]), ([("slide", 0, 20), ("video", 20, 28)], [("slide", 0, 20), ("video", 20, 28)]), ([("slide", 0, 20), ("video", 20, 28), ("unknown", 28, 48)], [("slide", 0, 20), ("video", 20, 28), ("unknown", 28, 48)])])
def test_absorbed(spark, kinds, want):
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, a, b in kinds], "v int, kind string, s double, e double")
    assert [(r.kind, r.s, r.e) for r in timeline.absorbed(df, ["v"], "kind", "s", "e", 12.0).orderBy("segment").collect()] == want


def test_gap_clusters_and_ranges(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 2, 4, 9, 11)], "k int, t double")
    got = timeline.clusters(df, ["k"], F.col("t"), ["t"], 3.0).collect()
    assert [(r.members, r.first_at, r.last_at, r.middle) for r in got] == [(3, 0.0, 4.0, 1)]
    starts = spark.createDataFrame([(1, float(t)) for t in (0, 10, 25)], "k int, s double")
    assert [r.end_sec for r in timeline.next_start_ranges(starts, ["k"], "s", ["s"], F.lit(40.0)).orderBy("s").collect()] == [10.0, 25.0, 40.0]


def test_components(spark):
    scenes = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, 0.1), (4, 0.0), (5, 0.1)], "scene int, ratio double")
    edges = spark.createDataFrame([(1, 3), (3, 5), (5, 5), (None, 2)], "a int, b int")
    got = {r.scene: r for r in graph.grouped_scenes(scenes, edges, "scene", "ratio").collect()}
    assert {s: r.component for s, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1}
    assert [got[s].visit_order for s in (1, 3, 5)] == [1, 2, 3] and got[5].previous == 3 and got[1].canonical == 3
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    assert graph.connected_components(chain).select("component").distinct().count() == 1
    assert graph.connected_components(chain.filter("a < 0")).count() == 0


def test_text_cases(spark):
    def merge(a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(text.text_merge(F.col("a"), F.col("b"))).first()[0]

    assert [merge("abcdefghij", x) for x in ("abcdefghix", "abcdefghxy", "abcdefgxyz", "")] == ["merge", "uncertain", "reject", "unavailable"]
    assert merge("A B", "ab") == "merge"
    assert [one(spark, x).select(text.bracket_mismatch(F.col("x"))).first()[0] for x in ("(a[b])", "(a]", "a)", "((")] == [None, "mismatch", "no_opener", "unclosed"]
    assert [one(spark, x).select(text.claim_type(F.col("x"))).first()[0] for x in ("numeric", "no_claim", "a recent one", None, "수치")] == ["numeric", None, "currentness", "definition", "numeric"]
    pair = spark.createDataFrame([("the cat sat", "the cat ran"), ("a b", "ab c"), ("x", "y")], "a string, b string")
    assert [r[0] for r in pair.select(text.similar_claims(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert one(spark, "한").select(text.final_consonant(F.col("x"))).first()[0] == 4
    assert one(spark, "```json\n{\"a\": 1}\n```").select(text.without_fence(F.col("x"))).first()[0] == '{"a": 1}'
    assert one(spark, "a" * 500 + "\n" + "b" * 300 + "\n" + "c" * 500).select(F.size(text.passages(F.col("x")))).first()[0] == 2


def test_keep_best_and_runs(spark):
    df = spark.createDataFrame([("k", 0.7, 1), ("k", 0.9, 2), ("k", 0.9, 3)], "k string, c double, seq int")
    assert dedupe.keep_best(df, ["k"], "c", "seq").first().seq == 2
    rows = [("a", r, 0.6) for r in range(3)] + [("b", r, 0.9) for r in range(2)] + [("c", r, 0.8) for r in range(2)]
    out = dedupe.merged_runs(spark.createDataFrame(rows, "k string, run int, c double"), ["k"], "run", "c", 5)
    assert {r.k for r in out.collect()} == {"a", "b"}


def test_statistics(spark):
    df = spark.createDataFrame([(899.0,), (900.0,), (None,), (0.0,)], "d double")
    assert {(r.bucket, r.lecture_count) for r in stats.bucket_view(df, "d", 900, 8).collect()} == {(0, 1), (1, 1)}
    counts = spark.createDataFrame([(f"w{k:02}", 100 - k) for k in range(25)], "keyword string, total_count long")
    scores = {r["rank"]: r.score for r in stats.keyword_scores(counts).collect()}
    assert [scores[r] for r in (1, 4, 5, 17, 20)] == [5, 5, 4, 1, 1] and 21 not in scores
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert four.select(F.percentile("x", F.lit(0.9))).first()[0] == pytest.approx(3.7)


def test_source_trust(spark):
    cases = {"https://docs.python.org/3/": ("official_docs", 1, True), "https://ko.wikipedia.org/wiki/X": ("encyclopedia", 5, True), "https://blog.naver.com/a": ("blog", None, False), "https://example.com": ("secondary", None, False), "https://medialearn.com/x": ("official_docs", 1, True)}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.trust_level, r.priority, r.eligible) for r in evidence.with_trust(df, "url").collect()}
    assert got == cases
    assert {r.category for r in evidence.prefiltered(spark.createDataFrame([("ftp://x.org",), ("",), ("https://w3.org",)], "url string"), "url").collect()} == {"invalid_url", "accepted"}


def test_speech_chunks(spark):
    cuts = spark.createDataFrame([(1, 40.0, 43.0, 100.0)], "k int, s double, e double, total double")
    pieces = timeline.complement(cuts, ["k"], "s", "e", "total")
    assert [(r.lo, r.hi) for r in pieces.orderBy("piece").collect()] == [(0.0, 40.0), (43.0, 100.0)]
    assert [(round(r.lo, 6), round(r.hi, 6)) for r in timeline.padded(pieces, ["k"], 0.1, 100.0).orderBy("piece").collect()] == [(0.0, 40.1), (42.9, 100.0)]
    assert {r.chunk for r in timeline.speech_chunks(pieces, ["k"]).collect()} == {0}
    assert [r.offset for r in timeline.time_map(pieces, ["k"], "lo", "hi").orderBy("lo").collect()] == [0.0, 40.0]


def test_numbers(spark):
    df = spark.createDataFrame([("abc",), ("nan",), ("1.5",), (None,)], "x string")
    assert [r[0] for r in df.select(numbers.clamp01(F.col("x"))).collect()] == [0.0, 0.0, 1.0, 0.0]
    assert one(spark, 3725.4, "double").select(numbers.hours_text(F.col("x")), numbers.minutes_text(F.col("x"))).first() == ("01:02:05", "62:05")
    assert spark.sql("select 5L a, 6L b").select(numbers.hash_distance(F.col("a"), F.col("b"))).first()[0] == 2
    maps = spark.sql("select map('a', 1D, 'b', 3D) m, map('a', -1D) bad, map('a', 0D) zero")
    assert maps.select(nested.normalised(F.col("m"))).first()[0] == {"a": 0.25, "b": 0.75}
    assert tuple(maps.select(nested.normalised(F.col("bad")), nested.normalised(F.col("zero"))).first()) == (None, None)
    assert spark.sql("select array(3, 1, 3, 2) x").select(F.size(nested.pair_keys(F.col("x")))).first()[0] == 3
    bands = stats.audio_quality(spark.createDataFrame([(0.2, None), (0.01, 9.0)], "v double, w double"), {"v": (0.05, 0.5, (0.15, 0.35)), "w": (5, 35, (10.0, 25.0))})
    assert [(r.overall, r.grade) for r in bands.collect()] == [(100.0, "A"), (55.0, "D")]


def test_greedy_operators(spark):
    rows = spark.createDataFrame([(1, k, 100, k % 2 == 1) for k in range(6)], "c int, t int, chars int, ends boolean")
    got = [r.context for r in timeline.context_groups(rows, ["c"], ["t"], "chars", "ends", 200, 600).orderBy("t").collect()]
    assert got == [0, 0, 1, 1, 2, 2]
    spaced = timeline.spaced(spark.createDataFrame([(1, x) for x in (0.0, 0.4, 0.6, 1.1)], "k int, t double"), ["k"], "t", 0.5)
    assert sorted(r.t for r in spaced.collect()) == [0.0, 0.6]
    packed = timeline.packed(spark.createDataFrame([(1, k, 1.0, 300.0) for k in range(4)], "k int, o int, a double, b double"), ["k"], ["o"], ["a", "b"], [3.0, 500.0])
    assert sorted(r.batch for r in packed.collect()) == [0, 1, 2, 3]
