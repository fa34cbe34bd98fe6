"""Answers, kept evidence, stage times and shown files on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evidentia.functions import timings
from evidentia.operators import answers


def test_assessed(spark):
    excerpts = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "a"), (None, "a"), (3, "a")], "k int, s string")
    rows = [{"source_id": " a ", "relation": "Supports_Claim", "confidence": 2}, {"source_id": "a", "relation": "irrelevant"}, {"source_id": "z", "relation": "supports_claim"}, {"source_id": "b", "relation": "odd", "confidence": "x"}, {"source_id": None}]
    told = spark.createDataFrame([(1, json.dumps({"assessments": rows})), (2, "no json"), (None, json.dumps({"assessments": rows})), (3, None)], "k int, payload string")
    got = sorted((str(r.k), str(r.s), r.relation, r.confidence, r.answered) for r in answers.assessed(excerpts, told, ["k"], "s", "payload").collect())
    none = ("irrelevant", 0.0, False)
    assert got == sorted([("1", "a", "supports_claim", 1.0, True)] * 2 + [("1", "b", "irrelevant", 0.0, True), ("1", "None", *none), ("2", "a", *none), ("3", "a", *none), ("None", "a", *none)])


def test_kept_evidence(spark):
    rows = [
        (1, "a", True, 3, "u", "supports_claim", 0.9),
        (1, "b", None, 1, "u", "contradicts_claim", 1.0),
        (1, "c", True, None, None, "supports_claim", 0.9),
        (1, "d", True, 0, None, "supports_claim", 0.9),
        (1, "e", True, 1, "u", "irrelevant", 1.0),
        (2, "a", True, 1, "u", "supports_claim", 0.1),
        (None, "a", True, 1, "u", "supports_claim", 0.5),
    ]
    df = spark.createDataFrame(rows, "k int, s string, strong boolean, p int, u string, relation string, confidence double")
    kept = lambda d: {r.k: (r.status, r.mixed, [e.source for e in r.evidence or []]) for r in answers.kept_evidence(d, "k", "s", "strong", "p", "u", 0.5, 3).collect()}
    assert kept(df) == {1: ("verified", True, ["a", "c", "d"]), 2: ("insufficient_evidence", False, []), None: ("verified", False, ["a"])}
    assert kept(df.limit(0)) == {}


def test_search_traces(spark):
    deep = "[" * 200_000 + "]" * 200_000
    one = json.dumps([{"type": "web_search_call", "query": " q ", "x": {"URL": "http://a", "query": "q"}}, {"type": None, "url": ["http://b"], "searchQuery": "r"}, "http://c"])
    df = spark.createDataFrame([(0, one), (1, None), (2, "{"), (3, deep), (4, "")], "i int, payload string")
    got = {r.i: (r.t.calls, r.t.queries, r.t.urls) for r in df.select("i", answers.search_traces(F.col("payload")).alias("t")).collect()}
    assert got == {0: (1, ["q", "r"], ["http://a"]), **{i: (0, [], []) for i in (1, 2, 3, 4)}}


def test_stage_seconds(spark):
    df = spark.createDataFrame(
        [
            ({"P1 x total": 1.5, "P1A total": 9.0, "P2 totals": 9.0, "V1 a": 1.0, "V2B x": None, "V2 run_verifier": 7.0}, [3.0, 0.0, None], 5.0),
            ({"V2 run_verifier": 7.0, "P3 total": float("nan")}, [], None),
            (None, None, 0.0),
        ],
        "times map<string,double>, runs array<double>, whole double",
    )
    got = [tuple(r.t) for r in df.select(timings.stage_seconds(F.col("times"), F.col("runs"), F.col("whole")).alias("t")).collect()]
    assert got == [(1.5, 1.0, 3.0), (None, 7.0, 7.0), (None, None, None)]


def test_views(spark):
    view = spark.createDataFrame([("b", 2, 4, 0), ("a", 1, 2, None), ("z", 0, 9, 9)], "label string, rows int, x int, y int")
    row = answers.comparison(view, "label", "rows", ["x", "y"]).select(timings.leading_types(F.col("totals"), ["y", "x", "w"]).alias("t"), "most_label", "most_mean").first()
    assert ([tuple(x) for x in row.t], row.most_label, row.most_mean) == ([("x", 15), ("y", 9)], "a", 2.0)
    assert answers.comparison(view.limit(0), "label", "rows", ["x", "y"]).first().most_label is None
    times = spark.createDataFrame([(10.0, 5.0, 20.0), (None, 8.0, 40.0)], "a double, b double, n double")
    assert tuple(answers.trend(times, "a", "b", "n").first()) == (23.0, 10.0, 3.0)
    assert tuple(answers.trend(times.limit(0), "a", "b", "n").first()) == (0.0, None, None)


def test_breakdown(spark):
    items = spark.createDataFrame([(1, "c", "x"), (1, "c", "x"), (1, None, "x"), (1, "c", None), (1, "c", "odd")], "k int, bucket string, kind string")
    more = spark.createDataFrame([(1, "c", 3), (2, "r", 0), (3, "r", None)], "k int, bucket string, n long")
    assert sorted(tuple(r) for r in answers.breakdown(items, more, ["k"], "bucket", "kind", ["x"], "x").collect()) == [(1, "c", "x", 5)]


def test_shown_files(spark):
    files = list("abcde")
    rows = [
        ("same_slide_build", files, None, "", None, ["a", "e"]),
        ("same_slide_build", files, None, "e", None, ["e", "a"]),
        ("same_slide_build", [], None, None, None, []),
        ("same_slide_duplicate", files, None, None, None, ["a", "c", "e"]),
        ("same_slide_duplicate", files[:3], None, None, None, ["a", "b", "c"]),
        ("transition_noise", files, 5, None, None, ["d", "e"]),
        ("transition_noise", files, 9, None, None, ["a", "b", "c"]),
        ("other", files, None, None, None, files),
    ]
    df = spark.createDataFrame([(i, k, f, [j + 1 for j in range(len(f))], [m], b, a) for i, (k, f, m, b, a, _) in enumerate(rows)], "i int, kind string, files array<string>, scenes array<int>, middle array<int>, b string, a string")
    got = {r.i: r.shown for r in df.select("i", timings.shown_files(*[F.col(c) for c in ("kind", "files", "scenes", "middle", "b", "a")]).alias("shown")).collect()}
    assert got == {i: row[-1] for i, row in enumerate(rows)}


def test_change_reason(spark):
    limits = timings.ChangeLimits(cut=1.0, cut_hash=4, base=0.5, base_share=0.3, strong_share=0.9, base_hash=10, fade=2.0, fade_hash=8)
    none, small = None, (0.0, 0.0, 0)
    rows = [
        (None, none, none, none, None),
        (False, (1.0, 0.0, 4), (9.0, 1.0, 9), none, "cut"),
        (True, (1.0, 0.0, 4), (9.0, 1.0, 9), none, None),
        (False, small, (0.5, 0.3, 0), none, "structure"),
        (False, small, (0.0, 0.9, 5), none, "structure"),
        (False, (0.5, 0.0, 0), (0.0, 0.0, 10), none, "base"),
        (False, small, (0.0, 0.0, 10), (2.0, 0.0, 8), "fade"),
    ]
    gap = "struct<square:double,share:double,bits:int>"
    df = spark.createDataFrame(rows, f"same boolean, p {gap}, b {gap}, o {gap}, want string")
    assert all(r.got == r.want for r in df.select(timings.change_reason(*[F.col(c) for c in ("same", "p", "b", "o")], limits).alias("got"), "want").collect())
