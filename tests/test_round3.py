"""Findings of the third round: long texts, many boxes, and plans that read or join no more than they need."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from evidentia.functions import external, payloads, text
from evidentia.operators import answers, regions
from evidentia.plans import verdicts


def timed(rows, most):
    """The rows and that they took no longer than ``most`` seconds; what they replace took minutes."""
    began = time.monotonic()
    out = rows.collect()
    assert time.monotonic() - began < most
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edits_of_a_text_that_has_the_asked_one_very_often(spark):
    n = 60_000
    df = spark.createDataFrame([("ab " * n, "ab", None), ("ab " * n, "ab", n), ("가 " * n + "가나", "가", None)], "t string, s string, nth int")
    made = payloads.edits(F.col("t"), F.col("s"), F.lit("새"), F.col("nth"), F.lit(None).cast("string"))
    got = [[tuple(e) for e in r.e] for r in timed(df.select(made.alias("e")), 60)]
    assert got[0] == [(3 * k, 3 * k + 2, "새") for k in range(n)]
    assert got[1] == [(3 * n - 3, 3 * n - 1, "새")]
    assert got[2] == [(2 * k, 2 * k + 1, "새") for k in range(n)]


def test_area_of_many_boxes(spark):
    rng = random.Random(4)
    boxes = [(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for x, y in ((rng.randrange(4000), rng.randrange(50)) for _ in range(1500))]
    df = spark.createDataFrame([([tuple(map(float, b)) for b in boxes],), ([],), (None,)], "b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = [r.a for r in timed(df.select(regions.union_area(F.col("b")).alias("a")), 40)]
    assert got == [len({(i, j) for x1, y1, x2, y2 in boxes for i in range(x1, x2) for j in range(y1, y2)}), 0.0, None]


def test_sentences_of_several_scripts_and_wide_gaps(spark):
    cases = ["a。b！c？d. e!? f\ng", "...x\n.y .", "가。。나\u2028다！", "a" + " " * 300_000 + "b.\t\n c ", "", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string")
    got = {r.k: r.s for r in timed(df.select("k", text.sentences(F.col("t")).alias("s")), 30)}
    assert got == {k: c if c is None else [x for x in (m.strip(" \t\n\x0b\f\r") for m in re.findall(r"[^.!?。！？\n]+[.!?。！？]*", c)) if x] for k, c in enumerate(cases)}


def test_fences(spark):
    cases = {"```json\n{}\n``` x": "{}", "a ``` b ``` c": "b", "```` x```": "` x", "``````": "", "```json json": "json", "```\n[1]": "[1]", " x ": "x", "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.b for r in df.select("c", text.without_fence(F.col("c")).alias("b")).collect()} == cases


def test_kept_evidence_joins_nothing_and_cuts_a_large_key(spark):
    rows = spark.range(20_000).selectExpr("if(id < 19000, 1, id) k", "cast(id as string) s", "id % 2 = 0 strong", "cast(id % 5 as int) p", "cast(null as string) u", "if(id % 3 = 0, 'contradicts_claim', 'supports_claim') relation", "(id % 100) / 100 c".replace(" c", " confidence"))
    kept = answers.kept_evidence(rows, "k", "s", "strong", "p", "u", 0.5, 3)
    assert "Join" not in plan(kept)
    got = {r.k: r for r in kept.collect()}
    order = lambda i: (i % 2, i % 5 or 99, -(i % 100), str(i))
    best = sorted((i for i in range(19_000) if i % 100 >= 50), key=order)[:3]
    assert [(e.place, e.source) for e in got[1].evidence] == [(k, str(i)) for k, i in enumerate(best, 1)] and got[1].mixed
    assert len(got) == 1001 and got[19_001].status == "insufficient_evidence" and got[19_099].status == "verified"


def test_severity_joins_no_groups(spark):
    shown = plan(verdicts.severity_scores(spark, "/root/testdata/sf0.001"))
    assert "Join" not in shown and shown.count("FileScan") == 1


def test_raster_goes_by_arrow(spark):
    df = spark.createDataFrame([("aXeX",), ("",), (None,), ("가e",)], "t string")
    own = df.select(external.raster(F.col("t"), 2).alias("c"))
    assert [r.c for r in own.collect()] == [[500, 500], [0, 0], [0, 0], [0, 1000]]
    assert external.raster(F.col("t"), 2)._jc.toString().startswith("laid(")
