"""Sequential rules, boxes and loose payloads: cases by hand and against plain rules over lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import payloads
from evidentia.operators import folds, regions, timeline


def contexts(rows, soft, hard, ahead):
    """The rule over a list, by places of boundaries."""
    out, nr, start, target = [], 0, 0, None
    for i, (cut, may) in enumerate(rows):
        out.append(nr)
        size, ends = i - start + 1, cut
        if not ends and target is not None:
            ends = i == target
        elif not ends and size >= soft:
            ends = may
            if not may and size >= hard:
                later = [k for k in range(i + 1, min(len(rows) - 2, i + ahead) + 1) if any(rows[k])]
                target, ends = (later[0], False) if later else (None, True)
        if ends:
            nr, start, target = nr + 1, i + 1, None
    return out


def test_limited_contexts(spark):
    rng = random.Random(5)
    rows = {key: [(rng.random() < 0.05, rng.random() < 0.15) for _ in range(rng.randrange(1, 60))] for key in range(30)}
    df = spark.createDataFrame([(k, i, *x) for k, own in rows.items() for i, x in enumerate(own)], "k int, i int, cut boolean, may boolean")
    got = {(r.k, r.i): r.context for r in folds.limited_contexts(df, ["k"], ["i"], "cut", "may", 4, 7, 3).collect()}
    assert got == {(k, i): c for k, own in rows.items() for i, c in enumerate(contexts(own, 4, 7, 3))}


def test_folded_keeps_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (3, None), (3, 5)], "k int, x int")
    got = folds.folded(df, ["k"], ["x"], ["x"], lambda own: enumerate(x for (x,) in own), "n long, x int").collect()
    assert sorted((str(r.k), r.n, str(r.x)) for r in got) == [("3", 0, "5"), ("3", 1, "None"), ("None", 0, "1"), ("None", 1, "2")]
    assert timeline.spaced(df.filter("x > 9"), ["k"], "x", 1).collect() == []


def test_one_key_over_many_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("x"))
        assert sorted(r.x for r in timeline.spaced(df, ["k"], "x", 9).collect()) == list(range(0, 100, 10))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_carried_batches(spark):
    rows = [(1, 0, "a", ["1", "2"], False), (1, 1, "b", ["2", "3"], False), (1, 2, "c", ["4", "5"], False), (1, 3, "d", ["9"], True), (1, 4, "e", [], False), (1, 5, "f", ["5"], False)]
    df = spark.createDataFrame(rows, "k int, o int, item string, images array<string>, alone boolean")
    got = [(r.batch, r["items"], r.images) for r in folds.carried_batches(df, ["k"], ["o"], "item", "images", "alone", 4, 5, 2).orderBy("batch").collect()]
    assert got == [(0, ["a", "b"], ["1", "2", "3"]), (1, ["c"], ["2", "3", "4", "5"]), (2, ["d"], ["9"]), (3, ["f"], ["5"])]


def test_tracked_boxes(spark):
    boxes = [(0, [0, 0, 10, 10]), (0, [50, 50, 60, 60]), (1, [1, 0, 11, 10]), (2, [3, 0, 13, 10]), (2, [50, 50, 60, 60]), (9, [3, 0, 13, 10])]
    df = spark.createDataFrame([(1, f, [float(x) for x in b], False) for f, b in boxes], "k int, frame int, box array<double>, moved boolean")
    got = [(r.frame, r.track, r.kept) for r in folds.tracked_boxes(df, ["k"], "frame", "box", "moved", 0.3, 3.0, 0.5, 3).orderBy("frame", "box").collect()]
    assert got == [(0, 0, False), (0, 1, False), (1, 0, False), (2, 0, True), (2, 1, False), (9, 2, False)]


def frames(spark, values):
    return spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(values)], "k int, i int, frame array<double>")


def test_captures(spark):
    blank, some, more, other = [0] * 10, [9] * 2 + [0] * 8, [9] * 4 + [0] * 6, [9] * 10
    rule = lambda own: [(r.at, r.told_at) for r in folds.captures(frames(spark, own), ["k"], "i", "frame", 1.0, 0.15, 0.05, 0.9, 2, 2, 0, 0.1).orderBy("told_at").collect()]
    assert rule([blank, some, more, more, more, more]) == [(2, 4)]
    assert rule([blank, some, more, blank, blank]) == [(2, 3)]
    assert rule([blank, some, other, other]) == []
    assert rule([blank, blank, some, more]) == [(3, 3)]


def test_scene_changes(spark):
    a, b = [0] * 4, [10] * 4
    rule = lambda own, fade=1e9: [(r.at, r.reason) for r in folds.scene_changes(frames(spark, own), ["k"], "i", "frame", 50.0, 40.0, fade, 2, 1).orderBy("at").collect()]
    assert rule([a, a, b, b, b]) == [(2, "cut")]
    assert rule([a, b, a, a]) == []
    assert rule([a, [5] * 4, [7] * 4, [7] * 4]) == [(2, "base")]
    assert rule([a, a, b, b, b, a, a]) == [(2, "cut"), (5, "cut")]


@pytest.mark.parametrize("seed", range(3))
def test_union_area(spark, seed):
    rng = random.Random(seed)
    boxes = [(x, y, x + rng.randrange(1, 6), y + rng.randrange(1, 6)) for x, y in ((rng.randrange(12), rng.randrange(12)) for _ in range(8 * seed))]
    df = spark.createDataFrame([([tuple(map(float, b)) for b in boxes],)], "b array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert df.select(regions.union_area(F.col("b"))).first()[0] == len({(i, j) for x1, y1, x2, y2 in boxes for i in range(x1, x2) for j in range(y1, y2)})


def test_particles(spark):
    cases = {("목적를", 2): "목적을", ("욕구을 본다", 2): "욕구를 본다", ("서울으로", 2): "서울로", ("부산로 간다", 2): "부산으로 간다", ("나무은", 2): "나무는", ("abc를", 3): "abc를", ("책이", 1): "책이", ("", 0): ""}
    df = spark.createDataFrame([(t, a, w) for (t, a), w in cases.items()], "t string, a int, want string")
    assert [(r.got, r.want) for r in df.select(payloads.with_particle(F.col("t"), F.col("a")).alias("got"), "want").collect() if r.got != r.want] == []


def test_edits(spark):
    cases = [("a.b a.b", "a.b", "x y", 2, None, [(4, 7)]), ("a.b aXb", "a.b", "xyz", None, None, [(0, 3)]), ("aaaa", "aa", "bbb", None, None, [(0, 2), (2, 4)]), ("가나다", "나", "라", 1, None, []), ("가 나 다", "나", "라", 1, None, [(2, 3)]), ("one, two", "one,", "one", 1, None, []), ("abc abc", "abc", "abd", 3, None, []), ("abc", "abc", "abd", 3, "has abd", [(0, 3)]), ("abc", "abc", "abd", 1, "lacks", []), (None, "abc", "abd", 1, None, [])]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, t string, s string, n string, nth int, c string")
    got = df.select("i", payloads.edits(*[F.col(x) for x in ("t", "s", "n", "nth", "c")]).alias("e")).orderBy("i").collect()
    assert [[(e.start, e.end) for e in r.e] for r in got] == [c[5] for c in cases]


def test_payloads(spark):
    df = spark.createDataFrame([("not json",), (None,), ('{"judgment": "nope", "is_valid_issue": 7, "context_resolution": "x"}',)], "p string")
    got = [r.j for r in df.select(payloads.judgment(F.col("p")).alias("j")).collect()]
    assert [(j.judgment, j.valid, j.unresolved) for j in got] == [("insufficient_context", 0.0, 1.0), ("insufficient_context", 0.0, 1.0), ("insufficient_context", 1.0, 1.0)]
    assert [r[0] for r in df.select(F.size(payloads.passages(F.col("p")))).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(F.size(payloads.corrections(F.col("p")))).collect()] == [0, 0, 0]
