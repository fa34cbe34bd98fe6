"""Operators over results on small tables with nulls, ties, gaps and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import graph, results, votes


def test_edits_go_from_right_to_left(spark):
    def edited(text, *edits):
        df = spark.createDataFrame([(text, list(edits))], "t string, e array<struct<start:int,end:int,said:string>>")
        return df.select(results.applied_edits(F.col("t"), F.col("e"))).first()[0]

    assert edited("abcdef", (0, 1, "X"), (2, 4, "")) == "Xbef"
    assert edited("abcdef", (1, 4, "x"), (3, 5, "y")) == "abcyf"
    assert edited("abc", (1, 9, "x"), (2, 1, "y"), (3, 3, "!")) == "abc!" and edited("", (0, 0, "n")) == "n" and edited("abc") == "abc"


def test_times_map_back(spark):
    pieces = spark.createDataFrame([(1, 10.0, 14.0), (1, 20.0, 25.0), (2, 3.0, 3.0)], "k long, lo double, hi double")
    times = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 4.0), (1, 8.5), (1, 99.0), (2, 1.0), (3, 1.0)], "k long, t double")
    got = {(r.k, r.t): r.original for r in results.stitched_back(times, pieces, "k", "t").collect()}
    assert got == {(1, 0.0): 10.0, (1, 3.0): 13.0, (1, 4.0): 20.0, (1, 8.5): 24.5, (1, 99.0): 25.0, (2, 1.0): 3.0, (3, 1.0): None}


def test_decision_lists_and_labels(spark):
    df = spark.createDataFrame([(1, "A "), (5, "b"), (None, None)], "x int, c string")
    rows = df.select(results.first_match([("low", F.col("x") < 3), ("any", F.col("x").isNotNull())], "none"), results.labelled(F.col("c"), {"a": "First"})).collect()
    assert [tuple(r) for r in rows] == [("low", "First"), ("any", "b"), ("none", None)]


def test_last_value_that_says_something(spark):
    one, two = (spark.createDataFrame(rows, "k int, a string, b string") for rows in ([(1, "x", "y"), (2, None, "z")], [(1, "", "new"), (3, "only", None)]))
    assert {r.k: (r.a, r.b) for r in results.overriding([one, two], "k", ["a", "b"]).collect()} == {1: ("x", "new"), 2: (None, "z"), 3: ("only", None)}


def test_every_reviewer_counts(spark):
    models = spark.range(1500).selectExpr("cast(id as string) m")
    issues, verdicts = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(1, "3")], "i int, m string")
    assert votes.missing_verdicts(issues, models, verdicts, "i", "m").count() == 1499


def test_long_chains_are_one_component(spark):
    edges = spark.range(1, 3000).selectExpr("id a", "id - 1 b")
    out = graph.connected_components(edges)
    assert out.count() == 3000 and out.select("component").distinct().count() == 1
