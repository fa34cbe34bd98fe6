"""Decisions on empty tables, nulls and ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import decisions


def test_source_status_nulls(spark):
    df = spark.createDataFrame([(1, None, True, 1, 3), (2, True, None, 1, None), (2, True, True, 4, 2)], "k int, m boolean, e boolean, p int, n int")
    got = {r.k: (r.status, r.direct_evidence, r.best_priority) for r in decisions.source_status(df, "k", "m", "e", "p", "n").collect()}
    assert got == {1: ("no_direct_passage", 0, None), 2: ("verified", 2, 4)}
    assert decisions.source_status(df.limit(0), "k", "m", "e", "p", "n").collect() == []


def test_clean_finals(spark):
    df = spark.createDataFrame([(1, "build", "a"), (1, "base", "c"), (1, "base", "b"), (2, None, "z"), (None, "base", "n")], "s int, kind string, name string")
    got = {r.name: (r.s, r.clean_final, r.is_clean_final) for r in decisions.clean_finals(df, "s", "kind", "name", []).collect()}
    assert got == {"a": (1, "b", False), "b": (1, "b", True), "c": (1, "b", False), "z": (2, "z", True), "n": (0, "n", True)}


def test_slides_of_files(spark):
    names = ["slide_2_base.png", "slide_2_build_10.png", "slide_2_BUILD_9.jpg", "slide_2_annot_1.png", "slide_3_build_1.png", "notes.txt", None]
    got = decisions.slides_of_files(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert [(r.slide, r.base, r.builds, r.annotated) for r in got] == [(2, "slide_2_base.png", ["slide_2_BUILD_9.jpg", "slide_2_build_10.png"], True)]


def test_needs_repair(spark):
    rows = [(1, True, True, "no_sources", False), (5, False, False, "verified", False), (None, False, True, "verified", True), (None, None, None, "no_sources", True)]
    df = spark.createDataFrame(rows, "b int, d boolean, w boolean, s string, want boolean")
    assert all(r.got == r.want for r in df.select(decisions.needs_repair(F.col("b"), F.col("d"), F.col("w"), F.col("s")).alias("got"), "want").collect())
