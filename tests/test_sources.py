"""Readers and writers on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentia.sources import frames, readers, sinks


def test_json(spark, tmp_path):
    (tmp_path / "claims.jsonl").write_text('{"claim_id": "CL1", "claim_text": "a"}\n\nbroken\n[1]\n{"claim_text": "no id"}\n')
    assert [r.claim_id for r in readers.json_lines(spark, str(tmp_path / "claims.jsonl")).collect()] == ["CL1"]
    merged = {"domain": "it", "slides": [{"slide_number": 2, "title": "t", "contexts": [{"text": "x"}, {"context_id": "K", "text": "y"}]}]}
    (tmp_path / "merged.json").write_text(json.dumps(merged, indent=1))
    got = readers.contexts(readers.json_document(spark, str(tmp_path / "merged.json"), readers.MERGED)).orderBy("context_index").collect()
    assert [(r.context_id, r.text) for r in got] == [("S002-C001", "x"), ("K", "y")]


def test_silences(spark, tmp_path):
    (tmp_path / "log.txt").write_text("[silencedetect] silence_start: 1.5\nnoise\nsilence_end: 3.0 | silence_duration: 1.5\nsilence_start: 9\nsilence_end: 8 | silence_duration: -1\n")
    assert [(r.start, r.end, r.duration) for r in readers.silences(spark, str(tmp_path / "log.txt")).collect()] == [(1.5, 3.0, 1.5)]


def test_catalogue(spark, tmp_path):
    pages = [[{"id": "m", "provider": "a", "mode": "chat"}, {"model": " n ", "litellm_provider": "z"}, {"id": "x"}], [{"id": "m", "provider": "a", "mode": "embedding", "supports_vision": True}, {"id": "", "provider": "a"}, None], []]
    for k, rows in enumerate(pages):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"data": rows, "has_more": True}, indent=1))
    models = readers.catalogue(spark, str(tmp_path))
    assert {(r.provider, r.id, r.mode, r.supports_vision) for r in models.collect()} == {("a", "m", "embedding", True), ("z", "n", None, None)}
    assert {tuple(r) for r in readers.providers(models).collect()} == {("a", 1), ("z", 1)}


def frame_rows(spark, n):
    return spark.range(n).select(F.col("id").alias("position"), F.when(F.col("id") != 3, F.col("id") / 10).alias("at"), F.when(F.col("id") != 4, F.encode(F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")), "utf-8")).alias("frame"), F.lit(1).alias("other"))


def test_frame_cache_reads_the_chunks_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    frames.write_cache(frame_rows(spark, 100), path, 8)
    every = frames.read_cache(spark, path)
    assert [(r.position, r.at, bytes(r.frame)) for r in every.orderBy("position").collect()] == [(k, None if k == 3 else k / 10, b"" if k == 4 else b"x" * (k % 5)) for k in range(100)]
    some, single = frames.read_cache(spark, path, 30, 40), frames.read_cache(spark, path, positions=[5, 99, 500])
    assert sorted(r.position for r in some.collect()) == list(range(30, 40)) and some.rdd.getNumPartitions() == 2
    assert sorted(r.position for r in single.collect()) == [5, 99] and single.rdd.getNumPartitions() == 2
    assert every.count() == 100 and every.filter("position < 7").count() == 7 and every.filter("at > 9.85").count() == 1
    assert frames.read_cache(spark, path, 500).count() == frames.read_cache(spark, path, positions=[]).count() == 0
    assert frames.read_cache(spark, path, least=97).count() == 3 and frames.read_cache(spark, path, below=2).count() == 2
    with pytest.raises(Exception, match="holds a cache"):
        frames.write_cache(frame_rows(spark, 3), path, 1)


def test_frame_cache_has_no_manifest_unless_all_was_written(spark, tmp_path):
    bad = frame_rows(spark, 50).withColumn("at", F.when(F.col("position") == 40, F.raise_error(F.lit("stop"))).otherwise(1.0))
    with pytest.raises(Exception, match="stop"):
        frames.write_cache(bad, f"file://{tmp_path}/broken", 4)
    assert not (tmp_path / "broken" / frames.MANIFEST).exists()
    frames.write_cache(frame_rows(spark, 0), f"file://{tmp_path}/empty", 4)
    assert frames.read_cache(spark, f"file://{tmp_path}/empty").count() == 0


def test_first_file(spark):
    files = spark.createDataFrame([(1, "a/1.jpg"), (1, "a/1.png"), (2, "a/2.gif")], "slide int, path string")
    assert [r.path for r in readers.first_file(files, "slide", "path", [".png", ".jpg"]).collect()] == ["a/1.png"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "model string, n int")
    sinks.by_model(rows, str(tmp_path / "models"))
    assert sorted(p.name for p in (tmp_path / "models").glob("model=*")) == ["model=a", "model=b"]
    sinks.report(rows, str(tmp_path / "report"), ["model", "n"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ["a | 1", "b | -"]
    sinks.json_lines(rows, str(tmp_path / "lines"))
    made = []
    for _ in range(2):
        assert sinks.stage_output(spark, str(tmp_path / "stage"), lambda: made.append(1) or rows).count() == 2
    assert len(made) == 1
