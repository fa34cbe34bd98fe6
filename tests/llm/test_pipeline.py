"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import corpus_pipeline
from evidentia.llm import decontamination, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, FOLDER)
    assert good.schema == docs.schema
    wrong = [r.doc_id for r in docs.join(good, "doc_id", "left_anti").collect() if labels.get(r.doc_id) == 1]
    assert not wrong
    single = corpus_pipeline.near_duplicates(spark, good, FOLDER)
    rows = single.collect()
    sets = []
    for r in rows:
        w = r.text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    assert not [1 for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    clean = corpus_pipeline.benchmark(spark, single, FOLDER)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontamination.find_leaks(clean.selectExpr("doc_id row_key", "doc_id", "text"), items).filter("size(spans) > 0").count() == 0
    masked = corpus_pipeline.secret_spans(spark, clean, FOLDER)
    assert masked.schema == docs.schema and masked.count() == len(rows)
    assert not [r.doc_id for r in masked.collect() if secrets.find(r.text)[0]]
    mixed = corpus_pipeline.mix(spark, masked, FOLDER)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() > 0


def test_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "mix"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
