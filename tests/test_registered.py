"""Functions registered for SQL."""

from __future__ import annotations

import pytest

from evidentia.functions import registered


@pytest.fixture(scope="module")
def names(spark):
    return registered.register(spark)


def test_islands(spark, names):
    rows = [("a", 1.0), ("a", None), ("a", 9.0), ("a", 3.0), (None, 5.0), (None, 50.0), ("b", -1.0)]
    spark.createDataFrame(rows, "k string, t double").createOrReplaceTempView("island_rows")
    got = {(r.k, r.t, r.island) for r in spark.sql("SELECT * FROM islands(TABLE(island_rows), 'k', 't', 5D)").collect()}
    assert got == {("a", 1.0, 0), ("a", 3.0, 0), ("a", 9.0, 1), (None, 5.0, 0), (None, 50.0, 1), ("b", -1.0, 0)}
    assert spark.sql("SELECT * FROM islands(TABLE(SELECT * FROM island_rows WHERE false), 'k', 't', 5D)").count() == 0
    with pytest.raises(Exception, match="must name a column"):
        spark.sql("SELECT * FROM islands(TABLE(island_rows), 'nope', 't', 5D)").collect()


@pytest.mark.parametrize(("size", "overlap"), [(4, 0), (4, 1), (10, 3), (100, 7)])
def test_chunks_cover_whole_texts(spark, names, size, overlap):
    texts = [None, "", "x", "abcd", "abcde", "é" * 37, "hello world " * 9]
    spark.createDataFrame(list(enumerate(texts)), "id int, body string").createOrReplaceTempView("chunk_rows")
    got: dict = {}
    for r in spark.sql(f"SELECT * FROM chunks(TABLE(chunk_rows), 'id', 'body', {size}, {overlap})").collect():
        got.setdefault(r.id, {})[r.chunk] = (r.start, r.text)
    for key, text in enumerate(texts):
        own = [got.get(key, {})[k] for k in range(len(got.get(key, {})))]
        back = "".join(t if k == 0 else t[overlap:] for k, (_, t) in enumerate(own))
        assert back == (text or "") and all(t == text[s : s + size] and len(t) <= size for s, t in own)
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM chunks(TABLE(chunk_rows), 'id', 'body', 3, 3)").collect()


def test_scalars(spark, names):
    row = spark.sql("SELECT clamp01(7D) a, clamp01(NULL) b, verdict(0.8D) c, verdict(0.2D) d, verdict(0.5D) e, hamming_distance(5, 6) f, matching_ratio('abcd', 'bcde') g").first()
    assert tuple(row) == (1.0, 0.0, "confirmed", "rejected", "professor_check", 2, 0.75)
