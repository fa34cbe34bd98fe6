"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, operator by operator."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import classifier, decontamination, jaccard, licenses, media, mixing, pages, pii, secrets, substrings
from evidentia.llm.keys import keyed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, spans string, domain string, epoch int, component int"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
TEXTS = [None, "", " \t\n", "one", "a b c d e f g h i j k l", LONG, "password = hunter2secret", "Licensed under the MIT License. a@b.cd 1.2.3.4"]


def documents(spark, texts=TEXTS, copies=2):
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 2 else f"src{k}", None, 7, "x", "d", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows * copies, (None, "no id", None, None, None, None, None, None, None, None)], DOCS)


def bench(spark, rows=((1, "c d e f g h i j k l m"), (None, "one"), (3, None), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "jaccard": lambda s, d: jaccard.similar(d, jaccard.Similarity(4, 85)),
    "licenses": lambda s, d: licenses.labelled(d),
    "decontamination": lambda s, d: decontamination.find_leaks(keyed(d), bench(s)),
    "pii": lambda s, d: pii.detect(d),
    "secrets": lambda s, d: secrets.scan(d),
    "substrings": lambda s, d: substrings.dedup(d),
    "media": lambda s, d: media.stored_texts(d),
    "score": lambda s, d: classifier.score(d, classifier.fit(d, s.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(spark, name):
    docs = documents(spark)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    by: dict = {}
    for r in rows:
        own = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("row_key", "place")}
        assert by.setdefault(r.doc_id, own) == own
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


REWRITES = {
    "one_of_each": lambda s, d: jaccard.one_of_each(d, jaccard.Similarity()),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, bench(s), 10),
    "redact": lambda s, d: secrets.redact(d),
    "kept": lambda s, d: classifier.kept(d, classifier.fit(d, s.createDataFrame([], "doc_id long, quality int")), 0.0),
}


@pytest.mark.parametrize("name", sorted(REWRITES))
def test_documents_keep_their_columns(spark, name):
    docs = documents(spark)
    out = REWRITES[name](spark, docs)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert 0 < out.count() <= docs.count()
    assert REWRITES[name](spark, docs.limit(0)).count() == 0


def test_one_of_each_keeps_the_first(spark):
    base = " ".join(f"t{k}" for k in range(200))
    near = base.replace("t50 ", "zz ")
    docs = spark.createDataFrame([(5, near), (2, base), (9, base), (7, "other words are here now"), (8, ""), (1, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs, jaccard.Similarity()).collect()) == [1, 2, 7, 8]


def test_mixing_nulls_and_repeats(spark):
    docs = documents(spark)
    out = mixing.select(docs, mixing.Mix(share=100, epochs=2))
    assert set(out.columns) == {"doc_id", "domain", "lang", "source", "epoch", "n_tokens"}
    assert all(r.epoch < 2 for r in out.collect())
    assert mixing.select(docs.limit(0)).count() == 0
    everything = mixing.select(docs, mixing.Mix(share=100, epochs=1))
    assert everything.agg(F.sum("n_tokens")).first()[0] == mixing.leaves(docs, mixing.Mix()).agg(F.sum("n_tokens")).first()[0]


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [(k, " ".join(["w"] * 10), lang, source) for k, (lang, source) in enumerate([("en", "src0")] * 2 + [("en", "src1")] * 40 + [("en", "src5")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(domain_weights={"web": 50, "news": 50}, share=50, epochs=1)
    sizes = mixing.leaves(docs, mix).groupBy(*mixing.LEAF).agg(F.sum("n_tokens").alias("tokens"))
    got = {r.source: r.budget for r in mixing.budgets(sizes, mix, 410).collect()}
    assert got == {"src0": 20, "src1": 185, "src5": 205}


def test_pages_edges(spark):
    html = "<body><nav>menu</nav><article><h1>T &amp; t</h1><p>one<p>two  &lt;x&gt;<div class='comments'>c</div></article><footer>f"
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "http://a.b/c", html), (3, "http://a.b/c", html), (4, "x", "<p>plain<script>var a='<p>';</script> text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("T & t\none\ntwo <x>", 17), 4: ("plain text", 10)}
    assert pages.extract(df.limit(0)).count() == 0


def test_site_template_inside_articles_goes(spark):
    rows = [(k, f"http://s.org/{k}", f"<article><h1>Title {k}</h1><p>Own words {k} of page {k * 7}</p><div class='tail'>Read more on our site</div></article>") for k in range(40)]
    rows += [(100 + k, f"http://same.org/{k}", "<article><p>The very same text</p></article>") for k in range(20)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nOwn words 3 of page 21" and got[105] == "The very same text"


def test_media_rejects_foreign_bytes(spark):
    good = media.store(media.padded(b"x" * 40_000))
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"not a box at all")), (5, bytearray(good[:-9]))]
    got = {r.media_id: r for r in media.media_metadata(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert (got[1].codec, got[1].n_samples, got[1].error) == ("raw ", 70, None)
    assert all(got[k].error and got[k].codec is None for k in (2, 3, 4, 5))
    assert b"".join(good[r.lo : r.hi] for r in got[1].payload_ranges) == media.padded(b"x" * 40_000)


def test_digests_of_media(spark):
    row = media.stored_texts(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    payload = "é".encode() + b"\xff" * 574
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (2, 576, hashlib.sha256(payload).hexdigest())
