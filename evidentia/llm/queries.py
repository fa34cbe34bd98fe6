"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import audit, classifier, decontamination, jaccard, licenses, media, mixing, packing, pages, pii, repair, secrets, substrings
from evidentia.llm.keys import keyed
from evidentia.sources.session import table


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are 85 % alike."""
    return jaccard.similar(table(spark, sf_dir, "documents"), jaccard.Similarity(4, 85))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that meet the target weights."""
    return mixing.select(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of ten-word benchmark windows in every document."""
    found = decontamination.find_leaks(keyed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.KINDS[:4]))
    return pii.detect(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[_counted(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document and in what is encoded in it."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: (s["depth"] == 0) & s["kind"].isin(*secrets.KINDS[:3]))
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[_counted(base, kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        "complete",
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a classifier fitted on the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the fifty-word passages that an earlier document has."""
    return substrings.dedup(table(spark, sf_dir, "documents"), 50)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as samples of an ISO media file and read back by its sample tables."""
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, for each source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, each of them in the sources' proportions."""
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_licenses": op2_licenses,
    "op3_pages": op3_pages,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_media": op10_media,
    "op11_repair": op11_repair,
    "op12_audit": op12_audit,
    "op13_packing": op13_packing,
}
