"""A training-data pipeline: every stage works on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import classifier, decontamination, jaccard, mixing, secrets
from evidentia.llm.keys import free_name, maybe_broadcast
from evidentia.sources.session import checkpointed, shared_dir, table
from evidentia.sources.stages import Stages

#: Documents below this score of the quality classifier go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, doesn't reject.

    Null and empty texts are judged as texts without words, repeated rows alike, ids don't matter; an empty table
    gives no rows, all columns stay.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.kept(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 80 % alike: the first by id.

    Texts without words are groups of their own, null ids come last, of ties and repeated rows one stays.
    """
    return jaccard.one_of_each(docs, jaccard.Similarity(5, 80))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the words of ten-word benchmark windows; no row goes, null texts stay null, copies are cut alike."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; no row goes, null texts stay null, copies are masked alike."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and epochs that meet the target weights, with their texts; rows without an id are in no mix."""
    chosen = mixing.select(docs.filter("doc_id is not null")).dropDuplicates(["doc_id", "epoch"])
    chosen = checkpointed(chosen.select("doc_id", *[F.col(c).alias(free_name(docs.columns, c)) for c in ("domain", "epoch", "n_tokens")]))
    return docs.join(maybe_broadcast(chosen), "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_spans),
    ("mix", mix),
]

#: The first stage can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read back.

    In a ``folder`` that is named, stages that were finished from the same files are taken as they stand, so a run that
    was stopped goes on where it was. Without one the run has a folder of its own, in which a stage's rows go as soon as
    the next stage's stand.
    """
    docs, others = table(spark, sf_dir, "documents"), [table(spark, sf_dir, name) for name in ("labels", "benchmark")]
    stages = Stages(spark, folder or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}")
    before = None
    for name, stage in STAGES:
        docs = stages.run(name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), [docs, *others])
        if before and not folder:
            stages.drop(before)
        before = name
    return docs
