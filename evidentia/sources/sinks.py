"""Sinks: JSON lines, one folder a model, text reports, stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in as many files as there are partitions."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def by_model(rows: DataFrame, path: str, model: str = "model") -> None:
    """One folder of JSON lines for each model."""
    rows.write.mode("overwrite").partitionBy(model).json(path)


def report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A text report: one line a row, fields parted by bars."""
    rows.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def stage_output(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """A stage's rows, made only if its output isn't there yet; a half-written one counts as absent."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
