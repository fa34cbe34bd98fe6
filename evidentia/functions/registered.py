"""Functions for SQL: table functions that declare how their input is parted and ordered, and scalar ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from evidentia.functions import blocks


def _named(argument: AnalyzeArgument, table: AnalyzeArgument, what: str) -> str:
    """The column that a constant argument names; columns are told while the query is analysed."""
    if argument.value is None or argument.value not in table.dataType.names:
        raise ValueError(f"{what} must name a column of the table")
    return argument.value


@udtf
class Islands:
    """``islands(TABLE(t), key, at, gap)``: rows of each key in order, with the number of their run.

    A run ends where the next row is more than ``gap`` later. Spark parts the table by ``key`` and sorts it by ``at``; rows
    are read one after another and only the last one's place is kept. Rows without a place are in no run and left out.
    """

    def __init__(self) -> None:
        self.last: float | None = None
        self.island = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        part, order = _named(key, rows, "key"), _named(at, rows, "at")
        schema = StructType().add(part, rows.dataType[part].dataType).add(order, DoubleType()).add("island", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(part)], orderBy=[OrderingColumn(order, ascending=True, overrideNullsFirst=True)])

    def eval(self, rows: Row, key: str, at: str, gap: float) -> Iterator[tuple]:
        place = rows[at]
        if place is None:
            return
        self.island += self.last is not None and place - self.last > gap
        self.last = place
        yield rows[key], float(place), self.island


@udtf
class Chunks:
    """``chunks(TABLE(t), id, body, size, overlap)``: whole texts in pieces of ``size`` characters, each ``overlap`` into the one before.

    ``chunk`` counts from 0, ``start`` is a piece's first character. A text of up to ``size`` characters is one piece; null
    and empty texts have none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, id: AnalyzeArgument, body: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        name = _named(id, rows, "id")
        _named(body, rows, "body")
        if not 0 <= (overlap.value or 0) < (size.value or 0):
            raise ValueError("size must be more than overlap, and overlap no less than 0")
        schema = StructType().add(name, rows.dataType[name].dataType).add("chunk", LongType()).add("start", LongType()).add("text", StringType())
        return AnalyzeResult(schema)

    def eval(self, rows: Row, id: str, body: str, size: int, overlap: int) -> Iterator[tuple]:
        text = rows[body] or ""
        for nr, start in enumerate(range(0, max(len(text) - overlap, min(1, len(text))), size - overlap)):
            yield rows[id], nr, start, text[start : start + size]


@pandas_udf(DoubleType())
def matching_ratio(one: pd.Series, two: pd.Series) -> pd.Series:
    """``matching_ratio(a, b)``: the matching-blocks ratio of two texts."""
    return pd.Series(blocks.ratios(one.tolist(), two.tolist()))


#: Scalar functions in SQL itself, which Catalyst inlines.
EXPRESSIONS = {
    "clamp01": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, coalesce(x, 0D)))"),
    "verdict": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.8D THEN 'confirmed' WHEN score <= 0.2D THEN 'rejected' ELSE 'professor_check' END"),
    "hamming_distance": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL, and returns their names."""
    spark.udtf.register("islands", Islands)
    spark.udtf.register("chunks", Chunks)
    spark.udf.register("matching_ratio", matching_ratio)
    for name, (takes, gives, said) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {said}")
    return ["islands", "chunks", "matching_ratio", *EXPRESSIONS]
