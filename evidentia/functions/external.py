"""The boundary to external compute: rasters, model calls. Models are deterministic stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as ink where a text is laid out as a strip.
INK = "aeiouAEIOU"


def raster(text: Column, cells: int) -> Column:
    """A text as a strip of ``cells`` cells of equal length; a cell's ink is its share of vowels in thousandths.

    Each character is looked at once; a null text is empty, cells without characters have no ink. Texts are taken from
    their Arrow batch one by one and strips go back as one flat array, so a task holds a batch once, not also as objects.
    """
    ink = np.array([ord(c) for c in INK], np.uint32)

    def laid(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), cells), np.int64)
        for k, said in enumerate(texts):
            codes = np.frombuffer((said.as_py() or "").encode("utf-32-le"), np.uint32)
            upto = np.append(0, np.cumsum(np.isin(codes, ink)))
            edges = np.arange(cells + 1, dtype=np.int64) * len(codes) // cells
            out[k] = 1000 * np.diff(upto[edges]) // np.maximum(np.diff(edges), 1)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * cells, out.reshape(-1))

    return F.arrow_udf(laid, "array<long>")(text)


def stand_in(model: str, text: str) -> float:
    """A model's confidence about a text, told from their hash; a text of hash 0 modulo 23 makes the model fail."""
    n = int.from_bytes(hashlib.sha256(f"{model}\n{text}".encode()).digest()[:6], "big")
    if n % 23 == 0:
        raise RuntimeError("the model gave no answer")
    return round(n % 10_007 / 10_006, 6)


def reviewed(rows: DataFrame, key: str, text: str, models: list[str], call: Callable[[str, str], float] = stand_in, tries: int = 2, pause: float = 0.0) -> DataFrame:
    """``key, model, status, confidence, reason`` of each row and model; a failed call is a row, never an error."""
    kind = rows.schema[key].dataType.simpleString()
    each = rows.select(key, F.coalesce(text, F.lit("")).alias("text"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, said, model in pdf.itertuples(index=False):
                for attempt in range(tries):
                    try:
                        out.append((own, model, "ok", call(model, said), None))
                        break
                    except Exception as failed:
                        if attempt == tries - 1:
                            out.append((own, model, "failed", None, str(failed)[:320]))
                        elif pause:
                            time.sleep(pause)
            yield pd.DataFrame(out, columns=[key, "model", "status", "confidence", "reason"])

    return each.mapInPandas(run, f"{key} {kind}, model string, status string, confidence double, reason string")


def stitched(results: DataFrame, models: list[str], key: str) -> DataFrame:
    """One row a key: how many models answered, their mean confidence, and whether all did."""
    return results.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("answered"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), (F.count_if(F.col("status") == "ok") == len(models)).alias("complete"))
