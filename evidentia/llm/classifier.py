"""Document quality: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words

#: Rows of the word table; words share a row where their hashes meet, so its size is fixed.
BUCKETS = 1 << 14
DIM = 32
#: Labelled rows that the network is fitted on at most, taken by hash order; all others only wait to be scored.
FIT_ROWS = 20_000
#: Share of the fitted rows that set the temperature instead of the weights.
CALIBRATION = 0.2
HIDDEN = 32
#: Words of one piece of a text that is pooled at a time.
PIECE = 1 << 14
SEED = 11


def index_places(buckets: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The four places and signs of each bucket's sparse ternary index vector."""
    h = np.stack([words.mix(buckets.astype(np.uint64) * np.uint64(8) + np.uint64(k + 1000 * salt)) for k in range(4)])
    return (h >> np.uint64(8)).astype(np.int64) % DIM, np.where(h & np.uint64(1), 1.0, -1.0)


def index_vectors(buckets: np.ndarray, salt: int = 0) -> np.ndarray:
    """The sparse ternary index vectors themselves."""
    out = np.zeros((len(buckets), DIM), np.float32)
    for places, signs in zip(*index_places(buckets, salt), strict=True):
        out[np.arange(len(buckets)), places] += signs
    return out


def _tokens(part: words.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and shape of every word: the shape tells case, digits, marks, length and a repeat of the last word."""
    buckets = (part.hashes % np.uint64(BUCKETS)).astype(np.int64)
    if not len(buckets):
        return buckets, buckets
    kinds = _KIND[part.data]
    first, last, second = kinds[part.starts], kinds[part.ends - 1], kinds[np.minimum(part.starts + 1, part.ends - 1)]
    before = kinds[np.maximum(part.ends - 2, part.starts)]
    length = np.minimum((part.ends - part.starts) // 4, 3)
    same = np.zeros(len(buckets), np.int64)
    same[1:] = part.hashes[1:] == part.hashes[:-1]
    return buckets, ((((first * 5 + second) * 5 + before) * 5 + last) * 4 + length) * 2 + same


_KIND = np.zeros(256, np.int64)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()?-"]] = 4
_N_SHAPES = 5**4 * 8


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of every word's context vector: what its neighbours' index vectors add up to."""
    places, signs = index_places(np.arange(BUCKETS))
    sums, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
    for batch in batches:
        for part in words.slices(batch.column(0), words.BLANK_SPLIT):
            buckets, _ = _tokens(part)
            doc = part.doc_of_words()
            counts += np.bincount(buckets, minlength=BUCKETS)
            near = doc[:-1] == doc[1:]
            left, right = buckets[:-1][near], buckets[1:][near]
            for place, sign in zip(places, signs, strict=True):
                for word, neighbour in ((left, right), (right, left)):
                    sums += np.bincount(word * DIM + place[neighbour], sign[neighbour], len(sums))
    sums = sums.reshape(BUCKETS, DIM)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(list(sums[used]), pa.list_(pa.float64())), pa.array(counts[used])],
        ["bucket", "sums", "n"],
    )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The ``BUCKETS`` by ``DIM`` table of unit word vectors that the contexts in all of ``texts`` give.

    Each task adds up its own part, the parts are summed by bucket, and the finished table, whose size is fixed,
    goes to the driver.
    """
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_context_sums, "bucket long, sums array<double>, n double")
    total = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(DIM)], F.sum("n").alias("n"))
    table = np.zeros((BUCKETS, DIM), np.float32)
    got = total.limit(BUCKETS).toArrow()
    own = np.stack([got[f"s{k}"].to_numpy() for k in range(DIM)], 1)
    norm = np.sqrt((own**2).sum(1, keepdims=True))
    table[got["bucket"].to_numpy()] = own / np.where(norm > 0, norm, 1)
    return table


@dataclass
class Model:
    """Fixed-size parts of a fitted classifier."""

    table: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        (w1, b1), (w2, b2) = self.layers
        return (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def pooled(column: pa.Array, table: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Each document's mean word vector, mean shape vector, and three lengths; all zero without words."""
    out = np.zeros((len(column), 2 * DIM + 3), np.float64)
    for part in words.slices(column, words.BLANK_SPLIT):
        buckets, kinds = _tokens(part)
        n = np.diff(part.first)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        for i in full:
            a, b = part.first[i], part.first[i + 1]
            for lo in range(a, b, PIECE):
                own = slice(lo, min(b, lo + PIECE))
                out[part.lo + i, :DIM] += table[buckets[own]].sum(0)
                out[part.lo + i, DIM : 2 * DIM] += shapes[kinds[own]].sum(0)
        rows = part.lo + full
        out[rows, : 2 * DIM] /= n[full][:, None]
        uniques = np.array([len(np.unique(part.hashes[part.first[i] : part.first[i + 1]])) for i in full])
        size = np.add.reduceat((part.ends - part.starts).astype(np.float64), part.first[full])
        out[rows, 2 * DIM :] = np.stack([np.log1p(n[full]), uniques / n[full] ** 0.9, size / n[full]], 1)
    return out


def train(x: np.ndarray, y: np.ndarray, table: np.ndarray, shapes: np.ndarray, epochs: int = 60) -> Model:
    """Fit the two layers by Adam on all rows but the last ``CALIBRATION``, which set the temperature.

    With one class only, or no rows, the score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(SEED)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIM + 3), np.ones(2 * DIM + 3))
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, 1)), np.zeros(1)]
    share = (y.sum() + 1) / (len(y) + 2)
    w[3][0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        w[2][:] = 0
        return Model(table, shapes, mean, scale, [(w[0], w[1]), (w[2], w[3])], 1.0)
    own = (x - mean) / scale
    cut = max(1, int(len(y) * (1 - CALIBRATION)))
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        by = rng.permutation(cut)
        for lo in range(0, cut, 256):
            rows = by[lo : lo + 256]
            a = own[rows] @ w[0] + w[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip((h @ w[2] + w[3])[:, 0], -40, 40)))
            d = ((p - y[rows]) / len(rows))[:, None]
            dh = (d @ w[2].T) * (a > 0)
            grads = [own[rows].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(0)]
            t += 1
            rate = 0.003 * (1 - epoch / epochs) + 1e-4
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(table, shapes, mean, scale, [(w[0], w[1]), (w[2], w[3])], 1.0)
    held, truth = model.logits(x[cut:]), y[cut:]
    if len(truth):
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth > 0, -held, held) / g).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Word vectors from all of ``docs``, weights from a bounded sample of its labelled rows.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``. Rows whose crc32 of the id is
    divisible by 5 are held out and never fitted on. At most ``FIT_ROWS`` labelled rows, first by hash of the id,
    are pooled by the tasks and sent to the driver as vectors of fixed length. Null ids, null labels and labels
    other than 0 and 1 aren't fitted on; a document with both labels counts with the larger, of several texts of one id the one of the smallest vector.
    """
    table = word_vectors(docs)
    shapes = index_vectors(np.arange(_N_SHAPES), salt=1)
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    sample = sample.filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), table, shapes).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    # One vector of each id, so there are FIT_ROWS at most.
    got = rows.select("doc_id", "text", "quality").mapInArrow(vectors, "doc_id long, quality int, x array<float>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM + 3).astype(np.float64) if len(got) else np.zeros((0, 2 * DIM + 3))
    ids, y = got["doc_id"].to_numpy(), got["quality"].to_numpy()
    by = np.lexsort([*x.T[:3], ids, words.mix(ids.astype(np.uint64))])
    return train(x[by], y[by].astype(np.float64), table, shapes)


def held_out(column: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by 5; null ids are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: the calibrated probability of label 1.

    Only the text is looked at; null and empty texts get the score of a text without words; repeated rows score
    alike; an empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(pooled(batch.column(1), model.table, model.shapes)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""

    def passed(texts):
        import pandas as pd

        return pd.Series(model.scores(pooled(pa.array(texts, pa.string()), model.table, model.shapes)) >= least)

    return docs.filter(F.pandas_udf(passed, "boolean")(F.col("text").cast("string")))
