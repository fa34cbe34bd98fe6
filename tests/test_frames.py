"""Kernels over batches of frames against one frame at a time."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evidentia.functions import frames

WIDTH = 6


def batch(rng, n):
    for _ in range(n):
        size = rng.choice([0, 3, 6, 12, 13, 24, 36])
        yield None if rng.random() < 0.1 else [rng.choice([0.0, 1.0, 2.5, rng.random()]) for _ in range(size)]


def grown(mask, reach):
    h, w = mask.shape
    return np.array([[mask[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1].any() for j in range(w)] for i in range(h)])


def test_kernels_frame_by_frame(spark):
    rng = random.Random(3)
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(batch(rng, 150), batch(rng, 150), strict=True))]
    rows += [(200, [0.0] * 12, [0.0] * 12), (201, list(map(float, range(36))), list(map(float, range(36))))]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = df.select("id", frames.perceptual_hash(F.col("a"), WIDTH, 4).alias("hash"), frames.edge_overlap(F.col("a"), F.col("b"), WIDTH, 0.5).alias("edge"), frames.features(F.col("a"), WIDTH).alias("f"), frames.pair_metrics(F.col("a"), F.col("b")).alias("m")).collect()
    by = {k: (a, b) for k, a, b in rows}
    for r in got:
        a, b = by[r.id]
        image = None if a is None else np.array(a[: len(a) // WIDTH * WIDTH]).reshape(-1, WIDTH)
        if image is None or not image.size:
            assert r.hash is None and tuple(r.f) == (0.0, 0.0, 0, 0.0)
        else:
            h = image.shape[0]
            low = [[sum(image[x, y] * 4 * np.cos(np.pi * u * (2 * x + 1) / (2 * h)) * np.cos(np.pi * v * (2 * y + 1) / (2 * WIDTH)) for x in range(h) for y in range(WIDTH)) for v in range(4)] for u in range(min(4, h))]
            flat = np.array(low).ravel()
            bits = "".join("1" if x > np.median(flat) else "0" for x in flat)
            if np.abs(np.sort(flat) - np.median(flat)).min() > 1e-9:
                assert r.hash == [int(bits.ljust(64, "0"), 2) - (1 << 64 if bits[0] == "1" else 0)]
            assert abs(r.f["mean"] - image.mean()) < 1e-9 and abs(r.f["deviation"] - image.std()) < 1e-9
        if a is None or b is None or len(a) != len(b) or not a:
            assert r.m["mse"] is None
        else:
            assert abs(r.m["mse"] - np.mean((np.array(a) - b) ** 2)) < 1e-9
        if image is None or not image.size or b is None or len(a) != len(b):
            assert r.edge is None
            continue
        masks = []
        for x in (image, np.array(b[: image.size]).reshape(-1, WIDTH)):
            mask = np.zeros(x.shape, bool)
            mask[:, :-1] |= np.abs(x[:, 1:] - x[:, :-1]) > 0.5
            mask[:-1] |= np.abs(x[1:] - x[:-1]) > 0.5
            masks.append(grown(mask, 1))
        x, y = masks
        share = lambda p, q: (p & grown(q, 2)).sum() / p.sum() if p.sum() else 0.0
        assert abs(r.edge - min(share(x, y), share(y, x))) < 1e-9


def test_words_of_long_hashes():
    bits = np.random.default_rng(1).random((5, 200)) > 0.5
    got = frames.words(bits)
    assert got.shape == (5, 4)
    for row, one in zip(got, bits, strict=True):
        text = "".join("1" if x else "0" for x in one).ljust(256, "0")
        assert [int(x) & (1 << 64) - 1 for x in row] == [int(text[k : k + 64], 2) for k in range(0, 256, 64)]


def test_empty_batches():
    assert len(frames._stacked(pd.Series([], dtype=object), 3, lambda x: x, np.zeros(0))) == 0
