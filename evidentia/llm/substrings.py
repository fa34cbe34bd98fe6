"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words
from evidentia.llm.keys import in_small_batches, maybe_broadcast, maybe_in, smallest_first
from evidentia.sources.session import checkpointed, stored

# A difference cover of 31; every residue is a difference of two of its places, exactly one way.
COVER = (0, 1, 3, 8, 12, 18)
PERIOD = 31
#: Range bounds that may be sent to every task (16 MB of longs); more take a join that shuffles texts.
BROADCAST_BOUNDS = 2_000_000
_ANCHOR_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _cover_places(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and document of the ``width``-word windows that begin at cover places of their document."""
    start, doc = words.window_docs(first, width)
    at = np.zeros(PERIOD, bool)
    at[list(COVER)] = True
    chosen = at[(start - first[:-1][doc]) % PERIOD]
    return start[chosen], doc[chosen]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, since they are about to be shuffled."""
    for batch in batches:
        packer = zstandard.ZstdCompressor(level=1)
        packs = [packer.compress(text.as_py() or b"") for text in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("place"), pa.array(packs, pa.binary())], ["row_key", "place", "pack"])


def _anchors(width: int):
    """Anchor hashes of texts of at least one window; ``width`` words a window."""
    size = width - PERIOD + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("row_key").to_numpy(), batch.column("place").to_numpy()
            for part in words.slices(batch.column("text"), words.BLANK_SPLIT):
                start, doc = _cover_places(part.first, size)
                long = np.diff(part.first)[doc] >= width
                start, doc = start[long], part.lo + doc[long]
                hashes = words.runs(part.hashes, size, _ANCHOR_BASE)[start].view(np.int64)
                pairs = np.unique(np.stack([doc, hashes], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[pairs[:, 0]]), pa.array(ids[pairs[:, 0]]), pa.array(pairs[:, 1])], ["row_key", "place", "anchor"])

    return scan


def _windows(width: int):
    """Hash and start of every window that holds an anchor which other documents have too."""
    size = width - PERIOD + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, shared = batch.column("row_key").to_numpy(), batch.column("place").to_numpy(), batch.column("anchors")
            unpack = zstandard.ZstdDecompressor()
            texts = pa.array([unpack.decompress(x.as_py()) for x in batch.column("pack")], pa.large_binary())
            for part in words.slices(texts, words.BLANK_SPLIT):
                places, doc = _cover_places(part.first, size)
                hashes = words.runs(part.hashes, size, _ANCHOR_BASE)[places].view(np.int64)
                marks = np.zeros(len(part.hashes) + 1, np.int32)
                bounds = np.searchsorted(doc, np.arange(part.hi - part.lo + 1))
                for i in range(part.hi - part.lo):
                    own = slice(bounds[i], bounds[i + 1])
                    marks[places[own][np.isin(hashes[own], np.array(shared[part.lo + i].values))] + 1] = 1
                held = np.cumsum(marks)
                start, doc = words.window_docs(part.first, width)
                extends = held[start + PERIOD] > held[start]
                start, doc = start[extends], doc[extends]
                one, two = (words.runs(part.hashes, width, b)[start].view(np.int64) for b in _WINDOW_BASES)
                at = start - part.first[:-1][doc]
                doc = part.lo + doc
                yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(ids[doc]), pa.array(at.astype(np.int32)), pa.array(one), pa.array(two)], ["row_key", "place", "at", "h1", "h2"])

    return scan


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's word count and the digest of its words, joined by one space."""
    for batch in batches:
        n_words, digests = [], []
        for text in batch.column("text").cast(pa.large_binary()):
            own = (text.as_py() or b"").split()
            n_words.append(len(own))
            digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "doc_id", "place")), pa.array(n_words, pa.int64()), pa.array(digests, pa.string())], ["row_key", "doc_id", "place", "n_words", "sha256"])


def _ranges(width: int):
    """Window starts as the word ranges that they cover."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for starts in batch.column("starts"):
                at = np.unique(np.array(starts.values, np.int64))
                heads = np.flatnonzero(np.append(True, np.diff(at) > width))
                tails = np.append(heads[1:], len(at)) - 1
                found.append(np.stack([at[heads], at[tails] + width], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(found, pa.list_(pa.int64()))], ["row_key", "bounds"])

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count of removed words and the digest of what is left of each text."""
    for batch in batches:
        n_removed, digests = [], []
        for text, bounds in zip(batch.column("text").cast(pa.large_binary()), batch.column("bounds"), strict=True):
            own = (text.as_py() or b"").split()
            left, at = [], 0
            for lo, hi in np.array(bounds.values).reshape(-1, 2).tolist():
                left += own[at:lo]
                at = hi
            left += own[at:]
            n_removed.append(len(own) - len(left))
            digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["row_key", "n_removed", "left_sha256"])


def repeated_ranges(docs: DataFrame, width: int = 50) -> DataFrame:
    """``row_key, bounds``: the word ranges of windows whose words also stand in a row with a smaller ``place``.

    ``docs`` has ``row_key`` (unique), ``place`` (long, the order of documents) and ``text``; ``bounds`` is lo, hi,
    lo, hi and so on. Anchors are windows of ``width - PERIOD + 1`` words at difference-cover places, so any
    common window of ``width`` words has an anchor at a cover place of both documents. Anchors of one document only
    are dropped by an aggregation that combines before it shuffles; around the others every window is extended to
    its full width and compared by a 128-bit hash. The smallest place of each window comes from an aggregation
    too, so no group of copies meets in one task, and the join back can be split.
    """
    texts = in_small_batches(docs).select("row_key", "place", "text")
    anchors = texts.mapInArrow(_anchors(width), "row_key long, place long, anchor long")
    shared = anchors.groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").select("anchor")
    shared = stored(shared)
    held = maybe_in(anchors, shared, "anchor").join(shared, "anchor").groupBy("row_key").agg(F.collect_set("anchor").alias("anchors"))
    packs = texts.mapInArrow(_packed, "row_key long, place long, pack binary").join(held, "row_key")
    windows = stored(packs.select("row_key", "place", "anchors", "pack").mapInArrow(_windows(width), "row_key long, place long, at int, h1 long, h2 long"))
    low = windows.groupBy("h1", "h2").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").drop("high")
    low = stored(low)
    starts = maybe_in(windows, low.select("h1"), "h1").join(low, ["h1", "h2"]).filter("low < place").groupBy("row_key").agg(F.collect_list("at").alias("starts"))
    return starts.mapInArrow(_ranges(width), "row_key long, bounds array<long>")


def dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs`` (``doc_id, text``).

    A word goes if a window of ``width`` consecutive words covers it whose sequence also starts in a document with
    a smaller id; windows are judged on the input. Texts of one word sequence are told first: all but those of the
    smallest id go whole and the windows of one are looked at only. Null texts have no words, null ids come after
    all others and remove nothing from each other, repeated ids are one document in that order and each row is
    judged, an empty table gives no rows.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), smallest_first().alias("place"), F.col("text").cast("string").alias("text"))
    whole = checkpointed(rows.mapInArrow(_whole, "row_key long, doc_id long, place long, n_words long, sha256 string"))
    low = whole.filter(F.col("n_words") >= width).groupBy("sha256").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").drop("high")
    copies = checkpointed(whole.filter(F.col("n_words") >= width).join(low, "sha256").filter("place > low").select("row_key").distinct())
    texts = rows.join(maybe_broadcast(copies), "row_key", "left_anti")
    found = checkpointed(repeated_ranges(texts, width))
    # A range is two longs, so as many of them as ids fit.
    few = found.agg(F.coalesce(F.sum(F.size("bounds") + 2), F.lit(0))).first()[0] <= BROADCAST_BOUNDS
    cut = rows.join(F.broadcast(found) if few else found, "row_key").select("row_key", "text", "bounds").mapInArrow(_cut, "row_key long, n_removed long, left_sha256 string")
    gone = copies.select("row_key", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("left_sha256"))
    gone = gone.unionByName(cut.dropDuplicates(["row_key"])).withColumn("hit", F.lit(True))
    out = whole.join(gone, "row_key", "left")
    removed = F.when(F.col("hit"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("left_sha256", "sha256").alias("kept_sha256"))
