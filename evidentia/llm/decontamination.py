"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words
from evidentia.llm.fm_index import FMIndex
from evidentia.llm.keys import maybe_broadcast
from evidentia.sources.session import checkpointed

#: Characters of benchmark texts that one search block holds; more items take more blocks, never a cut.
BLOCK_CHARS = 8_000_000
#: Texts whose spans may be sent to every task (a digest and a few bounds each); more take a join that shuffles.
BROADCAST_TEXTS = 100_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = {i: i + 32 for i in range(65, 91)}
_FOUND = "doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"


class Phrases:
    """The windows of some items, as symbol sequences over the items' own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        column = pa.array([text for _, text in items], pa.string())
        sequences: dict[tuple[int, ...], set[int]] = {}
        for part in words.slices(column, words.LETTER_SPLIT, words.FOLD):
            for i in range(part.hi - part.lo):
                own = part.hashes[part.first[i] : part.first[i + 1]].tolist()
                size = min(width, len(own))
                for at in range(len(own) - size + 1) if own else ():
                    sequences.setdefault(tuple(own[at : at + size]), set()).add(part.lo + i)
        self.names = [name for name, _ in items]
        self.vocabulary = np.array(sorted({h for s in sequences for h in s}), np.uint64)
        self.width = width
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.table = np.full((len(sequences), width), -1, np.int64)
        for k, s in enumerate(sequences):
            self.table[k, width - len(s) :] = np.searchsorted(self.vocabulary, np.array(s, np.uint64)) + 1
        self.owners = [sorted(x) for x in sequences.values()]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.gate[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _shard_hits(symbols: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Start word and phrase of every occurrence in a shard.

    The shard's text for the index is every maximal run of phrase vocabulary that is long enough for a phrase;
    any other word, and each document's end, parts two runs.
    """
    if not len(symbols) or not len(phrases.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = symbols > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[first[:-1][first[:-1] < len(symbols)]] = True
    opens &= inside
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    kept = ends - starts >= phrases.shortest
    starts, ends = starts[kept], ends[kept]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts + 1
    heads = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(heads, sizes) + np.repeat(starts, sizes)
    text = np.zeros(len(place), np.int64)
    is_word = np.ones(len(place), bool)
    is_word[heads + sizes - 1] = False
    text[is_word] = symbols[place[is_word]]
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.table)
    sizes = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    return place[index.locate(rows)], which


def _merged(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch become one, but never across two documents, which stand side by side."""
    by = np.argsort(starts, kind="stable")
    starts, reach, doc = starts[by], np.maximum.accumulate(ends[by]), doc[by]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return starts[heads], reach[np.append(heads[1:], len(starts)) - 1]


def _scan(phrases: Phrases):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(p.lo, p.first, phrases.symbols(p.hashes) if len(phrases.lengths) else np.zeros(len(p.hashes), np.int64)) for p in words.slices(batch.column("text"), words.LETTER_SPLIT, words.FOLD)]
            shard: list[tuple[int, np.ndarray, np.ndarray]] = []
            rows: list[tuple[int, list, list]] = []
            for k, part in enumerate(parts):
                shard.append(part)
                if sum(len(x[2]) for x in shard) >= 4_000_000 or k == len(parts) - 1:
                    rows += _shard_rows(shard, phrases)
                    shard = []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key"),
                    batch.column("doc_id"),
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([x[1] for x in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array([x[2] for x in rows], pa.list_(pa.string())),
                ],
                ["row_key", "doc_id", "n_words", "spans", "items"],
            )

    return scan


def _shard_rows(shard: list[tuple[int, np.ndarray, np.ndarray]], phrases: Phrases) -> list[tuple[int, list, list]]:
    counts = np.concatenate([np.diff(first) for _, first, _ in shard])
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, which = _shard_hits(np.concatenate([s for _, _, s in shard]), first, phrases)
    rows: list[tuple[int, list, list]] = [(int(n), [], []) for n in counts]
    if len(starts):
        doc = np.searchsorted(first, starts, side="right") - 1
        lo, hi = _merged(starts, starts + phrases.lengths[which], doc)
        for d, a, b in zip(np.searchsorted(first, lo, side="right") - 1, lo, hi, strict=True):
            rows[d][1].append({"lo": int(a - first[d]), "hi": int(b - first[d])})
        owned: dict[int, set[int]] = {}
        for d, k in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            owned.setdefault(d, set()).update(phrases.owners[k])
        for d, own in owned.items():
            rows[d][2].extend(sorted({phrases.names[i] for i in own}))
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Benchmark words in documents: ``row_key, doc_id, n_words, spans, items`` for each row of ``docs``.

    ``docs`` needs ``row_key`` (unique), ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``. Texts are lower-cased
    in A-Z and split at ASCII characters that are neither letters nor digits. ``spans`` are the merged word ranges
    ``[lo, hi)`` that any window of ``width`` consecutive item words covers (an item of fewer words is one window),
    ``items`` the ids of the items with such a window, sorted as strings. Each shard (the documents of an Arrow
    batch, cut at 4 million words) gets an FM-index: phrases are searched backwards through wavelet-matrix ranks
    and their places read off sampled suffix positions. The benchmark is the query set: it is taken in blocks of
    ``block_chars`` characters, each small enough to be sent to all tasks, and the blocks' spans are merged.

    Null texts have no words, null item ids count as the empty string, equal windows of several items count for
    each of them, repeated rows are judged alike, and empty tables give rows without spans. Words are compared by
    64-bit hashes.
    """
    docs = docs.select("row_key", "doc_id", "text")
    found_as = f"row_key {docs.schema['row_key'].dataType.simpleString()}, {_FOUND}"
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    found = []
    for block in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = Phrases([(r.item_id, r.text) for r in own.collect()], width)
        found.append(docs.mapInArrow(_scan(phrases), found_as))
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<lo:bigint,hi:bigint>>), (done, x) -> if(size(done) > 0 and element_at(done, -1).hi >= x.lo,"
        " concat(slice(done, 1, size(done) - 1), array(named_struct('lo', element_at(done, -1).lo, 'hi', greatest(element_at(done, -1).hi, x.hi)))), concat(done, array(x))))"
    )
    return every.withColumn("spans", joined)


def without_spans(text: str | None, spans: list) -> str | None:
    """The text less the word ranges, from each range's first to its last character."""
    if text is None or not spans:
        return text
    places = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for span in spans:
        out.append(text[at : places[span["lo"]][0]])
        at = places[span["hi"] - 1][1]
    return "".join([*out, text[at:]])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([without_spans(text, found) for text, found in zip(texts, spans, strict=True)], dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents with every benchmark span cut out of ``text``; other columns and all rows stay.

    ``n_chars``, where there is one, is set to the new length. Rows are as in :func:`find_leaks`; only texts with
    spans meet the cut, the rest pass through Arrow once. Spans depend on the text alone, so they are joined back by
    its digest, which a recomputed task can't number otherwise. Null texts stay null, copies are cut alike.
    """
    wide = docs.select(F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find_leaks(wide.select("row_key", F.lit(None).cast("long").alias("doc_id"), F.col("row.text").alias("text")), benchmark, width)
    found = found.filter(F.size("spans") > 0).select("row_key", "spans").dropDuplicates(["row_key"])
    wide = wide.join(maybe_broadcast(checkpointed(found), BROADCAST_TEXTS), "row_key", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.pandas_udf(_cut, "string")("row.text", "spans"))
    out = wide.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
