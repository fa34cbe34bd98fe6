"""Mixture-controlled packing: deficit round-robin over source queues, every window to the target proportions.

Each source has a queue of documents and, every round, a credit of ``sequence`` tokens times its weight. A source
sends the next ``grain`` tokens of its queue as soon as its credit covers them; what it can't use yet it carries as a
deficit into the next round. So after r rounds a source has sent all grains that end within r credits of its queue:
a grain's round follows from its place in the queue alone, and no task has to wait for another. Prefix sums over
queues, rounds and sources give each grain its place in one gapless stream, which is cut into sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from evidentia.llm.keys import in_small_batches, maybe_broadcast
from evidentia.sources.session import stored

#: Words that a worker remembers; beyond it starts anew, which costs time only.
REMEMBERED = 3 << 18
#: Bytes of texts that are tokenized at once, but for a text that is longer.
SLICE = 1 << 22
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_BREAK = r"([a-z])([!-/:-@\[-`{-~])"


@dataclass(frozen=True)
class Packing:
    """Parameters.

    ``weights`` names the target share of sources, in any unit; a source not named, and all where none is, weighs as
    much as it has tokens, so that all sources last to the end. A source that runs out leaves its share to the others
    by weight. ``grain`` is the least piece worth cutting from a document, and the bound of a source's deficit.
    """

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    end: int = 2
    sequence: int = 4096
    grain: int = 32
    weights: Mapping[str, float] = field(default_factory=dict)


class _Words:
    """The ids of words, remembered. Letters alone in lower case go to the model at once, all else the whole way."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters: dict[int, str] = {}
        self.known: dict[str, bytes] = {}
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # The short way holds for tokenizers that fold case, part words from marks and drop white space.
        probe = "aé,b c\nd"
        self.short = normal is not None and split is not None and normal.normalize_str("AÉ") == "aé" and [w for w, _ in split.pre_tokenize_str(normal.normalize_str(probe))] == [self.byte_level(w) for w in ("aé", ",", "b", "c", "d")]

    def byte_level(self, word: str) -> str:
        for x in word:
            if ord(x) not in self.letters:
                self.letters[ord(x)] = self.bytes.pre_tokenize_str(x)[0][0]
        return word.translate(self.letters)

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, tokenize, other = self.known, self.tokenizer.model.tokenize, []
        for word in words:
            if word.isascii():
                # White space is gone and A-Z are lower case by now.
                if word.isalpha():
                    known[word] = array("I", [t.id for t in tokenize(word)]).tobytes()
                else:
                    other.append(word)
            elif _PLAIN.fullmatch(word):
                known[word] = array("I", [t.id for t in tokenize(self.byte_level(word))]).tobytes()
            else:
                other.append(word)
        for word, code in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[word] = array("I", code.ids).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's bounds in them."""
        if not self.short:
            codes = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*codes, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, codes)])
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _BREAK, r"\1 \2"))
        flat = words.flatten().dictionary_encode()
        own = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.known.get, own))
        fresh = [k for k, code in enumerate(codes) if code is None]
        self.learn([own[k] for k in fresh])
        for k in fresh:
            codes[k] = self.known[own[k]]
        table = np.frombuffer(b"".join(codes), np.uint32)
        lengths = np.fromiter(map(len, codes), np.int32, len(codes)) // 4
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        which = flat.indices.to_numpy(zero_copy_only=False)
        counts = lengths[which]
        # A slice of texts has fewer than 2^31 ids.
        ends = np.zeros(len(which) + 1, np.int32)
        np.cumsum(counts, out=ends[1:])
        place = np.repeat(starts[which] - ends[:-1], counts)
        place += np.arange(len(place), dtype=np.int32)
        bounds = words.offsets.to_numpy()
        return table[place], ends[bounds - bounds[0]].astype(np.int64)


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _narrow(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text in two bytes each where all of the slice fit, else in four, after a byte that tells which."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    sizes = np.diff(bounds) * width + 1
    ends = np.zeros(len(bounds), np.int64)
    np.cumsum(sizes, out=ends[1:])
    data = np.full(ends[-1], width, np.uint8)
    own = np.ones(ends[-1], bool)
    own[ends[:-1]] = False
    data[own] = ids.astype(f"<u{width}").view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together while they stay within ``SLICE`` bytes: the more texts at once, the more words are alike."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > SLICE:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype("<u4")


def tokenized(docs: DataFrame, packing: Packing) -> DataFrame:
    """``row_key, doc_id, source, part, at, n, ids``: each document's ids with the end id, kept in the shared folder.

    ``at`` counts the tokens of the same source before it in its partition ``part``, so a queue's order is that of
    the rows read and needs no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, sent = _words(packing.tokenizer), TaskContext.get().partitionId(), {}
        row = part << 40
        for whole in _gathered(batches):
            texts = pc.fill_null(whole.column(2).cast(pa.large_string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(whole):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, side="right")))
                ids, bounds = words.ids(texts[lo:hi])
                ids, bounds = np.insert(ids, bounds[1:], np.uint32(packing.end)), bounds + np.arange(len(bounds))
                n, at = np.diff(bounds), []
                for source, size in zip(whole.column(1)[lo:hi].to_pylist(), n.tolist(), strict=True):
                    at.append(sent.get(source, 0))
                    sent[source] = at[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), whole.column(0)[lo:hi], whole.column(1)[lo:hi], pa.array(np.full(hi - lo, part, np.int32)), pa.array(at, pa.int64()), pa.array(n), _narrow(ids, bounds)],
                    ["row_key", "doc_id", "source", "part", "at", "n", "ids"],
                )
                row, lo = row + hi - lo, hi

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(scan, "row_key long, doc_id long, source string, part int, at long, n long, ids binary"))


#: Fractions of a token in which credits are counted.
_FINE = 1 << 16
#: Rows of a block, and blocks of a larger one, in :func:`before`.
_BLOCK = 4096


def before(rows: DataFrame, place: str, value: str) -> DataFrame:
    """``rows`` (one for each long ``place``, from 0) and ``before``, the sum of ``value`` at smaller places.

    Sums go up two levels of blocks, so no task has more than 4,096 rows but the last, which has one row for each
    16.8 million places.
    """
    upto = (Window.unboundedPreceding, -1)

    def running(of: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
        frame = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(*upto)
        return of.withColumn(name, F.coalesce(F.sum(column).over(frame), F.lit(0)))

    rows = rows.withColumns({"_b": F.expr(f"{place} div {_BLOCK}"), "_c": F.expr(f"{place} div {_BLOCK * _BLOCK}")})
    blocks = rows.groupBy("_c", "_b").agg(F.sum(value).alias("_n"))
    tops = running(blocks.groupBy("_c").agg(F.sum("_n").alias("_m")), [], "_c", "_m", "_top").select("_c", "_top")
    blocks = running(blocks, ["_c"], "_b", "_n", "_mid").join(tops, "_c").select("_b", (F.col("_mid") + F.col("_top")).alias("_upto"))
    rows = running(rows, ["_b"], place, value, "_own").join(blocks, "_b")
    return rows.withColumn("before", (F.col("_own") + F.col("_upto")).cast("long")).drop("_b", "_c", "_own", "_upto")


def queues(docs: DataFrame, packing: Packing) -> tuple[DataFrame, int]:
    """``source, part, shift, credit`` (the queue's tokens before a partition, and its credit a round) and all tokens."""
    parts = docs.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sizes = parts.groupBy("source").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    named = {k: float(v) for k, v in packing.weights.items() if v > 0}
    weight: Column = F.col("size") / F.lit(float(total or 1))
    if named:
        given = F.element_at(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
        weight = F.coalesce(given / sum(named.values()), weight)
    sizes = sizes.select("source", F.greatest(F.lit(1), F.ceil(weight * packing.sequence * _FINE)).cast("long").alias("credit"))
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("shift"))
    return parts.join(sizes, "source"), int(total)


def served(docs: DataFrame, parts: DataFrame, packing: Packing) -> DataFrame:
    """``row_key, source, round, start, length, place``: what is sent of each document in each round.

    ``place`` is the first token's in the source's queue. A grain that ends at x is sent in the first round whose
    credits reach x; a document's last grain may be shorter.
    """
    grain = packing.grain
    rows = docs.select("row_key", "source", "part", "at", "n").join(maybe_broadcast(parts), ["source", "part"])
    rows = rows.withColumn("x", F.col("at") + F.col("shift"))
    first, last = F.expr(f"((x + least(n, {grain})) * {_FINE} + credit - 1) div credit"), F.expr(f"((x + n) * {_FINE} + credit - 1) div credit")
    # Rounds in which a document sends nothing aren't written out where credits are small: one row for each grain then.
    few = F.expr(f"transform(sequence(1, (n + {grain - 1}) div {grain}), g -> ((x + least(n, g * {grain})) * {_FINE} + credit - 1) div credit)")
    rounds = F.when(last - first < F.expr(f"(n + {grain - 1}) div {grain}"), F.sequence(first, last)).otherwise(F.array_distinct(few))
    rows = rows.withColumn("round", F.explode(rounds))

    def sent(upto: str) -> Column:
        reach = f"(({upto}) * credit div {_FINE} - x)"
        return F.expr(f"if({reach} >= n, n, greatest(0L, {reach} div {grain} * {grain}))")

    rows = rows.withColumns({"start": sent("round - 1"), "stop": sent("round")}).filter("stop > start")
    return rows.select("row_key", "source", "round", "start", (F.col("stop") - F.col("start")).alias("length"), (F.col("x") + F.col("start")).alias("place"))


def pack(docs: DataFrame, packing: Packing | None = None) -> DataFrame:
    """Pieces of all documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    The stream of all rounds is cut every ``sequence`` tokens. What is left at its end goes into sequences of powers
    of two, so nothing is padded at all. A piece's ids are those from ``start``; pieces of a document that follow one
    another in a sequence are one.

    A null text is empty and has the end id alone, as an empty one has; null sources are the queue ""; rows that
    repeat an id, or have none, are documents of their own; an empty table gives no rows; other columns don't matter.
    """
    packing = packing or Packing()
    rows = tokenized(docs, packing)
    parts, total = queues(rows, packing)
    sent = stored(served(rows, stored(parts), packing))
    shares = sent.groupBy("round", "source").agg(F.sum("length").alias("n"), F.min("place").alias("least"))
    # A round has one row for each source, in order of the queue.
    own = Window.partitionBy("round").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    shares = stored(shares.withColumn("inner", F.coalesce(F.sum("n").over(own), F.lit(0))))
    starts = before(shares.groupBy("round").agg(F.sum("n").alias("n")), "round", "n").select("round", "before")
    shares = shares.join(starts, "round").select("round", "source", (F.col("before") + F.col("inner") - F.col("least")).alias("lift"))
    sent = sent.join(shares, ["round", "source"]).select("row_key", "start", "length", (F.col("place") + F.col("lift")).alias("at"))

    size, whole = packing.sequence, total // packing.sequence * packing.sequence
    ends, at = [], whole
    for k in reversed(range(size.bit_length())):
        if total - whole & 1 << k:
            ends.append(at := at + (1 << k))
    tail = f"array({', '.join(f'{x}L' for x in ends)})" if ends else "cast(array() as array<bigint>)"
    inner = f"sequence(at div {size} + 1, greatest(at div {size} + 1, (at + length - 1) div {size}))"
    cuts = f"array_distinct(filter(concat(array(at), transform({inner}, w -> w * {size}L), {tail}), c -> c >= at and c < at + length and (c <= {whole}L or c = at or array_contains({tail}, c))))"
    sent = sent.withColumn("cuts", F.expr(f"sort_array({cuts})"))
    pieces = sent.select("row_key", "at", "start", "length", F.posexplode("cuts").alias("k", "cut"), "cuts")
    pieces = pieces.select("row_key", (F.col("start") + F.col("cut") - F.col("at")).alias("start"), (F.coalesce(F.get("cuts", F.col("k") + 1), F.col("at") + F.col("length")) - F.col("cut")).alias("length"), "cut")
    place = F.expr(f"if(cut < {whole}L, cut div {size}, {whole // size}L + size(filter({tail}, e -> e <= cut)))")
    begin = F.expr(f"if(cut < {whole}L, cut div {size} * {size}, coalesce(array_max(filter({tail}, e -> e <= cut)), {whole}L))")
    pieces = pieces.select("row_key", "start", "length", place.cast("long").alias("sequence_id"), (F.col("cut") - begin).alias("offset"))
    return _checked(rows, pieces)


def _checked(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces with their ids' CRC-32: ids and pieces of a document meet in one task, in order, a document at a time."""
    nothing = {c: F.lit(None).cast("long") for c in ("start", "length", "sequence_id", "offset")}
    left = rows.select("row_key", "doc_id", "source", "ids", *[v.alias(k) for k, v in nothing.items()])
    right = pieces.select("row_key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("ids"), "start", "length", "sequence_id", "offset")
    both = left.unionByName(right).repartition("row_key").sortWithinPartitions("row_key", F.col("start").asc_nulls_first())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    kinds = pa.schema([(c, pa.string() if c == "source" else pa.int64()) for c in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, source, ids, last = None, None, np.zeros(0, "<u4"), None

        def piece(x: tuple[int, int, int, int]) -> tuple:
            return doc, x[0], x[1], zlib.crc32(ids[x[0] : x[0] + x[1]].tobytes()), len(ids), x[2], x[3], source

        for batch in batches:
            out, columns = [], [batch.column(k) for k in range(batch.num_columns)]
            plain = [columns[k].to_pylist() for k in (4, 5, 6, 7)]
            for k, x in enumerate(zip(*plain, strict=True)):
                if x[0] is None:
                    if last is not None:
                        out.append(piece(last))
                    doc, source, ids, last = columns[1][k].as_py(), columns[2][k].as_py(), _wide(columns[3][k].as_py()), None
                elif last is not None and x[2] == last[2] and x[0] == last[0] + last[1] and x[3] == last[3] + last[1]:
                    last = (last[0], last[1] + x[1], *last[2:])
                else:
                    if last is not None:
                        out.append(piece(last))
                    last = x
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece(last), kinds.types, strict=True)], names)

    return both.mapInArrow(scan, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
