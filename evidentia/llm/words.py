"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A text column is never turned into Python strings here: the UTF-8 bytes of many documents are split, folded and
hashed together. Memory follows ``SLICE_BYTES``, not the batch; only the word hashes of a single long document
(8 bytes a word) are held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix(np.arange(1000, 1000 + _LONG_WORD, dtype=np.uint64)) | np.uint64(1)
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
FOLD = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
KEEP = _CODES.astype(np.uint8)
#: Words `[^\x20\x09-\x0D]+`.
BLANK_SPLIT = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
LETTER_SPLIT = (_CODES >= 0x80) | ((_CODES >= 48) & (_CODES <= 57)) | _UPPER | ((_CODES >= 97) & (_CODES <= 122))


@dataclass
class Slice:
    """Documents ``lo`` to ``hi`` of a batch. Document ``lo + i`` owns words ``first[i]`` to ``first[i + 1]``."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each text's bounds in them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _split(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[bounds] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    place = np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)
    long = np.flatnonzero(lengths > _LONG_WORD)
    if len(long):
        np.minimum(place, _LONG_WORD - 1, out=place)
    hashes = np.add.reduceat(_BYTE[fold[data[inside]]] * _PLACE[place], heads)
    for i in long:
        hashes[i] = xxhash.xxh3_64_intdigest(fold[data[starts[i] : ends[i]]].tobytes())
    return mix(hashes ^ (lengths.astype(np.uint64) << np.uint64(48))), starts, ends


def slices(column: pa.Array, is_word: np.ndarray, fold: np.ndarray = KEEP, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The hashed words of a text column, some documents at a time."""
    data, bounds = text_bytes(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        part = data[bounds[lo] : bounds[hi]]
        if len(part) <= limit:
            hashes, starts, ends = _split(part, bounds[lo : hi + 1] - bounds[lo], is_word, fold)
            first = np.searchsorted(starts, bounds[lo : hi + 1] - bounds[lo])
        else:
            pieces, at = [], 0
            while at < len(part):
                cut = min(len(part), at + limit)
                while cut < len(part) and is_word[part[cut]]:
                    cut += 1
                h, s, e = _split(part[at:cut], np.array([0, cut - at]), is_word, fold)
                pieces.append((h, s + at, e + at))
                at = cut
            hashes, starts, ends = (np.concatenate(x) for x in zip(*pieces, strict=True))
            first = np.array([0, len(hashes)])
        yield Slice(lo, hi, hashes, first.astype(np.int64), starts, ends, part)
        lo = hi


def runs(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A rolling 64-bit hash of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step, back = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
    ones = np.ones(len(hashes), np.uint64)
    ones[1:] = step
    up = np.cumprod(ones)
    ones[1:] = back
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * np.cumprod(ones)[:n])


def window_docs(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and document of every window of ``width`` words that lies within one document."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc]
    return start, doc
