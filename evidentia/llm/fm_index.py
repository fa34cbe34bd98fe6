"""A full-text index over integer words: suffix order, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes whose order is still open are sorted again.

    Symbol 0 parts the texts. Each 0 counts as a symbol of its own, so no comparison runs past it.
    """
    n = len(symbols)
    parts = symbols == 0
    rank = symbols.astype(np.int64) + int(parts.sum())
    rank[parts] = np.arange(parts.sum())
    order = np.argsort(rank, kind="stable")
    rank, open_slots = _ranks(rank, order, np.arange(n), rank)
    width = 1
    while len(open_slots):
        who = order[open_slots]
        after = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        key = rank[who] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        order[open_slots] = who[by]
        rank, open_slots = _ranks(rank, order, open_slots, None, key[by])
        width *= 2
    return order


def _ranks(rank: np.ndarray, order: np.ndarray, slots: np.ndarray, values: np.ndarray | None, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys = values[order[slots]] if keys is None else keys
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(keys)))
    rank = rank.copy()
    rank[order[slots]] = np.repeat(slots[heads], sizes)
    return rank, slots[np.repeat(sizes > 1, sizes)]


class WaveletMatrix:
    """Ranks of any symbol before any place, one bit of the symbol a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            counts = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``, for arrays of both."""
        low = np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            place = np.where(one, zeros + counts[place], place - counts[place])
        return place - low


class FMIndex:
    """Backward search and location of phrases of non-zero symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        symbols = np.append(symbols.astype(np.int64), 0)
        self.n = len(symbols)
        order = suffix_order(symbols)
        self.last = symbols[order - 1]
        counts = np.bincount(symbols, minlength=alphabet + 1)
        self.first = np.cumsum(counts) - counts
        self.ranks = WaveletMatrix(self.last, max(1, int(alphabet).bit_length()))
        kept = (order % sample == 0) | (self.last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.samples = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffix order that begin with each phrase; phrases are right-aligned, -1 pads."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, column] >= 0) & (low < high))
            if not len(live):
                continue
            symbol = phrases[live, column]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: step back until a sampled one is met."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.kept[rows[todo]]
            hit = todo[found]
            out[hit] = self.samples[self.kept_before[rows[hit]]] + steps
            todo = todo[~found]
            symbol = self.last[rows[todo]]
            rows[todo] = self.first[symbol] + self.ranks.rank(symbol, rows[todo])
            steps += 1
        return out
