"""The matching-blocks ratio of two texts, and bounds of it that are cheaper to tell."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A second text of so many characters or more doesn't begin a block with a character that it has too often.
OFTEN_FROM = 200
#: Pairs of equal characters that are held at once; where texts have more, blocks are told by runs of one length at a time.
MOST_POINTS = 1 << 14
#: Characters, points, and counts of characters by text that pairs may have that are told together; a pair that alone
#: has more, or is ``LONG``, is told by itself. Places must stay below ``_LAST``.
MOST_CHARACTERS, MOST_TOGETHER, MOST_CELLS, LONG = 1 << 18, 1 << 20, 1 << 21, 1 << 14
_LAST = (1 << 21) - 1


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _seeds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of ``b`` by character, and where those of each character of ``a`` that may begin a block lie in them."""
    order = np.argsort(b, kind="stable")
    held = b[order]
    lo, hi = np.searchsorted(held, a, "left"), np.searchsorted(held, a, "right")
    if len(b) >= OFTEN_FROM:
        hi = np.where(hi - lo > len(b) // 100 + 1, lo, hi)
    return order, lo, hi


class _Runs:
    """All runs of equal characters along one diagonal, as first places in both texts and lengths."""

    def __init__(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int = 0) -> None:
        n = hi - lo
        i = np.repeat(np.arange(len(lo)), n)
        j = order[np.arange(len(i)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        place = np.lexsort((i, j - i))
        i, j = i[place] + first, j[place]
        heads = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))) if len(i) else np.zeros(0, np.int64)
        self.at = (i[heads], j[heads], np.diff(np.append(heads, len(i))))

    def inside(self, box: tuple[int, int, int, int], of: tuple) -> tuple[tuple, tuple[int, int, int]]:
        """The runs of ``of`` that reach into a box, and the longest in it: the first by place in one text, then the other."""
        alo, ahi, blo, bhi = box
        i, j, n = of
        skip = np.maximum(0, np.maximum(alo - i, blo - j))
        size = np.minimum(n, np.minimum(ahi - i, bhi - j)) - skip
        keep = np.flatnonzero(size > 0)
        if not len(keep):
            return (i[keep], j[keep], n[keep]), (alo, blo, 0)
        skip, size = skip[keep], size[keep]
        mine = i[keep], j[keep], n[keep]
        longest = np.flatnonzero(size == size.max())
        first = longest[np.lexsort((mine[1][longest] + skip[longest], mine[0][longest] + skip[longest]))[0]]
        return mine, (int(mine[0][first] + skip[first]), int(mine[1][first] + skip[first]), int(size[first]))


class _Grams:
    """The runs of characters that may begin a block, by length: places of both texts that begin with equal ones are numbered alike.

    Those of 1, 2, 4, ... characters are numbered by doubling, of other lengths by two of these that overlap. So what is
    held grows with the texts, not with their pairs of equal characters.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, begins: np.ndarray) -> None:
        self.a, self.of, self.order, self.begins = a.astype(np.int64), len(b) + 1, order, begins
        self.held = b[order].astype(np.int64) * self.of + order
        kinds = np.unique(a[begins])
        self.levels = [(self._numbered(a, kinds), self._numbered(b, kinds), len(kinds))]
        while len(kinds):
            n = 1 << len(self.levels)
            x, y = self._keys(0, len(a), n, 0), self._keys(0, len(b), n, 1)
            kinds = np.intersect1d(x[x >= 0], y[y >= 0])
            self.levels.append((self._numbered(x, kinds), self._numbered(y, kinds), len(kinds)))

    @staticmethod
    def _numbered(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        if not len(kinds):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
        return np.where(kinds[at] == x, at, -1)

    def _keys(self, lo: int, hi: int, n: int, side: int) -> np.ndarray:
        """Of each place of a text from which ``n`` characters stay in a range, what they are; -1 if no run begins so."""
        level = min(n.bit_length(), len(self.levels)) - 1
        to, on = max(lo, hi - n + 1), n - (1 << level)
        own, kinds = self.levels[level][side], self.levels[level][2]
        u, v = own[lo:to], own[lo + on : to + on]
        return np.where((u >= 0) & (v >= 0), u * kinds + v, -1)

    def points(self, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``order`` the places of each of a box's characters lie that may begin a block."""
        alo, ahi, blo, bhi = box
        own = self.a[alo:ahi] * self.of
        lo = np.searchsorted(self.held, own + blo)
        return lo, np.where(self.begins[alo:ahi], np.searchsorted(self.held, own + bhi), lo)

    def longest(self, box: tuple[int, int, int, int], most: int) -> int:
        """The length of the longest run in a box, ``most`` at most."""
        alo, ahi, blo, bhi = box
        good, bad = 0, min(most, ahi - alo, bhi - blo, (1 << len(self.levels) - 1) - 1) + 1
        while bad - good > 1:
            n = min(max(1, 2 * good), (good + bad) // 2)
            x, y = self._keys(alo, ahi, n, 0), self._keys(blo, bhi, n, 1)
            good, bad = (n, bad) if np.isin(x[x >= 0], y[y >= 0]).any() else (good, n)
        return good

    def places(self, box: tuple[int, int, int, int], n: int) -> Callable[[int, int], tuple[int, int] | None]:
        """The first run of ``n`` characters in a box from two places on, that in the first text first."""
        alo, ahi, blo, bhi = box
        x, y = self._keys(alo, ahi, n, 0), self._keys(blo, bhi, n, 1)
        i, j = np.flatnonzero(np.isin(x, y[y >= 0])), np.flatnonzero(y >= 0)
        kinds = np.unique(y[j])
        x, y = np.searchsorted(kinds, x[i]) * self.of, np.sort(np.searchsorted(kinds, y[j]) * self.of + j + blo)
        i += alo

        def first(a: int, b: int) -> tuple[int, int] | None:
            at, wide = int(np.searchsorted(i, a)), 16
            while at < len(i):
                own = x[at : at + wide]
                to = y.take(np.searchsorted(y, own + b), mode="clip") - own
                found = np.flatnonzero((to >= b) & (to < self.of))
                if len(found):
                    return int(i[at + found[0]]), int(to[found[0]])
                at, wide = at + wide, 2 * wide
            return None

        return first


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many characters two texts of one length have in common from the start."""
    done, wide = 0, 64
    while done < len(a):
        apart = np.flatnonzero(a[done : done + wide] != b[done : done + wide])
        if len(apart):
            return done + int(apart[0])
        done, wide = done + wide, 2 * wide
    return len(a)


def _block(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int], run: tuple[int, int, int]) -> tuple[int, int, int]:
    """A run in a box made as long as it goes."""
    alo, ahi, blo, bhi = box
    i, j, size = run
    back = min(i - alo, j - blo)
    less = _alike(a[i - back : i][::-1], b[j - back : j][::-1])
    i, j, size = i - less, j - less, size + less
    ahead = min(ahi - i - size, bhi - j - size)
    return i, j, size + _alike(a[i + size : i + size + ahead], b[j + size : j + size + ahead])


def _matched_by_runs(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int], runs: _Runs) -> int:
    total, work = 0, [(box, runs.at)]
    while work:
        box, own = work.pop()
        alo, ahi, blo, bhi = box
        if alo == ahi or blo == bhi:
            continue
        own, run = runs.inside(box, own)
        i, j, size = _block(a, b, box, run)
        if size:
            total += size
            work += [((alo, i, blo, j), own), ((i + size, ahi, j + size, bhi), own)]
    return total


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """The characters in matching blocks: the longest block, then those of what is left of it and of what is right.

    A block begins with characters that the second text doesn't have too often and is then made as long as it goes.
    """
    order, lo, hi = _seeds(a, b)
    whole = 0, len(a), 0, len(b)
    if int((hi - lo).sum()) <= MOST_POINTS:
        return _matched_by_runs(a, b, whole, _Runs(order, lo, hi))
    grams = _Grams(a, b, order, hi > lo)
    total, work = 0, [(whole, len(a))]
    while work:
        box, most = work.pop()
        alo, ahi, blo, bhi = box
        if alo == ahi or blo == bhi:
            continue
        lo, hi = grams.points(box)
        if int((hi - lo).sum()) <= MOST_POINTS:
            total += _matched_by_runs(a, b, box, _Runs(order, lo, hi, alo))
            continue
        # All blocks with runs of the greatest length, from left to right; what is left of each has shorter ones only.
        n = grams.longest(box, most)
        first = grams.places(box, n)
        while run := first(alo, blo):
            i, j, size = _block(a, b, (alo, ahi, blo, bhi), (*run, n))
            total += size
            work.append(((alo, i, blo, j), n - 1))
            alo, blo = i + size, j + size
        work.append(((alo, ahi, blo, bhi), n - 1))
    return total


def ratio(one: str | None, two: str | None) -> float:
    """Twice the matched characters by all characters; 1 for two empty texts."""
    a, b = codes(one), codes(two)
    return 2.0 * matched(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def bound(one: str | None, two: str | None) -> float:
    """No ratio is above that of the characters that both texts have, whatever their order."""
    a, b = codes(one), codes(two)
    if not len(a) + len(b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(n[i], m[j]).sum()) / (len(a) + len(b))


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of texts one after another with a gap after each, each one's text, and where the texts begin."""
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes("\0".join([*texts, ""])), np.repeat(np.arange(len(texts)), n), np.append(0, np.cumsum(n))


def _counted(ones: list[str], twos: list[str]) -> tuple | None:
    """Both sides laid out, their characters numbered from 1 by text, and how often each text has each; None if too many."""
    (a, p, i), (b, q, j) = _laid(ones), _laid(twos)
    place = np.zeros(int(max(a.max(), b.max())) + 1, np.int64)
    place[a] = place[b] = 1
    kinds = int(place.sum())
    if kinds * len(ones) > MOST_CELLS and len(ones) > 1:
        return None
    place = np.cumsum(place) - 1
    ka, kb = p * kinds + place[a], q * kinds + place[b]
    ends = np.ones(len(ka), bool), np.ones(len(kb), bool)
    ends[0][i[1:] - 1] = ends[1][j[1:] - 1] = False
    shape = (len(ones), kinds)
    na, nb = (np.bincount(k[e], minlength=shape[0] * kinds).reshape(shape) for k, e in ((ka, ends[0]), (kb, ends[1])))
    return (a, p, i, ka, ends[0], na), (b, q, j, kb, ends[1], nb)


def _ahead(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How far two arrays agree from places on, ``most`` at most, in steps of 1 or -1."""
    out, left, wide = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 8
    while len(left):
        n = out[left]
        on = n[:, None] + np.arange(wide)
        same = a.take(i[left, None] + step * on, mode="clip") == b.take(j[left, None] + step * on, mode="clip")
        same &= on < most[left, None]
        whole = same.all(axis=1)
        out[left] = n + np.where(whole, wide, same.argmin(axis=1))
        left, wide = left[whole], min(2 * wide, 256)
    return out


def _matched_together(one: tuple, two: tuple) -> np.ndarray | None:
    """:func:`matched` of many pairs at once, box by box of all pairs together; None if they have too many points."""
    (a, p, alo, ka, ia, na), (b, q, blo, kb, jb, nb) = one, two
    pairs = len(na)
    long = np.diff(blo) - 1
    begins = (na > 0) & (nb > 0) & ((long < OFTEN_FROM)[:, None] | (nb <= (long // 100 + 1)[:, None]))
    n = np.where(begins, nb, 0).ravel()
    begins = begins.ravel()
    i, j = np.flatnonzero(ia & begins[ka]), np.flatnonzero(jb & begins[kb])
    n, first, of = n[ka[i]], (np.cumsum(n) - n)[ka[i]], len(b) + len(a) + 2
    if n.sum() > MOST_TOGETHER:
        return None
    # Runs of equal characters along a diagonal: points by diagonal, then place; the gaps between texts end them.
    j = j[np.argsort(kb[j], kind="stable")][np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)]
    i = np.repeat(i, n)
    points = np.sort((j - i + len(a)) * of + i)
    heads = np.flatnonzero(np.append(True, np.diff(points) != 1)) if len(points) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(points)))
    d, i = np.divmod(points[heads], of)
    j = d - len(a) + i
    box = p[i]
    order = np.argsort(box, kind="stable")
    i, j, size, box = i[order], j[order], size[order], box[order]
    own, total = np.arange(pairs), np.zeros(pairs, np.int64)
    alo, ahi, blo, bhi = alo[:-1], alo[1:] - 1, blo[:-1], blo[1:] - 1
    while len(own):
        # The longest run of each box, the first by place in one text, then the other; a box without any has its corner.
        skip = np.maximum(0, np.maximum(alo[box] - i, blo[box] - j))
        size = np.minimum(size, np.minimum(ahi[box] - i, bhi[box] - j)) - skip
        keep = size > 0
        i, j, size, box = (i + skip)[keep], (j + skip)[keep], size[keep], box[keep]
        at, to, long = alo.copy(), blo.copy(), np.zeros(len(own), np.int64)
        if len(box):
            heads = np.flatnonzero(np.append(True, np.diff(box) != 0))
            best = np.maximum.reduceat((size << 42) | (_LAST - i << 21) | (_LAST - j), heads)
            at[box[heads]], to[box[heads]], long[box[heads]] = _LAST - (best >> 21 & _LAST), _LAST - (best & _LAST), best >> 42
        back = _ahead(a, at - 1, b, to - 1, np.minimum(at - alo, to - blo), -1)
        at, to, long = at - back, to - back, long + back
        long += _ahead(a, at + long, b, to + long, np.minimum(ahi - at, bhi - to) - long, 1)
        total += np.bincount(own, long, pairs).astype(np.int64)
        # What is left of the blocks, then what is right of them; runs go into the boxes that they reach into.
        one = (long > 0) & (at > alo) & (to > blo)
        two = (long > 0) & (at + long < ahi) & (to + long < bhi)
        left, right = np.cumsum(one) - 1, np.cumsum(two) - 1 + int(one.sum())
        into = one[box] & (i < at[box]) & (j < to[box]), two[box] & (i + size > (at + long)[box]) & (j + size > (to + long)[box])
        i, j, size = (np.concatenate([x[into[0]], x[into[1]]]) for x in (i, j, size))
        box = np.concatenate([left[box[into[0]]], right[box[into[1]]]])
        alo, ahi = np.concatenate([alo[one], (at + long)[two]]), np.concatenate([at[one], ahi[two]])
        blo, bhi = np.concatenate([blo[one], (to + long)[two]]), np.concatenate([to[one], bhi[two]])
        own = np.concatenate([own[one], own[two]])
    return total


def _together(ones: list[str | None], twos: list[str | None], told: Callable, alone: Callable) -> np.ndarray:
    """``told`` of runs of pairs that are short enough to be laid out together, else ``alone`` of a pair."""
    ones, twos = [x or "" for x in ones], [x or "" for x in twos]
    out, size = np.ones(len(ones)), np.fromiter(map(len, ones), np.int64, len(ones)) + np.fromiter(map(len, twos), np.int64, len(twos))
    cuts, held = [0], 0
    for k, n in enumerate(size.tolist()):
        held += n + 2
        if (held > MOST_CHARACTERS or max(n, size[k - 1]) > LONG) and k > cuts[-1]:
            cuts.append(k)
            held = n + 2
    work = list(pairwise([*cuts, len(ones)])) if ones else []
    while work:
        lo, hi = work.pop()
        counted = _counted(ones[lo:hi], twos[lo:hi]) if hi - lo > 1 or size[lo] <= min(MOST_CHARACTERS, LONG) else None
        common = told(*counted) if counted else None
        if common is not None:
            out[lo:hi] = np.where(size[lo:hi] > 0, 2.0 * common / np.maximum(size[lo:hi], 1), 1.0)
        elif hi - lo > 1:
            work += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        else:
            out[lo] = alone(ones[lo], twos[lo])
    return out


def ratios(ones: list[str | None], twos: list[str | None]) -> np.ndarray:
    """:func:`ratio` of each pair."""
    return _together(ones, twos, _matched_together, ratio)


def bounds(ones: list[str | None], twos: list[str | None]) -> np.ndarray:
    """:func:`bound` of each pair."""
    return _together(ones, twos, lambda one, two: np.minimum(one[-1], two[-1]).sum(axis=1), bound)


def best_of(ones: list[str | None], many: list[list[str] | None], turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text's best match among its own list, the first of equal ones, and its ratio; -1 where there is none.

    The one with the largest bound is compared first, of the others only those whose bound still beats its ratio. The
    texts of the list are the second ones of the ratio, the first if ``turned``.
    """
    n = np.fromiter((0 if x is None or y is None else len(y) for x, y in zip(ones, many, strict=True)), np.int64, len(ones))
    row = np.repeat(np.arange(len(ones)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    one, two = [ones[r] for r in row], [y for y, k in zip(many, n, strict=True) if k for y in y]
    one, two = (two, one) if turned else (one, two)
    most, known = bounds(one, two), np.full(len(row), -1.0)

    def tops(by: np.ndarray) -> np.ndarray:
        order = np.lexsort((place, -by, row))
        return order[np.append(True, np.diff(row[order]) != 0)] if len(order) else order

    def tell(which: np.ndarray) -> None:
        known[which] = ratios([one[k] for k in which], [two[k] for k in which])

    first = tops(most)
    tell(first)
    least, at = np.zeros(len(ones)), np.zeros(len(ones), np.int64)
    least[row[first]], at[row[first]] = known[first], place[first]
    tell(np.flatnonzero((known < 0) & ((most > least[row]) | ((most == least[row]) & (place < at[row])))))
    best = tops(known)
    out, score = np.full(len(ones), -1, np.int32), np.full(len(ones), -1.0)
    out[row[best]], score[row[best]] = place[best], known[best]
    return out, score


def best_match(one: Column, many: Column, turned: bool = False) -> Column:
    """``place, ratio`` of :func:`best_of` for a text and an array of texts; place -1 where either is null or empty of texts."""

    def told(ones: pa.Array, lists: pa.Array) -> pa.Array:
        place, score = best_of(ones.to_pylist(), lists.to_pylist(), turned)
        return pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(score, pa.float64())], ["place", "ratio"])

    return F.arrow_udf(told, "struct<place:int,ratio:double>")(one, many)


def matching_ratio(a: Column, b: Column) -> Column:
    """:func:`ratio` of two text columns; a null is an empty text."""
    return F.pandas_udf(lambda x, y: pd.Series(ratios(x.tolist(), y.tolist())), "double")(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """:func:`bound` of two text columns; a null is an empty text."""
    return F.pandas_udf(lambda x, y: pd.Series(bounds(x.tolist(), y.tolist())), "double")(a, b)
