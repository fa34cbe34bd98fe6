"""Sequential rules over each key's rows in order: what depends on the rule's own last decision, so no window can say it."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that a rule's results are gathered in.
OUT_ROWS = 10_000


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], rule: Callable[[Iterator[tuple]], Iterable[tuple]], columns: str) -> DataFrame:
    """``keys`` with the ``columns`` (as DDL) of what ``rule`` yields for the tuples of ``fields`` of each key's rows, in order.

    Rows are dealt by key and sorted by Spark, which spills. A task reads its Arrow batches one after another and hands
    each key's rows on as an iterator: it holds one batch and what the rule itself keeps, however many rows a key has.
    Null keys are one key, null orders come last, an empty table gives no rows. A rule must read its rows to the end.
    """
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(columns)])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        made = ((*key, *out) for key, own in groupby(every, key=lambda r: r[:n]) for out in rule(r[n:] for r in own))
        while part := list(islice(made, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    dealt = rows.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*keys, *order)])
    return dealt.mapInArrow(run, schema)


def ddl(rows: DataFrame, names: Sequence[str]) -> str:
    """The named columns as DDL."""
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def limited_contexts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cut: str, natural: str, soft: int, hard: int, ahead: int) -> DataFrame:
    """``context`` of each row. A context ends after a row with ``cut``, and from ``soft`` rows on after one with ``natural``.

    At ``hard`` rows it ends, unless one of the next ``ahead`` rows (not the key's last) may end it: then it goes on to that.
    Nulls don't end a context.
    """

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        held = deque(islice(own, ahead + 1))
        nr, size, waiting = 0, 0, False
        held.extend(islice(own, 1))
        while held:
            *place, cuts, may = held.popleft()
            held.extend(islice(own, 1))
            size += 1
            ends = bool(cuts) or (bool(may) and size >= soft)
            if not ends and not waiting and size >= max(soft, hard):
                waiting = any(c or m for *_, c, m in islice(held, max(0, min(ahead, len(held) - 1))))
                ends = not waiting
            yield (*place, nr)
            if ends:
                nr, size, waiting = nr + 1, 0, False

    return folded(rows, keys, order, [*order, cut, natural], rule, f"{ddl(rows, order)}, context long")


def carried_batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, images: str, alone: str, most_images: int, most_items: int, carry: int) -> DataFrame:
    """Items packed in order into batches ``batch, items, images``; each begins with the last ``carry`` images of the one before.

    An item joins while the batch's distinct images and items stay within their limits; one with ``alone`` is a batch of
    its own, which carries nothing on. Items without images are in no batch.
    """
    kind = rows.schema[item].dataType.simpleString()

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        nr, items, seen = 0, [], []
        for *_, name, asked, single in own:
            asked = list(dict.fromkeys(x for x in asked or [] if x))
            if not asked:
                continue
            fresh = [x for x in asked if x not in seen]
            full = len(items) >= most_items or len(seen) + len(fresh) > most_images
            if items and (single or full):
                yield nr, items, seen
                nr, items, seen = nr + 1, [], [] if single else seen[len(seen) - min(carry, len(seen)) :]
            if single:
                yield nr, [name], asked
                nr, items, seen = nr + 1, [], []
                continue
            items = [*items, name]
            seen = [*seen, *(x for x in asked if x not in seen)]
        if items:
            yield nr, items, seen

    return folded(rows, keys, order, [*order, item, images, alone], rule, f"batch long, items array<{kind}>, images array<string>")


def _overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """Intersection over union of two boxes ``x1, y1, x2, y2``."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, wide) * max(0.0, high)
    either = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / either if either > 0 else 0.0


def tracked_boxes(rows: DataFrame, keys: Sequence[str], frame: str, box: str, moved: str, least_overlap: float, least_shift: float, least_growth: float, most_missing: int) -> DataFrame:
    """Each box (``array<double>``) with its ``track`` and whether that is ``kept``: it has been seen to move.

    A box goes to the track whose last box it overlaps most, the older on ties, else begins one; tracks unseen for more
    than ``most_missing`` frames end. A track is kept from the box on whose centre is ``least_shift`` or whose area is
    ``least_growth`` of the area away from its first, or which ``moved`` marks (motion of its pixels, told elsewhere).
    """

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        live: list[dict] = []
        made = 0
        for at, b, motion in own:
            live = [t for t in live if at - t["at"] <= most_missing]
            score, best = max(((_overlap(b, t["last"]), -k) for k, t in enumerate(live)), default=(0.0, 0))
            if score <= 0 or score < least_overlap:
                live.append({"nr": made, "first": b, "last": b, "at": at, "kept": False})
                made += 1
                yield at, b, made - 1, False
                continue
            track = live[-best]
            f = track["first"]
            shift = max(abs(b[0] + b[2] - f[0] - f[2]), abs(b[1] + b[3] - f[1] - f[3])) / 2
            size, before = (max(1.0, (x[2] - x[0]) * (x[3] - x[1])) for x in (b, f))
            track["kept"] = track["kept"] or shift >= least_shift or abs(size - before) / before >= least_growth or bool(motion)
            track.update(last=b, at=at)
            yield at, b, track["nr"], track["kept"]

    return folded(rows, keys, [frame, box], [frame, box, moved], rule, f"{ddl(rows, [frame, box])}, track long, kept boolean")


def _changed(a: np.ndarray, b: np.ndarray, step: float) -> float:
    """The share of places at which two frames differ by more than ``step``."""
    return float(np.mean(np.abs(a - b) > step)) if a.size else 0.0


def captures(rows: DataFrame, keys: Sequence[str], at: str, frame: str, step: float, begins: float, active: float, rejects: float, stable: int, least: int, gap: int, distinct: float) -> DataFrame:
    """Captures of writing on frames (``array<double>``): ``at`` of the frame taken and ``told_at`` when that was decided.

    Writing begins where ``begins`` of the places differ from the base by more than ``step``. Once ``stable`` frames in a
    row differ from the one before by less than ``active``, after ``least`` frames of writing and ``gap`` frames since the
    last capture, the last active frame is taken and the present one is the new base. Writing that vanishes gives its
    frame of most change if it lasted ``least`` frames; a change of ``rejects`` or more drops what was under way. A
    capture that differs from the last in less than ``distinct`` of the places is left out. The end takes what is open.
    """

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        base = before = told = last = peak = None
        writing = quiet = 0
        since = gap
        for place, values in own:
            now = np.asarray(values, float)
            if base is None:
                base = before = now
                continue
            far, near = _changed(base, now, step), _changed(before, now, step)
            before, since, taken = now, since + 1, None
            if far >= rejects:
                writing, quiet, last, peak = 0, 0, None, None
            elif far < begins:
                taken = peak[:2] if writing >= least and peak else None
                writing, quiet, last, peak = 0, 0, None, None
            elif not writing:
                writing, quiet, last, peak = 1, 0, (place, now, far), (place, now, far)
            else:
                writing += 1
                quiet = 0 if near >= active else quiet + 1
                if not quiet:
                    last = (place, now, far)
                    peak = last if far > peak[2] else peak
                if quiet >= stable and writing >= least and since >= gap:
                    taken, base = last[:2], now
                    writing, quiet, since, last, peak = 0, 0, 0, None, None
            if taken and (told is None or _changed(told, taken[1], step) >= distinct):
                told = taken[1]
                yield taken[0], place
        if writing >= least and last and (told is None or _changed(told, last[1], step) >= distinct):
            yield last[0], last[0]

    kind = rows.schema[at].dataType.simpleString()
    return folded(rows, keys, [at], [at, frame], rule, f"at {kind}, told_at {kind}")


def scene_changes(rows: DataFrame, keys: Sequence[str], at: str, frame: str, cut: float, base: float, fade: float, back: int, hold: int) -> DataFrame:
    """Changes of scene over frames (``array<double>``) by mean squared difference: ``at`` and the first reason that holds.

    ``cut`` against the frame before, ``base`` against the scene's first frame, ``fade`` against the one ``back`` frames
    ago. A change counts once ``hold`` further frames still are ``base`` away from the old scene; else it is forgotten.
    The frame that it counts at begins the new scene; a change still pending at the end is none.
    """

    def rule(own: Iterator[tuple]) -> Iterator[tuple]:
        start = pending = None
        recent: deque = deque(maxlen=back)
        gap = lambda a, b: float(np.mean((a - b) ** 2)) if a.size else 0.0
        for place, values in own:
            now = np.asarray(values, float)
            start = now if start is None else start
            away = gap(start, now)
            if pending is not None:
                pending = (*pending[:2], pending[2] + 1) if away >= base else None
            elif recent:
                tests = (("cut", gap(recent[-1], now) >= cut), ("base", away >= base), ("fade", len(recent) == back and gap(recent[0], now) >= fade))
                reason = next((name for name, holds in tests if holds), None)
                pending = (place, reason, 0) if reason else None
            recent.append(now)
            if pending is not None and pending[2] >= hold:
                yield pending[:2]
                start, pending = now, None
                recent.clear()
                recent.append(now)

    return folded(rows, keys, [at], [at, frame], rule, f"at {rows.schema[at].dataType.simpleString()}, reason string")
