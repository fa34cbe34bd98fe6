"""Conversation structure repair by least edits: a bidirectional tight-arc DAG, read off by frontier sets.

Nodes are (rows consumed, state of the grammar ``(s?(ua)+)?``); arcs are edits. Forward least costs to a node plus an
arc's cost plus backward least costs from its end tell the arcs that lie on some cheapest repair. The set of nodes
that the letters so far lead to then takes, step by step, the least letter of its tight arcs.

No conversation has to fit in one task. Rows are range-sorted and cut into pieces; a piece is four by four least
costs, so one scan of these gives each piece its forward and backward costs, and a piece's tight arcs map any set of
states at its start to one at its end, so a second scan gives each piece its frontier. Only the digest of the
repaired texts, which SHA-256 takes in order, streams through one task for each conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.sources.session import stored

#: Rows of a piece at most.
PIECE = 1 << 14
_FAR = 1 << 40
#: States: nothing yet, after s, after u, after a. A repair ends in the first or the last.
_START, _S, _U, _A = range(4)
_ENDS = (_START, _A)
_KEEP, _REROLE, _DELETE, _INSERT = 0, 2, 3, 2
#: A row's code: its role's place in "suao" (o: any other), 4 if truncated, 8 if it must go.
_ROLES = "suao"
_MUST_GO, _TRUNCATED = 8, 4

_BLANK = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: conversations after the damage that CRC-32 deals to a fifth of the rows.

    ``n`` is how often a row stands there, one after another: 0 (dropped), 1 or 2. A null counts as one space, but
    for the turn's place and the id.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, n, code, blank, seen``: one row for rows alike in all, without their texts.

    ``seen`` tells that role and text stand in an earlier turn; of ``n`` rows alike all but the first are seen too.
    """
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    first = F.substring("role", 1, 1)
    rows = _digested(rows.filter("n > 0")).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "n",
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?") & (bare != "")).alias("cut"),
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("code"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.first("code").alias("code"))
    least = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), least.alias("turn"))).alias("f"), F.count("*").alias("m")).filter("m > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "f")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    rows = rows.join(firsts, on, "left")
    seen = F.coalesce((F.col("f.told") != F.col("turn").isNotNull()) | (F.col("f.turn") != least), F.lit(False))
    return rows.select("conv_id", "turn", "role", "digest", "n", "blank", seen.alias("seen"), (F.col("code") + F.when(F.col("cut"), _TRUNCATED).otherwise(0)).alias("code"))


def inserted(v: list[int]) -> list[int]:
    """Least costs after any inserts at a place, from those before."""
    none, s, u, a = v
    after = min(none, s, a) + _INSERT
    return [none, s, min(u, after), min(a, u + _INSERT, after + _INSERT)]


def consumed(v: list[int], code: int) -> list[int]:
    """Least costs after a row's own edit, from those before."""
    none, s, u, a = v
    if code & _MUST_GO:
        return [none + _DELETE, s + _DELETE, u + _DELETE, a + _DELETE]
    role, more = code & 3, 1 if code & _TRUNCATED else 0
    kept = [more + (_KEEP if role == k else _REROLE) for k in range(3)]
    return [none + _DELETE, min(s + _DELETE, none + kept[0] if role == 0 else _FAR), min(u + _DELETE, min(none, s, a) + kept[1]), min(a + _DELETE, u + kept[2])]


def arcs(state: int, code: int | None) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits at a node; ``code`` is the next row's, if there is one."""
    out = [("I", _INSERT, _U if state != _U else _A)]
    if code is None:
        return out
    out.append(("D", _DELETE, state))
    if not code & _MUST_GO:
        role, more = code & 3, 1 if code & _TRUNCATED else 0
        goal = _U if state != _U else _A
        if role == goal - 1:
            out.append(("K", _KEEP + more, goal))
        else:
            out.append(("R", _REROLE + more, goal))
        if state == _START and role == 0:
            out.append(("K", _KEEP + more, _S))
    return out


def costs(codes: bytes) -> list[int]:
    """Sixteen least costs of a piece: from each state before it to each state after its last row."""
    out = []
    for start in range(4):
        v = [_FAR] * 4
        v[start] = 0
        for code in codes:
            v = consumed(inserted(v), code)
        out += v
    return [min(x, _FAR) for x in out]


def _through(v: list[int], matrix: list[int]) -> list[int]:
    return [min(_FAR, *(v[p] + matrix[4 * p + q] for p in range(4))) for q in range(4)]


def _back(matrix: list[int], v: list[int]) -> list[int]:
    return [min(_FAR, *(matrix[4 * p + q] + v[q] for q in range(4))) for p in range(4)]


def _closed(v: list[int]) -> list[int]:
    """Least costs to the end before any inserts at a place, from those after."""
    none, s, u, a = v
    first, second = min(u, a + _INSERT), min(a, u + _INSERT)
    return [min(none, first + _INSERT), min(s, first + _INSERT), min(u, second + _INSERT), min(a, first + _INSERT)]


#: Least costs to the end where no row is left.
LAST = _closed([0 if q in _ENDS else _FAR for q in range(4)])


class Tight:
    """A piece's tight arcs, from the costs that lead to it and the costs that are left after it."""

    def __init__(self, codes: bytes, forward: list[int], back: list[int], last: bool) -> None:
        self.codes, self.last = codes, last
        self.back = [back]
        for code in reversed(codes):
            self.back.append(_closed(self._before(code, self.back[-1])))
        self.back.reverse()
        self.total = min(f + b for f, b in zip(forward, self.back[0], strict=True))
        self.forward = [inserted(forward)]
        for code in codes:
            self.forward.append(inserted(consumed(self.forward[-1], code)))

    @staticmethod
    def _before(code: int, after: list[int]) -> list[int]:
        return [min(w + after[q] for letter, w, q in arcs(p, code) if letter != "I") for p in range(4)]

    def walk(self, frontier: frozenset[int]) -> tuple[str, frozenset[int]]:
        """The least letters from a set of states to the piece's end (past its last inserts, if no row follows)."""
        out, at, n = [], 0, len(self.codes)
        while True:
            if at == n and not self.last:
                return "".join(out), frontier
            f, code = self.forward[at], self.codes[at] if at < n else None
            if code is None and any(q in _ENDS and f[q] == self.total for q in frontier):
                return "".join(out), frontier
            steps: dict[str, set[int]] = {}
            for p in frontier:
                for letter, w, q in arcs(p, code):
                    if f[p] + w + self.back[at if letter == "I" else at + 1][q] == self.total:
                        steps.setdefault(letter, set()).add(q)
            if not steps:
                return "", frozenset()
            letter = min(steps)
            out.append(letter)
            frontier = frozenset(steps[letter])
            at += letter != "I"


def _streamed(rows: DataFrame, keys: list[Column], rule: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``rule`` over the rows of whole conversations, sorted within partitions; a task holds a batch and the rule's state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        return _batched(rule(tuples()), arrow)

    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *keys).mapInArrow(scan, schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if weight > size:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds: dict[str, Any] = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in text.split(", "))])


_PIECE = "conv_id long, part long, seq long, turn long, role string, digest binary, codes binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_SCAN = "conv_id long, part long, seq long, forward array<long>, back array<long>, final int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_LEGAL = {"su", "ua", "au"}


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """Range-sorted rows as pieces of one conversation and at most ``most`` rows, in order of ``part`` and ``seq``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def told(key: Any, seq: int, own: list[tuple]) -> tuple:
            codes, counts, illegal, before = bytearray(), [0, 0, 0], 0, None
            turns = [x[0] for x in own if x[0] is not None]
            for turn, role, _, copies, blank, seen, code in own:
                for copy in range(copies):
                    again = seen or copy > 0
                    counts[0 if blank else 1 if again else 2] += 1 if blank or again or code & _TRUNCATED else 0
                    codes.append(code & 3 | _MUST_GO if blank or again else code)
                    illegal += before is not None and before + role[:1] not in _LEGAL
                    before = role[:1]
            return (key, part, seq, *own[0][:3], bytes(codes), costs(bytes(codes)), *counts, illegal, own[0][1][:1], before, min(turns, default=None), max(turns, default=None), len(set(turns)))

        def run() -> Iterator[tuple]:
            own, size, key, seq = [], 0, None, 0
            for batch in batches:
                for conv, turn, role, digest, n, blank, seen, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    while n:
                        if own and (conv != key or size >= most):
                            yield told(key, seq, own)
                            own, size, seq = [], 0, seq + 1
                        key, take = conv, min(n, most - size)
                        own.append((turn, role, digest, take, blank, seen, code))
                        # Of rows alike that two pieces share, those of the second are copies.
                        size, n, seen = size + take, n - take, True
            if own:
                yield told(key, seq, own)

        return _batched(run(), _schema(_PIECE))

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "digest", "n", "blank", "seen", "code").mapInArrow(cut, _PIECE)


def _scanned(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each piece's costs from the start and to the end, and on a conversation's first piece its counts."""

    def told(key: Any, own: list[tuple]) -> Iterator[tuple]:
        forward, back = [[0, _FAR, _FAR, _FAR]], [LAST]
        for x in own:
            forward.append(_through(forward[-1], x[2]))
        for x in reversed(own):
            back.append(_back(x[2], back[-1]))
        back.reverse()
        lows, highs = [x[9] for x in own if x[9] is not None], [x[10] for x in own if x[10] is not None]
        illegal = sum(x[6] for x in own) + sum(a[8] + b[7] not in _LEGAL for a, b in zip(own, own[1:]))
        turns = sum(x[11] for x in own) - sum(a == b for a, b in zip(highs, lows[1:]))
        gaps = highs[-1] - lows[0] + 1 - turns if lows else 0
        counts = [gaps, *(sum(x[k] for x in own) for k in (3, 4, 5)), illegal, back[0][_START]]
        for k, x in enumerate(own):
            yield (key, x[0], x[1], forward[k], back[k + 1], int(k == len(own) - 1), *(counts if k == 0 else [None] * 6))

    key, own = None, []
    for conv, *x in rows:
        if own and conv != key:
            yield from told(key, own)
            own = []
        key = conv
        own.append(x)
    if own:
        yield from told(key, own)


_SETS = [frozenset(q for q in range(4) if m >> q & 1) for m in range(16)]


def _mask(states: frozenset[int]) -> int:
    return sum(1 << q for q in states)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the set of states at its end, for each set at its start."""

    def run() -> Iterator[tuple]:
        for batch in batches:
            for conv, part, seq, codes, forward, back, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # What follows a conversation's last piece needs no frontier.
                tight = None if final else Tight(codes, forward, back, False)
                yield conv, part, seq, bytes(_mask(tight.walk(s)[1]) if tight and s else 0 for s in _SETS)

    return _batched(run(), _schema("conv_id long, part long, seq long, exits binary"))


def _entered(rows: Iterator[tuple]) -> Iterator[tuple]:
    key, at = None, None
    for conv, part, seq, exits in rows:
        if at is None or conv != key:
            key, at = conv, 1 << _START
        yield conv, part, seq, at
        at = exits[at]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        for batch in batches:
            for conv, part, seq, codes, forward, back, final, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield conv, part, seq, Tight(codes, forward, back, bool(final)).walk(_SETS[at])[0]

    return _batched(run(), _schema("conv_id long, part long, seq long, letters string"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """A join of pieces; a null conversation is one as well."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "part", "seq")})
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).drop("_conv_id", "_part", "_seq")


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _written(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversations from their pieces' letters, each before its first row, and their rows' texts."""
    key: Any = None
    counts, letters, todo, at, parity, digest = None, None, "", 0, 0, hashlib.sha256()

    def put(role: str, text: str) -> None:
        nonlocal parity
        digest.update((b"\n" if parity else b"") + role.encode() + b":" + text.encode())
        parity = 2 if role[:1] == "u" else 1 if role[:1] == "a" else 3

    def inserts() -> None:
        nonlocal at
        while at < len(todo) and todo[at] == "I":
            put("assistant" if parity == 2 else "user", "")
            at += 1

    def told() -> tuple:
        return (key, *(counts or [0] * 6), "".join(letters), digest.hexdigest())

    for conv, kind, role, text, n, more, *own in rows:
        if letters is None or conv != key:
            if letters is not None:
                inserts()
                yield told()
            key, counts, letters, todo, at, parity, digest = conv, None, [], "", 0, 0, hashlib.sha256()
        if kind == 0:
            letters.append(more)
            todo, at = todo[at:] + more, 0
            counts = own if own[0] is not None else counts
            continue
        for _ in range(n):
            inserts()
            letter = todo[at]
            at += 1
            if letter == "K":
                put(role, text)
            elif letter == "R":
                put("assistant" if parity == 2 else "user", text)
    if letters is not None:
        inserts()
        yield told()


def repaired(conversations: DataFrame, most: int = PIECE) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows go by turn (nulls
    first), rows of one turn by role and by their text's SHA-256. A role counts by its first character; one that
    doesn't begin with s, u or a can't be kept. Null ids are one conversation; null roles and texts are one space,
    so a null text is blank. Conversations that lose all rows to the damage have zeros, no audit and the digest of
    nothing. Repeated rows are duplicates; an empty table gives no rows; other columns don't matter.
    """
    rows = damaged(conversations)
    cut = stored(pieces(_coded(rows), most))
    order = [F.col("part"), F.col("seq")]
    scan = cut.select("conv_id", "part", "seq", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
    scan = stored(_streamed(scan, order, _scanned, _SCAN, _schema(_SCAN)))
    ready = _joined(cut.select("conv_id", "part", "seq", "codes"), scan.select("conv_id", "part", "seq", "forward", "back", "final"))
    ready = stored(ready.select("conv_id", "part", "seq", "codes", "forward", "back", "final"))
    exits = ready.mapInArrow(_exits, "conv_id long, part long, seq long, exits binary")
    entry = "conv_id long, part long, seq long, entry int"
    entered = _streamed(exits, order, _entered, entry, _schema(entry))
    letters = _joined(ready, entered).select("conv_id", "part", "seq", "codes", "forward", "back", "final", "entry")
    letters = letters.mapInArrow(_letters, "conv_id long, part long, seq long, letters string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = _joined(_joined(cut.select("conv_id", "part", "seq", "turn", "role", "digest"), letters), scan.select("conv_id", "part", "seq", *counts))
    heads = heads.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), F.col("part").alias("part"), F.col("seq").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "letters", *counts)
    texts = _digested(rows).select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), "text", "n", F.lit(None).cast("string").alias("letters"), *[F.lit(None).cast("long").alias(c) for c in counts])
    both = heads.unionByName(texts)
    own = ("conv_id", "turn", "role", "digest")
    both = both.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*own, "kind", "part", "seq")])
    both = both.select("conv_id", "kind", "role", "text", "n", "letters", *counts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        return _batched(_written(tuples()), _schema(_OUT))

    return both.mapInArrow(write, _OUT)
