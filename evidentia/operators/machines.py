"""State machines over one key's rows in many tasks: pieces are summed up as transitions, and a scan joins these.

A machine takes rows in order and carries a state on. Its rows are range-sorted and dealt in pieces, so a key with
very many rows goes through many tasks. Each piece is run from the state that it would have if nothing had come before;
what it ends in is proposed to the piece after it as a further state to begin with, and so on until no piece is asked
for a beginning that it hasn't been run from. Then one scan over the transitions of a key's pieces tells where each
really begins, and the pieces are run once more, all at the same time, for what they give. The result is that of the
plain fold. A machine that forgets (a new scene begins with its own frame) or has few states needs two or three rounds;
one that never forgets needs a round a piece, as many steps as the fold itself.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidentia.operators.folds import OUT_ROWS, folded
from evidentia.sources.session import checkpointed, stored


class Machine(Protocol):
    """What to run. States are None, numbers, strings, bytes and tuples of these, and say nothing of how much came before."""

    #: What a step and the end give, as DDL.
    columns: str

    def start(self) -> Any:
        """The state before a key's first row."""

    def step(self, state: Any, row: tuple) -> tuple[Any, Iterable[tuple]]:
        """The state after a row, and what the row gives."""

    def end(self, state: Any) -> Iterable[tuple]:
        """What is left to give after a key's last row."""


def _packed(state: Any) -> bytes:
    # This version of the format has no references, so equal states are equal bytes.
    return marshal.dumps(state, 2)


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` and the other columns of ``right`` where all ``names`` are the same, nulls too."""
    right = right.withColumnsRenamed({c: f"_same_{c}" for c in names})
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(right, same, how).drop(*[f"_same_{c}" for c in names])


def _through(pieces: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], machine: Machine, final: bool) -> DataFrame:
    """Each wanted piece run from its ``entry``: what it gives if ``final``, else ``keys, piece, entry, exit``."""
    n, own = len(keys), (*keys, "_piece")
    rows = _joined(pieces, wanted, own)
    asked = [*own, "_entry", "_last", *fields]
    rows = rows.select(*asked, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]).repartition(*own)
    rows = rows.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*own, "_entry")], *[F.col(f"_o{k}").asc_nulls_last() for k in range(len(order))]).select(*asked)
    summary = "_piece int, _entry binary, _exit binary"
    schema = StructType([*(pieces.schema[k] for k in keys), *StructType.fromDDL(machine.columns if final else summary)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))

        def made() -> Iterator[tuple]:
            for (*key, piece, entry, last), mine in groupby(every, key=lambda r: r[: n + 3]):
                state = marshal.loads(entry)
                for row in mine:
                    state, gives = machine.step(state, row[n + 3 :])
                    if final:
                        for out in gives:
                            yield (*key, *out)
                if not final:
                    yield (*key, piece, entry, _packed(state))
                elif last:
                    for out in machine.end(state):
                        yield (*key, *out)

        rows = made()
        while part := list(islice(rows, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def piecewise(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], machine: Machine, pieces: int | None = None) -> DataFrame:
    """``keys`` and the machine's columns of what it gives for the tuples of ``fields`` of each key's rows, in order.

    ``pieces`` is the number of ranges that all rows are sorted into, by default the session's shuffle partitions. Null
    keys are one key, null orders come last; rows that tie in ``order`` should be alike in ``fields``. An empty table
    gives no rows.
    """
    asked = list(dict.fromkeys([*keys, *order, *fields]))
    place = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    cut = rows.select(*asked).repartitionByRange(*([pieces] if pieces else []), *place)
    cut = stored(cut.withColumn("_piece", F.spark_partition_id()))
    start = _packed(machine.start())
    new = checkpointed(cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n")).select(*keys, "_piece", F.lit(start).alias("_entry"), F.lit(False).alias("_last")))
    after = _followers(new, keys)
    known = None
    while not new.isEmpty():
        told = checkpointed(_through(cut, new, keys, order, fields, machine, final=False))
        known = told if known is None else checkpointed(known.unionByName(told))
        asks = _joined(told, after, [*keys, "_piece"]).select(*keys, F.col("_next").alias("_piece"), F.col("_exit").alias("_entry")).distinct()
        names = [*keys, "_piece", "_entry"]
        new = checkpointed(_joined(asks, known.select(*names), names, "left_anti").withColumn("_last", F.lit(False)))
    if known is None:
        return _through(cut, new, keys, order, fields, machine, final=True)

    def scan(own: Iterator[tuple]) -> Iterator[tuple]:
        state, ready = start, None
        for piece, mine in groupby(own, key=lambda r: r[0]):
            if ready is not None:
                yield (*ready, False)
            ready = piece, state
            state = {entry: left for _, entry, left in mine}[state]
        yield (*ready, True)

    begins = folded(known, keys, ["_piece", "_entry"], ["_piece", "_entry", "_exit"], scan, "_piece int, _entry binary, _last boolean")
    return _through(cut, checkpointed(begins), keys, order, fields, machine, final=True)


def _followers(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _piece, _next``: the piece after each one of a key; a row for each piece."""
    return pieces.select(*keys, "_piece", F.lead("_piece").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_next")).filter("_next is not null")


class SceneDecisions:
    """Bases of scenes on frames (``at, array<double>``): ``at, told_at, reason``.

    The first frame is a base. A frame that is ``cut`` away from the one before (by mean squared difference), or
    ``base`` away from its scene's base, opens a candidate. While the frames stay within ``still`` of the candidate it
    ripens; else the present frame is the candidate from now on. After ``ripe`` frames in a row, or ``most`` in all, it is
    decided: a candidate less than ``same`` away from the base is dropped, any other is the new base, at the place where
    the change was first seen. The next frame is then held against the base. A candidate still open at the end is
    dropped. A null frame changes nothing.
    """

    def __init__(self, at: str, cut: float, base: float, still: float, same: float, ripe: int, most: int) -> None:
        self.columns = f"at {at}, told_at {at}, reason string"
        self.cut, self.base, self.still, self.same, self.ripe, self.most = cut, base, still, same, ripe, most

    def start(self) -> Any:
        return None

    @staticmethod
    def _away(a: bytes, b: bytes) -> float:
        one, two = np.frombuffer(a), np.frombuffer(b)
        return float(np.mean((one - two) ** 2)) if len(one) and len(one) == len(two) else float(len(one) != len(two)) * 1e300

    def step(self, state: Any, row: tuple) -> tuple[Any, Iterable[tuple]]:
        at, values = row
        if values is None:
            return state, ()
        now = np.asarray(values, np.float64).tobytes()
        if state is None:
            return (now, now, None), ((at, at, "first_frame"),)
        base, before, pending = state
        if pending is None:
            if self._away(before, now) >= self.cut or self._away(base, now) >= self.base:
                return (base, now, (at, now, 1, 1)), ()
            return (base, now, None), ()
        begun, candidate, ripe, seen = pending
        candidate, ripe = (candidate, ripe + 1) if self._away(candidate, now) <= self.still else (now, 1)
        if ripe < self.ripe and seen + 1 < self.most:
            return (base, before, (begun, candidate, ripe, seen + 1)), ()
        if self._away(base, candidate) < self.same:
            return (base, base, None), ()
        return (candidate, candidate, None), ((begun, at, "stabilized" if ripe >= self.ripe else "timeout"),)

    def end(self, state: Any) -> Iterable[tuple]:
        return ()
