"""Machines in pieces against the plain fold, and how many tasks one key goes through."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import machines


class Parity:
    """Forgets nothing but has two states: the running parity of the values."""

    columns = "i long, odd boolean"

    def start(self):
        return 0

    def step(self, state, row):
        state = (state + (row[1] or 0)) % 2
        return state, ((row[0], bool(state)),)

    def end(self, state):
        return ((None, bool(state)),)


class Sum:
    """Never forgets: every piece has to be run again."""

    columns = "i long, total long"

    def start(self):
        return 0

    def step(self, state, row):
        return state + row[1], ()

    def end(self, state):
        return ((None, state),)


def fold(rows, machine):
    state, out = machine.start(), []
    for row in rows:
        state, gives = machine.step(state, row)
        out += gives
    return [*out, *machine.end(state)]


@pytest.mark.parametrize("machine", [Parity(), Sum()])
@pytest.mark.parametrize("pieces", [1, 7])
def test_pieces_give_what_the_fold_gives(spark, machine, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.randint(0, 9), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v long, _piece2 string")
    got = machines.piecewise(df, ["k"], ["i"], ["i", "v"], machine, pieces).collect()
    for key in (None, 1, 2):
        want = fold([r[1:3] for r in rows if r[0] == key], machine)
        assert sorted((tuple(r)[1:] for r in got if r.k == key), key=str) == sorted(want, key=str)
    assert machines.piecewise(df.limit(0), ["k"], ["i"], ["i", "v"], machine, pieces).count() == 0


@pytest.mark.parametrize("pieces", [1, 9])
def test_scene_decisions(spark, pieces):
    rng = random.Random(4)
    rows, now = [], [0.0, 0.0]
    for i in range(700):
        if rng.random() < 0.04:
            now = [rng.choice([0.0, 5.0, 9.0]), rng.choice([0.0, 5.0])]
        frame = None if rng.random() < 0.02 else [x + rng.choice([0.0, 0.0, 0.5]) for x in now]
        rows.append((1, i, frame if rng.random() > 0.01 else []))
    machine = machines.SceneDecisions("long", 4.0, 4.0, 0.6, 1.0, 3, 6)
    df = spark.createDataFrame(rows, "k int, i long, f array<double>")
    got = [tuple(r)[1:] for r in machines.piecewise(df, ["k"], ["i"], ["i", "f"], machine, pieces).orderBy("told_at", "at").collect()]
    want = fold([r[1:] for r in rows], machine)
    assert got == want and len(want) > 10 and {r[2] for r in want} >= {"first_frame", "stabilized"}


def test_one_key_of_a_million_rows_goes_through_many_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit("one").alias("k"), F.col("id").alias("i"), (F.xxhash64("id") % 3 == 0).cast("long").alias("v"))
    out = machines.piecewise(rows, ["k"], ["i"], ["i", "v"], Parity(), 16)
    parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == 1_000_001 and len(parts) > 1 and max(r.n for r in parts) < 700_000
    odd = rows.agg(F.sum("v")).first()[0] % 2
    assert out.filter("i is null").first().odd == bool(odd)
