"""Groups under vetoes, and candidates moved to the ends of blocks, against plain Python."""

from __future__ import annotations

import random

import pytest

from evidentia.operators import graph

KINDS = ["same_slide", "same_slide", "same_slide", "different_slide", "uncertain", "transition_noise", None]


def by_hand(scenes, reviews, least):
    sure = [(min(a, b) if b is not None else a, max(a, b) if b is not None else a, a, b, d, r) for a, b, d, c, r in reviews if a is not None and c is not None and c >= least]
    dropped = {a for *_, a, _, d, _ in sure if d == "transition_noise"}
    apart = {(x, y) for x, y, _, b, d, _ in sure if d == "different_slide" and b is not None}
    edges = [(x, y, r) for x, y, _, b, d, r in sure if d == "same_slide" and b is not None and x != y and (x, y) not in apart and not {x, y} & dropped and {x, y} <= scenes]
    group = {s: s for s in scenes}
    for _ in scenes:
        for x, y, _ in edges:
            group[x] = group[y] = min(group[x], group[y])
    out = {}
    for s in scenes:
        own = sorted(t for t in scenes if group[t] == group[s])
        pairs: dict = {}
        for x, y, r in edges:
            if group[x] == group[s] and r is not None:
                pairs[x, y] = min(r, pairs.get((x, y), r))
        heads = [r for r in pairs.values() if r in own]
        at = own.index(s)
        mine = [(d, c is not None and c >= least) for a, b, d, c, _ in reviews if a is not None and s in (a, b)]
        out[s] = (min(heads) if heads else group[s], len(own), at + 1, own[at - 1] if at else None, own[at + 1] if at + 1 < len(own) else None, ("different_slide", True) in mine, s in dropped, bool(heads) and min(heads) == s, any(d == "uncertain" for d, _ in mine) and s not in dropped)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolved_groups(spark, seed):
    rng = random.Random(seed)
    scenes = set(rng.sample(range(40), 30))
    pick = lambda: rng.choice([None, *range(40), *range(40)]) if rng.random() < 0.1 else rng.randrange(40)
    reviews = [(pick(), pick(), rng.choice(KINDS), rng.choice([None, 0.2, 0.9, 0.95, 1.0]), rng.choice([None, rng.randrange(40)])) for _ in range(45)]
    df = spark.createDataFrame([(s, "x") for s in [*scenes, *scenes, None]], "s int, component string")
    got = graph.resolved_groups(df, spark.createDataFrame(reviews, "a int, b int, decision string, confidence double, representative int"), "s", 0.9).collect()
    assert {r.scene: tuple(r)[1:] for r in got} == by_hand(scenes, reviews, 0.9) and len(got) == len(scenes)


def test_no_reviews(spark):
    df = spark.createDataFrame([(3,), (1,)], "s long")
    none = spark.createDataFrame([], "a long, b long, decision string, confidence double, representative long")
    assert sorted((r.scene, r.canonical, r.group_size) for r in graph.resolved_groups(df, none, "s", 0.5).collect()) == [(1, 1, 1), (3, 3, 1)]
    assert graph.resolved_groups(df.limit(0), none, "s", 0.5).count() == 0


def test_block_boundaries(spark):
    candidates = spark.createDataFrame([(1, "same_slide_duplicate", 2, 9), (2, "same_slide_duplicate", 3, 2), (3, "same_slide_build", 3, 2), (4, None, 5, 6), (5, "same_slide_duplicate", 9, 20)], "id int, kind string, a long, b long")
    blocks = spark.createDataFrame([(2, 1, 4), (3, 1, 4), (9, 8, 11)], "scene long, start long, end long")
    assert sorted((r.id, r.left, r.right) for r in graph.block_boundaries(candidates, blocks, "id").collect()) == [(1, 4, 8), (3, 2, 3), (4, 5, 6), (5, 11, 20)]
