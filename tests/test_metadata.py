"""The metadata of captures against plain Python, on random and on hard recordings."""

from __future__ import annotations

import random

from evidentia.operators import metadata

KEYS = ["rec"]


def frames(spark, rows, ddl):
    return spark.createDataFrame(list(rows), ddl)


def test_samples_of_the_nearest_frame(spark):
    rng = random.Random(2)
    marks = [(rng.choice([1, 2]), rng.choice([None, *range(1, 60)]), rng.randint(1, 99), "x") for _ in range(40)]
    rows = [(rng.choice([1, 2, 3]), k, rng.choice([None, 0, -1, *range(1, 70)]), rng.choice([None, 0, 7])) for k in range(80)]
    got = metadata.attached_samples(frames(spark, rows, "rec int, id int, frame int, sample int"), frames(spark, marks, "rec int, frame int, sample int, other string").drop("other"), KEYS, "frame", "sample").collect()
    assert len(got) == len(rows)
    for r in got:
        rec, _, frame, sample = rows[r.id]
        known = {f: max(s for c, g, s, _ in marks if c == rec and g == f) for c, f, _, _ in marks if c == rec and f is not None}
        want, inferred = sample, False
        if (sample or 0) <= 0 and frame and frame > 0 and known:
            want, inferred = known[min(known, key=lambda f: (abs(f - frame), -f))], True
        assert (r.sample, r.inferred) == (want, inferred)


def test_samples_of_one_long_recording(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("1 rec", "id", "cast(id * 3 + 1 as int) frame", "cast(if(id % 10 = 0, id + 1, null) as int) sample")
    told = metadata.attached_samples(rows, rows.filter("sample is not null").select("rec", "frame", "sample"), KEYS, "frame", "sample")
    plan = told._jdf.queryExecution().toString().lower()
    assert "unboundedfollowing" not in plan, "a window to the end is told anew at each row"
    got = {r.id: (r.sample, r.inferred) for r in told.collect()}
    last = (n - 1) // 10 * 10
    assert got == {k: (min((k + 5) // 10 * 10, last) + 1, k % 10 != 0) for k in range(n)}


def by_hand(scenes, videos, notes, duration, canonical):
    units = sorted([(t, 0, i, f, None) for i, t, f in scenes] + [(a, 1, i, max(1, round((x + y) / 2)), b) for i, a, b, x, y in videos])
    number, start, end = {}, {}, {}
    for k, (t, kind, i, _, until) in enumerate(units, 1):
        start[k] = round(t, 3)
        end[k] = round(until if kind else units[k][0] if k < len(units) else duration, 3)
        if not kind:
            number[i] = k
    bases = [(number[i], 0, "base", t) for i, t, _ in scenes]
    written = [(number.get(i, i), a, "annotation", t) for i, a, t, _ in notes]
    rows = bases + written
    shown = sorted({r[0] for r in rows})
    first = {s: min(r[3] for r in rows if r[0] == s) for s in shown}
    slide = {s: canonical.get(s, s) for s in shown}
    seen = sorted(shown, key=lambda s: (start.get(s, round(first[s], 3)), s))
    numbers = {c: k for k, c in enumerate(dict.fromkeys(slide[s] for s in seen), 1)}
    out, upto = [], {}
    for s in sorted(shown, key=lambda s: (first[s], s)):
        own = sorted(r for r in written if r[0] == s)
        for k, (_, a, _, t) in enumerate(own, 1):
            out.append((s, f"scene_{s:03d}_annot_{a:02d}.jpg", numbers[slide[s]], upto.get(slide[s], 0) + k, len(own), start.get(s, round(t, 3)), end.get(s, round(t, 3))))
        if any(r[0] == s for r in bases):
            out.append((s, f"scene_{s:03d}_base.jpg", numbers[slide[s]], 0, len(own), start[s], end[s]))
        upto[slide[s]] = upto.get(slide[s], 0) + len(own)
    return sorted(out)


def test_captures_by_hand(spark):
    rng = random.Random(9)
    every, want = ([], [], [], []), {}
    for rec in range(12):
        times = sorted(rng.sample(range(1000), 14))
        scenes = [(k + 1, float(t), t * 3) for k, t in enumerate(times[: rng.randint(0, 9)])]
        videos = [(k + 1, float(t), float(t + rng.randint(0, 40)), int(t) * 3, int(t) * 3 + rng.randint(0, 99)) for k, t in enumerate(sorted([*times[10:12], *([scenes[0][1]] if scenes and rec % 2 else [])]))]
        notes = [(i, a, t + a, 5) for i, t, _ in scenes for a in range(1, rng.randint(1, 4))]
        canonical = {k: rng.randint(1, k) for k in range(1, 14) if rng.random() < 0.4}
        want[rec] = by_hand(scenes, videos, notes, 2000.0, canonical)
        every[0].extend((rec, *s) for s in scenes)
        every[1].extend((rec, *v) for v in videos)
        every[2].extend((rec, *n) for n in notes)
        every[3].extend((rec, k, c) for k, c in canonical.items())
    scenes = frames(spark, every[0], "rec int, scene_index long, timestamp_sec double, frame_no long")
    videos = frames(spark, every[1], "rec int, segment_index long, start_sec double, end_sec double, start_frame_no long, end_frame_no long")
    notes = frames(spark, every[2], "rec int, scene_index long, annot_index int, timestamp_sec double, frame_no long")
    durations = frames(spark, [(k, 2000.0) for k in range(12)], "rec int, duration_sec double")
    units = metadata.timeline_units(scenes, videos, durations, KEYS)
    rows = metadata.capture_records(units, notes, KEYS)
    rows = rows.join(frames(spark, every[3], "rec int, scene_index long, canonical long"), ["rec", "scene_index"], "left")
    final = metadata.finalized(rows, KEYS, "canonical")
    got = [(r.rec, (r.scene_index, r.filename, r.slide_number, r.slide_annot_index, r.scene_annotations, r.scene_start_sec, r.scene_end_sec)) for r in final.collect()]
    assert {k: sorted(x for c, x in got if c == k) for k in want} == want
    assert metadata.video_records(units, KEYS).count() == len(every[1])
    assert metadata.scene_slide_map(final, KEYS).count() == len({(k, x[0]) for k, v in want.items() for x in v})
    none = scenes.limit(0)
    assert metadata.finalized(metadata.capture_records(metadata.timeline_units(none, videos.limit(0), durations, KEYS), notes.limit(0), KEYS).withColumn("canonical", metadata.F.lit(1)), KEYS, "canonical").count() == 0


def test_renumbered_everywhere(spark):
    rows = frames(spark, [(1, 3, [1, 3, 9], 9), (1, 7, [7, 3], None), (2, 5, None, 5), (None, 4, [4], 4)], "rec int, scene long, near array<long>, canonical long")
    numbers = metadata.dense_numbers(rows, KEYS, "scene")
    assert sorted((r.rec or 0, r.old, r.new) for r in numbers.collect()) == [(0, 4, 1), (1, 3, 1), (1, 7, 2), (2, 5, 1)]
    out = rows
    for column, drop in (("near", True), ("canonical", False), ("scene", True)):
        out = metadata.renumbered(out, numbers, KEYS, column, "old", "new", drop)
    assert sorted((r.rec, r.scene, r.near, r.canonical) for r in out.collect()) == [(1, 1, [1], None), (1, 2, [1, 2], None), (2, 1, None, 1)]
