"""Times of stages kept in maps, and what is shown of pairs and changes, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of stages. Rolled-up totals of the first phase, single stages of the second one, its roll-up.
FIRST_PHASE = r"^P\d+ .*\btotal\b"
SECOND_PHASE = r"^V(1 |2[A-Z])"
SECOND_TOTAL = "V2 run_verifier"


def summed(times: Column, pattern: str) -> Column:
    """The sum of a map's numbers whose key matches; 0 for none. Null and not-a-number values count 0."""
    own = F.map_values(F.map_filter(times, lambda k, _: k.rlike(pattern)))
    return F.coalesce(F.aggregate(own, F.lit(0.0), lambda s, x: s + F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))), F.lit(0.0))


def stage_seconds(times: Column, runs: Column, whole: Column) -> Column:
    """``first, second, total`` seconds (three digits, null for 0) from a map of stage times.

    The second phase falls back on its roll-up. The total is that of the last of ``runs`` that isn't 0, else
    ``whole``, else both phases.
    """
    first, single = summed(times, FIRST_PHASE), summed(times, SECOND_PHASE)
    second = F.when(single != 0, single).otherwise(summed(times, f"^{SECOND_TOTAL}"))
    last = F.try_element_at(F.filter(runs, lambda x: F.coalesce(x, F.lit(0.0)) != 0), F.lit(-1))
    told = lambda c: F.nullif(F.round(c, 3), F.lit(0.0))
    return F.struct(told(first).alias("first"), told(second).alias("second"), told(F.coalesce(last, whole, first + second)).alias("total"))


def leading_types(counts: Column, order: Sequence[str]) -> Column:
    """The known types of a map of counts that aren't 0, most frequent first, ties as declared: ``type, n`` structs."""
    known = F.array(*[F.struct((-F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0))).cast("long").alias("down"), F.lit(k).alias("place"), F.lit(t).alias("type")) for k, t in enumerate(order)])
    return F.transform(F.filter(F.array_sort(known), lambda x: x["down"] < 0), lambda x: F.struct(x["type"].alias("type"), (-x["down"]).alias("n")))


def shown_files(kind: Column, files: Column, scenes: Column, middle: Column, before: Column, after: Column) -> Column:
    """The files of a candidate that a reviewer is shown.

    A build shows its two ends (``before`` and ``after`` where they are known), a transition the scenes about the
    first ``middle`` one (or the first three), a duplicate of more than three both ends and the middle one; all
    others, and lists that don't match their scenes, show every file. Empty names are left out of a build.
    """
    n = F.size(files)
    ends = F.array(F.coalesce(F.nullif(before, F.lit("")), F.get(files, F.lit(0))), F.coalesce(F.nullif(after, F.lit("")), F.get(files, n - 1)))
    ends = F.filter(F.array_distinct(F.concat(ends, files)), lambda x: F.coalesce(x, F.lit("")) != "")
    at = F.coalesce(F.array_position(scenes, F.get(middle, F.lit(0))), F.lit(0)).cast("int") - 1
    near = F.when(at >= 0, F.array(F.greatest(at - 1, F.lit(0)), at, F.least(at + 1, n - 1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    thirds = F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)
    pick = lambda places: F.transform(F.array_sort(F.array_distinct(places)), lambda i: F.get(files, i))
    shown = F.when(kind == "same_slide_build", F.slice(ends, 1, 2)).when((n <= 2) | (n != F.size(scenes)), files).when(kind == "transition_noise", pick(near))
    return shown.when((kind == "same_slide_duplicate") & (n > 3), pick(thirds)).otherwise(files)


@dataclass(frozen=True)
class ChangeLimits:
    """From where on two frames differ: mean squares, shares of changed places and hash distances."""

    cut: float
    cut_hash: int
    base: float
    base_share: float
    strong_share: float
    base_hash: int
    fade: float
    fade_hash: int


def change_reason(same: Column, previous: Column, base: Column, oldest: Column, limits: ChangeLimits) -> Column:
    """Why a frame begins a new scene, else null: ``cut``, ``structure``, ``base`` or ``fade``, in this order.

    ``previous``, ``base`` and ``oldest`` are structs ``square, share, bits`` of the differences to the frame before,
    to the scene's first one and to the oldest one that is held; null where there is none. What is the ``same``
    content never changes.
    """
    strong = (base["share"] >= limits.strong_share) & (base["bits"] >= max(4, limits.base_hash // 2))
    tests = {
        "cut": (previous["square"] >= limits.cut) & (previous["bits"] >= limits.cut_hash),
        "structure": ((base["square"] >= limits.base) & (base["share"] >= limits.base_share)) | strong,
        "base": (base["bits"] >= limits.base_hash) & (previous["square"] >= limits.cut * 0.5),
        "fade": (oldest["square"] >= limits.fade) & (oldest["bits"] >= limits.fade_hash),
    }
    differs = ~F.coalesce(same, F.lit(False))
    return F.coalesce(*[F.when(differs & F.coalesce(test, F.lit(False)), name) for name, test in tests.items()])
