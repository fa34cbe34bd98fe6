"""Numeric functions as Column expressions. Rounding is Spark's: half up on the decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column, default: float = 0.0) -> Column:
    """A finite double or the default."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def clamp01(c: Column, default: float = 0.0) -> Column:
    """Into [0, 1], rounded to six digits; what isn't a finite number is the default."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), safe_float(c, default))), 6)


def probability(c: Column) -> Column:
    """A finite number of 0 or more, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def status_of(score: Column, confirm: float = 0.8, reject: float = 0.2) -> Column:
    """confirmed from ``confirm`` on, rejected up to ``reject``, else professor_check; both bounds count."""
    return F.when(score >= confirm, "confirmed").when(score <= reject, "rejected").otherwise("professor_check")


def model_score(valid: Column, severity: Column, unresolved: Column) -> Column:
    """One reviewer's severity score: the product of validity, severity and what the context leaves open."""
    return clamp01(clamp01(valid) * clamp01(severity) * clamp01(unresolved))


def soft_delta(score: Column, relation: Column, step: float = 0.1) -> tuple[Column, Column]:
    """The score moved by evidence, within [0, 1], and the move that took effect."""
    delta = F.when(relation == "supports", F.lit(step)).when(relation == "refutes", F.lit(-step)).otherwise(F.lit(0.0))
    new = clamp01(score + delta)
    return new, F.round(new - score, 6)


def minutes_text(seconds: Column) -> Column:
    """Seconds as mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def hours_text(seconds: Column) -> Column:
    """Rounded seconds as HH:MM:SS."""
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def frame_time(frame: Column, fps: Column) -> Column:
    """A frame's second; 0 without a positive rate."""
    return F.when(fps > 0, frame / fps).otherwise(F.lit(0.0))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with ``x1, y1, x2, y2``."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def hash_distance(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def token_cost(uncached: Column, cached: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Dollars for tokens at prices per million; unknown prices cost nothing."""
    return F.coalesce((uncached * price_in + cached * price_cached + output * price_out) / 1e6, F.lit(0.0))


def banded_score(value: Column, least: float, most: float, best: tuple[float, float]) -> Column:
    """100 in the best band, 70 in the allowed one, 40 outside; null stays null."""
    return F.when(value.isNull(), F.lit(None).cast("int")).when(value.between(*best), 100).when(value.between(least, most), 70).otherwise(40)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 60, "C").otherwise("D")


def stage_progress(band: Column, done: Column, total: Column) -> Column:
    """Percent over bands of 20: whole bands before, and this one's part."""
    part = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(0.0))
    return F.least(F.lit(100), band * 20 + F.round(part * 20).cast("int"))
