"""Functions on arrays, maps and structs as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often and wherever ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalised(probabilities: Column) -> Column:
    """A map of probabilities scaled to sum 1 (six digits); null if a value is negative, not finite, or all are 0."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))) & (total > 0)
    return F.when(fine, F.transform_values(probabilities, lambda _, v: F.round(v / total, 6)))


def top_type(probabilities: Column, order: list[str]) -> Column:
    """The type of highest probability, ties by the declared order; null for an empty map."""
    known = F.array(*[F.struct(F.coalesce(F.try_element_at(probabilities, F.lit(t)), F.lit(-1.0)).alias("p"), F.lit(-k).alias("o"), F.lit(t).alias("t")) for k, t in enumerate(order)])
    best = F.array_max(known)
    return F.when(best["p"] >= 0, best["t"])


def margin(probabilities: Column) -> Column:
    """The highest less the second highest value (0 for a missing one), six digits."""
    down = F.sort_array(F.concat(F.map_values(probabilities), F.array(F.lit(0.0), F.lit(0.0))), asc=False)
    return F.round(F.get(down, F.lit(0)) - F.get(down, F.lit(1)), 6)


def added(a: Column, b: Column) -> Column:
    """Two maps of numbers added up by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def context_ids(many: Column, one: Column) -> Column:
    """A list of ids from a list column or a single one."""
    return F.coalesce(F.nullif(many, F.array().cast("array<string>")), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def first_filled(*columns: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def pair_keys(members: Column) -> Column:
    """All unordered pairs of an array's distinct members as ``a, b`` structs, smaller first."""
    own = F.array_sort(F.array_distinct(members))
    return F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def adjacent_pair(members: Column) -> Column:
    """Whether an array holds exactly two distinct numbers that differ by one."""
    own = F.array_distinct(members)
    return (F.size(own) == 2) & (F.array_max(own) - F.array_min(own) == 1)


def no_repeats(lines: Column) -> Column:
    """An array without empty lines and without lines that repeat the one before."""
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1)))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean squared difference of two number arrays of one length; 0 for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
