"""Means, rates and overlaps with each convention for empty input named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def mean(c: Column) -> Column:
    """Nulls and NaN don't count; null if nothing is left."""
    return F.avg(_numbers(c))


def std(c: Column) -> Column:
    """Of the sample; null below two values."""
    return F.stddev_samp(_numbers(c))


def population_std(c: Column) -> Column:
    return F.stddev_pop(_numbers(c))


def median(c: Column) -> Column:
    return F.median(_numbers(c))


def rate_or_null(n: Column, d: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def rate_or_zero(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float | None = 1.0) -> Column:
    """both_empty: what two empty sets give; with None a side that is empty gives null, as text similarity has it."""
    share = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
    if both_empty is None:
        return F.when((F.size(a) > 0) & (F.size(b) > 0), share)
    return F.coalesce(share, F.lit(both_empty))


def overlap(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least.cast("double")), F.lit(empty))


def verdict_counts(verdict: Column) -> list[Column]:
    return [F.count("*").alias("n_claims"), *(F.count_if(verdict == v).alias(f"n_{v}") for v in ("supported", "refuted", "insufficient"))]


def verdict_rates() -> dict[str, Column]:
    """true, false and unverifiable rates are 0 without claims; accuracy is null without decided ones."""
    n, s, r, i = (F.col(c) for c in ("n_claims", "n_supported", "n_refuted", "n_insufficient"))
    return {
        "true_rate": rate_or_zero(s, n), "false_rate": rate_or_zero(r, n), "unverifiable_rate": rate_or_zero(i, n),
        "accuracy": F.try_divide(s.cast("double"), (s + r).cast("double")),
    }


def found(flag: Column, supported: Column, refuted: Column, insufficient: Column, claims: Column, similarities: list[Column], strict: bool = False) -> Column:
    """Whether the subject has a reference page: the flag if there is one; strictly nothing else; else inferred."""
    if strict:
        return F.coalesce(flag, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    any_similarity = F.coalesce(*similarities).isNotNull() if similarities else F.lit(False)
    return (
        F.when(flag.isNotNull(), flag)
        .when((zero(supported) > 0) | (zero(refuted) > 0) | any_similarity, True)
        .when((zero(claims) > 0) & (zero(insufficient) == zero(claims)), False)
        .otherwise(True)
    )


def seeded(key: Column, seed: int) -> Column:
    """What a seeded sample is ordered by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def counter_json(counts: Column) -> Column:
    """A map of counts as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts))))
