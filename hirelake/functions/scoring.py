"""The scoring algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def experience_fit(gap: Column) -> Column:
    """By years missing: -2 or less 0.9, none 1, up to one 0.8, two 0.55, four 0.25, else 0."""
    return F.when(gap <= -2, 0.9).when(gap <= 0, 1.0).when(gap <= 1, 0.8).when(gap <= 2, 0.55).when(gap <= 4, 0.25).when(gap.isNotNull(), 0.0)


def seniority_multiplier(a: Column, b: Column) -> Column:
    """One less a tenth per step between the ranks, 0.8 at least; one where a rank is unknown."""
    return F.when(a.isNull() | b.isNull(), 1.0).otherwise(F.greatest(F.lit(0.8), 1 - 0.1 * F.abs(a - b)))


def renormalised(parts: list[tuple[Column, float, bool]]) -> Column:
    """Weighted mean of (value, weight, evidence): a missing part weighs nothing, a missing piece of evidence counts as 0."""
    up = sum((F.coalesce(v, F.lit(0.0)) * w for v, w, _ in parts), F.lit(0.0))
    down = sum((F.lit(w) if evidence else F.when(v.isNotNull(), w).otherwise(0.0) for v, w, evidence in parts), F.lit(0.0))
    return F.when(down > 0, up / down)


def two_signal(title: Column, text: Column) -> Column:
    """0.7 of the title's and 0.3 of the text's similarity; a missing signal is worth nothing."""
    return F.coalesce(title, F.lit(0.0)) * 0.7 + F.coalesce(text, F.lit(0.0)) * 0.3


def mean_of_known(parts: list[Column]) -> Column:
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def first_reason(rungs: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The reason of the first rung that holds; an unknown condition does not hold."""
    out = None
    for condition, reason in rungs:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out.otherwise(otherwise) if otherwise is not None else out


def final_score(x: Column) -> Column:
    """Kept in 0..100, DECIMAL(5,2), rounded half up; null stays null."""
    kept = F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))
    return F.round(kept.cast("decimal(20,10)"), 2).cast("decimal(5,2)")
