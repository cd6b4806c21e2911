"""Scores: hotness, recency blends, archive decisions, propagation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _seconds(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6


def hotness(active_count: Column, updated_at: Column, as_of: Column) -> Column:
    """Use and recency in one number of at most 1; a missing time has no recency."""
    hours = F.greatest(_seconds(updated_at, as_of) / 3600.0, F.lit(1.0))
    recency = F.coalesce(1.0 / F.log2(hours + 2.0), F.lit(0.0))
    return F.least(F.lit(1.0), 0.3 * F.log1p(active_count.cast("double")) + 0.7 * recency)


def blend(semantic: Column, hot: Column, weight: float = 0.2) -> Column:
    return (1 - weight) * semantic + weight * hot


def propagate(raw: Column, parent: Column) -> Column:
    """Half the parent's score goes down where it is positive; non-finite scores are 0."""
    mixed = F.when(parent > 0, 0.5 * raw + 0.5 * parent).otherwise(raw)
    return F.when(F.isnan(mixed) | (F.abs(mixed) == float("inf")), 0.0).otherwise(mixed)


def archive_score(active_count: Column, updated_at: Column, as_of: Column, half_life_days: float = 7.0) -> Column:
    """Logistic of the use, halved with every half-life of age."""
    days = F.greatest(_seconds(updated_at, as_of) / 86400.0, F.lit(0.0))
    use = 1.0 / (1.0 + F.exp(-F.log1p(active_count.cast("double"))))
    return F.coalesce(use * F.pow(F.lit(2.0), -days / half_life_days), F.lit(0.0))


def is_cold(score: Column, updated_at: Column, as_of: Column, below: float = 0.1, young_days: float = 90.0, floor: float = 0.05) -> Column:
    """Cold enough to archive: below the bound, unless young and above the floor."""
    days = _seconds(updated_at, as_of) / 86400.0
    return (score < below) & ~((days < young_days) & (score > floor))
