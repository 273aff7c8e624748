"""Rounding and clamping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, places: int) -> Column:
    """Half towards +infinity on doubles (not the half-away-from-zero of ``round``)."""
    factor = float(10**places)
    return F.floor(c * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def round3(c: Column) -> Column:
    return round_half_up(c, 3)


def round2(c: Column) -> Column:
    return round_half_up(c, 2)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def or_else(c: Column, fallback: Column | float) -> Column:
    """``c`` unless it is null or zero."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(F.nullif(c, F.lit(0.0)), other)
