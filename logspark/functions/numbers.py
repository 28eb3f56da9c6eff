"""Rounding and ratio rules shared by all reports."""

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round towards positive infinity at the half, as the published reports do."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def round_long(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent; 0 where there is nothing to divide by."""
    return F.when(whole > 0, round_half_up(part / whole * 100, digits)).otherwise(0.0)


def growth_rate(current: Column, previous: Column) -> Column:
    """Percent change; a start from nothing counts as 100 (or 0 when nothing came)."""
    return (
        F.when(
            F.coalesce(previous, F.lit(0)) == 0, F.when(current > 0, 100.0).otherwise(0.0)
        ).otherwise(round_half_up((current - previous) / previous * 100))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the sort key of every ordered operator."""
    return F.unix_micros(ts.cast("timestamp"))
