"""Functions on numbers; NaN and NULL both mean missing outside signal arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_as_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def to_number(value: Column) -> Column:
    """A double, NULL where the text is not a number."""
    return missing_as_null(value.try_cast("double"))


def percent_change(base: Column, task: Column) -> Column:
    """(base - task) / base in percent, NULL where base is 0 or missing."""
    base = missing_as_null(base)
    return missing_as_null(F.try_divide((base - task) * 100.0, base))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def capped_high(high: float, sfreq: Column, margin: float) -> Column:
    """The upper band edge, kept ``margin`` Hz below the Nyquist rate."""
    return F.least(F.lit(float(high)), sfreq / 2.0 - margin)


def band_label(low, high: Column) -> Column:
    return F.format_string("%.1f-%.1f", F.lit(float(low)), high)


def resultant_length(cosines: Column, sines: Column) -> Column:
    return F.sqrt(cosines * cosines + sines * sines)
