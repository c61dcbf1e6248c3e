"""Risk bands on a probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earlywarn.functions.text import _col
from earlywarn.presets import DEFAULT_RISK_THRESHOLD, HIGH_RISK_CUT, LOW_RISK_CUT, RISK_LABELS


def risk_label(
    p: Column | str, threshold: float = DEFAULT_RISK_THRESHOLD, low: float = LOW_RISK_CUT
) -> Column:
    """Low below ``low``, medium below ``threshold``, high otherwise; a missing score is high."""
    small, medium, large = RISK_LABELS
    c = _col(p)
    return (
        F.when(c.isNull(), F.lit(large))
        .when(c < low, F.lit(small))
        .when(c < threshold, F.lit(medium))
        .otherwise(F.lit(large))
    )


def risk_percent(p: Column | str) -> Column:
    """Percent with two decimals, halves to even."""
    return F.bround(_col(p) * F.lit(100.0), 2)


def class_at(p: Column | str, cut: float = 0.5) -> Column:
    return F.when(_col(p).isNotNull(), (_col(p) >= cut).cast("int"))


def risk_level(p: Column | str) -> Column:
    """The fixed three-level reading with cuts at 0.33 and 0.66."""
    return risk_label(p, threshold=HIGH_RISK_CUT)
