"""Status words, admission routes and time indices."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from earlywarn.functions.text import _col, fold_accents, strip_all
from earlywarn.presets import NEGATIVE_STATUSES, POSITIVE_STATUSES


def status_to_binary(
    c: Column | str,
    negative: Iterable[str] = tuple(NEGATIVE_STATUSES),
    positive: Iterable[str] = tuple(POSITIVE_STATUSES),
) -> Column:
    """Static outcome: 0 for completed, 1 for dropped out, NULL while undecided."""
    word = fold_accents(strip_all(c))
    return F.when(word.isin(list(negative)), F.lit(0)).when(word.isin(list(positive)), F.lit(1))


def match_route(c: Column | str, pattern: str) -> Column:
    """Case-insensitive pattern test that is false, not NULL, on missing text."""
    return F.coalesce(_col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False))


def half_year_index(year: Column | str, half: Column | str) -> Column:
    """Consecutive half-years differ by one."""
    return _col(year) * F.lit(2) + (_col(half) - F.lit(1))


def time_index(year: Column | str, half: Column | str | None = None) -> Column:
    """Sortable year-and-half key, kept whole: 2020 and half 2 give 20202; a missing half counts as 1."""
    h = F.lit(1) if half is None else F.coalesce(_col(half), F.lit(1))
    return (_col(year) * F.lit(10) + h).cast("bigint")
