"""Row predicates and the guards that stop a job on unusable input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import normalise_status
from earlywarn.operators.schema import as_number
from earlywarn.presets import (
    ACTIVE_STATUS,
    COMPLETED_STATUSES,
    DEFAULT_RISK_THRESHOLD,
    DROPOUT_STATUSES,
)


class UnusableData(ValueError):
    """The input cannot support the requested job."""


def valid_labels(df: DataFrame, valid: str = "is_target_valid") -> DataFrame:
    return df.where(F.col(valid))


def in_years(df: DataFrame, years: Iterable[int], year: str = "ano_ingresso") -> DataFrame:
    return df.where(F.col(year).isin(list(years)))


def terminal_only(
    df: DataFrame,
    status: str = "situacao",
    statuses: Iterable[str] = tuple(COMPLETED_STATUSES + DROPOUT_STATUSES),
) -> DataFrame:
    return df.where(normalise_status(status).isin(list(statuses)))


def filter_scored(
    df: DataFrame,
    statuses: Sequence[str] = (),
    courses: Sequence[str] = (),
    risk: tuple[float, float] = (0.0, 1.0),
    years: tuple[int, int] = (2000, 2030),
    status: str = "situacao",
    course: str = "curso",
    score: str = "prob_evasao",
    year: str = "ano_ingresso",
) -> DataFrame:
    """All conditions together; an empty list or an absent column filters nothing."""
    present = set(df.columns)
    tests: list[Column] = []
    if statuses and status in present:
        tests.append(F.col(status).isin(list(statuses)))
    if courses and course in present:
        tests.append(F.col(course).isin(list(courses)))
    if score in present:
        tests.append(F.col(score).between(*risk))
    if year in present:
        df = df.withColumn(year, as_number(df, year))
        tests.append(F.col(year).between(*years))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def is_active(status: Column | str = "situacao", active: str = ACTIVE_STATUS) -> Column:
    col = F.col(status) if isinstance(status, str) else status
    return F.lower(col) == active


def active_only(df: DataFrame, status: str = "situacao", active: str = ACTIVE_STATUS) -> DataFrame:
    return df.where(is_active(status, active))


def active_above(
    df: DataFrame,
    threshold: float = DEFAULT_RISK_THRESHOLD,
    status: str = "situacao",
    score: str = "prob_evasao",
    active: str = ACTIVE_STATUS,
) -> DataFrame:
    return df.where(is_active(status, active) & (F.col(score) > threshold))


def guard_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows that meet each condition, all counted in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def label_counts(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return guard_counts(
        df, negative=y == 0, positive=y == 1, other=F.coalesce(~y.isin(0, 1), F.lit(True))
    )


def check_labels(df: DataFrame, label: str) -> dict[str, int]:
    """Counts per class; a label outside {0, 1} or no labelled row at all is an error."""
    counts = label_counts(df, label).first().asDict()
    if counts["other"]:
        raise UnusableData(f"{counts['other']} rows carry a label other than 0 or 1")
    if not counts["negative"] + counts["positive"]:
        raise UnusableData("no rows with a valid label")
    return counts


def require_both_classes(counts: dict[str, int], part: str) -> None:
    if not counts["negative"] or not counts["positive"]:
        raise UnusableData(f"the {part} rows hold a single class: {counts}")
