"""Temporal and hashed splits. A split is one derived column; rows never move."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import time_index
from earlywarn.operators.filters import UnusableData
from earlywarn.operators.quantiles import exact_ranks
from earlywarn.session import pin

TRAIN, VALIDATION, TEST = "train", "val", "test"
MIN_SIDE_ROWS = 50


@dataclass(frozen=True)
class YearSplit:
    train_range: tuple[int, int]
    val_years: tuple[int, ...]
    test_years: tuple[int, ...]

    @classmethod
    def from_config(cls, raw: Mapping[str, Any]) -> YearSplit:
        """Accepts lists or the single-year spellings; every part is required."""

        def years(many: str, one: str) -> tuple[int, ...]:
            value = raw.get(many)
            if value is None and raw.get(one) is not None:
                value = [raw[one]]
            if not value:
                raise UnusableData(f"split configuration lacks {many} (or {one})")
            return tuple(sorted(int(y) for y in value))

        if not raw.get("train_range"):
            raise UnusableData("split configuration lacks train_range")
        bounds = [int(y) for y in raw["train_range"]]
        if len(bounds) != 2 or bounds[0] > bounds[1]:
            raise UnusableData(f"train_range must be [first, last], not {bounds}")
        return cls((bounds[0], bounds[1]), years("val_years", "val_year"),
                   years("test_years", "test_year"))

    @property
    def years(self) -> list[int]:
        start, end = self.train_range
        return [*range(start, end + 1), *self.val_years, *self.test_years]

    def validate(self, available: Sequence[int]) -> None:
        end, known = self.train_range[1], set(available)
        if end >= min(self.val_years):
            raise UnusableData("training must end before the first validation year")
        if max(self.val_years) >= min(self.test_years):
            raise UnusableData("validation must end before the first test year")
        if not known & set(range(self.train_range[0], end + 1)):
            raise UnusableData(f"no rows in the training years {self.train_range}")
        for part, wanted in ((VALIDATION, self.val_years), (TEST, self.test_years)):
            absent = sorted(set(wanted) - known)
            if absent:
                raise UnusableData(f"no rows in the {part} years {absent}; have {sorted(known)}")

    def column(self, year: str = "ano_ingresso") -> Column:
        y = F.col(year)
        return (
            F.when(y.between(*self.train_range), F.lit(TRAIN))
            .when(y.isin(list(self.val_years)), F.lit(VALIDATION))
            .when(y.isin(list(self.test_years)), F.lit(TEST))
        )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def available_years(df: DataFrame, year: str = "ano_ingresso") -> list[int]:
    """Distinct years; calendar years are few."""
    return [int(r[0]) for r in distinct_sorted(df, year).collect()]


def years_present(df: DataFrame, wanted: Sequence[int], year: str = "ano_ingresso") -> list[int]:
    """Which of the wanted years have rows: one flag per year comes back, whatever the column holds."""
    listed = sorted(set(wanted))
    row = df.agg(*[F.count_if(F.col(year) == y).alias(f"y{i}") for i, y in enumerate(listed)]).first()
    return [y for i, y in enumerate(listed) if row[i]]


def hash_fraction(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """A stable pseudo-random number in [0, 1) from the row's own key."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys],
                       F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(float(2**32))


def random_split(keys: Sequence[str], seed: int = 42, holdout: float = 0.2) -> Column:
    """Hashed train/validation split: membership depends on the key alone, and reruns agree.

    Each class is split in the same proportion only in expectation; :func:`quota_split` keeps to it.
    """
    return F.when(hash_fraction(keys, seed) < holdout, F.lit(VALIDATION)).otherwise(F.lit(TRAIN))


def hash_place(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """A row's place in a stable pseudo-random order: 52 bits, which a double holds exactly."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys],
                       F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def quota_split(
    df: DataFrame, keys: Sequence[str], label: str, seed: int = 42, holdout: float = 0.2,
    classes: Sequence[int] = (0, 1),
) -> Column:
    """Stratified train/validation split: of a class of n rows exactly round(holdout * n) validate.

    Those are the rows of the class that come first in a hashed order of their keys. The place of the
    last of them is found for all classes at once, by sketches and exact counts: two or three
    aggregations, no sort and no window. Rows of one key never part, so ``keys`` should tell rows
    apart; where they do not, the quota is met up to the rows of one key. Rows without a listed class
    train. Halves round away from zero.
    """
    place = hash_place(keys, seed)
    y = F.col(label)
    names = [f"_c{i}" for i in range(len(classes))]
    places = df.select(*[F.when(y == c, place).alias(name) for c, name in zip(classes, names, strict=True)])

    def last(n: int) -> list[int]:
        taken = math.floor(holdout * n + 0.5)
        return [taken - 1] if taken else []

    found = exact_ranks(places, names, holdout, last)
    side = F.lit(False)
    for c, name in zip(classes, names, strict=True):
        if found[name]:
            side = side | F.coalesce((y == c) & (place <= F.lit(found[name][0])), F.lit(False))
    return F.when(side, F.lit(VALIDATION)).otherwise(F.lit(TRAIN))


def hash_fold(keys: Sequence[str], folds: int, seed: int = 42) -> Column:
    return F.floor(hash_fraction(keys, seed) * F.lit(folds)).cast("int")


def usable_folds(requested: int, class_counts: Mapping[str, int]) -> int:
    return min(requested, class_counts["negative"], class_counts["positive"])


def period_counts(df: DataFrame, year: str, half: str | None) -> DataFrame:
    """Rows per period: the one pass over the data that the automatic split needs."""
    return pin(df.groupBy(time_index(year, half).alias("t")).agg(F.count("*").alias("n")))


def cutoff_time(periods: DataFrame) -> DataFrame:
    """One row: number of periods and the cut-off (second-latest of four or more, else latest)."""
    known = periods.where(F.col("t").isNotNull())
    latest = known.agg(F.count("*").alias("periods"), F.max("t").alias("last"))
    second = known.where(F.col("t") < known.agg(F.max("t")).scalar()).agg(F.max("t"))
    return latest.select(
        "periods",
        F.when(F.col("periods") >= 4, second.scalar()).otherwise(F.col("last")).alias("cutoff"),
    )


def automatic_split(
    df: DataFrame,
    keys: Sequence[str],
    year: str = "ano_ingresso",
    half: str | None = "semestre_ingresso",
    seed: int = 42,
    min_rows: int = MIN_SIDE_ROWS,
    label: str | None = None,
) -> tuple[Column, str]:
    """The split column and the strategy used: by time, or at random when time cannot be used.

    With a ``label`` the random split is stratified by it, else it follows the keys' hash alone.
    """

    def at_random() -> tuple[Column, str]:
        if label is None:
            return random_split(keys, seed), "random"
        return quota_split(df, keys, label, seed), "random"

    if year not in df.columns:
        return at_random()
    half = half if half in df.columns else None
    periods = period_counts(df, year, half)
    cut = cutoff_time(periods).first()
    if cut["periods"] < 2:
        return at_random()
    late = F.coalesce(F.col("t") >= cut["cutoff"], F.lit(False))
    sizes = periods.agg(
        F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~late, F.col("n"))), F.lit(0)),
    ).first()
    if min(sizes) < min_rows:
        return at_random()
    after = F.coalesce(time_index(year, half) >= cut["cutoff"], F.lit(False))
    return F.when(after, F.lit(VALIDATION)).otherwise(F.lit(TRAIN)), "time"
