"""Raw records to model-ready records, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import (
    age_in_years,
    first_present,
    match_route,
    parse_day_first,
    parse_decimal_comma,
    parse_grouped_decimal,
    parse_number,
    parse_yes_no,
    upper_trimmed,
)
from earlywarn.operators.filters import terminal_only
from earlywarn.operators.labels import LabelSpec, label_future_events
from earlywarn.operators.schema import (
    as_number,
    column_type,
    dropped_columns,
    ensure_columns,
    keep_fields,
    order_scoring,
    order_training,
    rename_columns,
)
from earlywarn.presets import SCORING_PRESET, TRAINING_PRESET, RecordPreset


def fill_age(df: DataFrame, preset: RecordPreset, as_of: date | Column) -> DataFrame:
    """A given age wins; otherwise it is computed from the birth date."""
    if preset.age is None or preset.birth_date is None or preset.birth_date not in df.columns:
        return df
    df = ensure_columns(df, [preset.age])
    kind = column_type(df, preset.birth_date).typeName()
    born = F.col(preset.birth_date) if kind in ("date", "timestamp", "timestamp_ntz") else (
        parse_day_first(preset.birth_date)
    )
    computed = age_in_years(born, as_of)
    # The age is read before any decimal comma is handled.
    return df.withColumn(preset.age, first_present(as_number(df, preset.age, parse_number), computed))


def parse_numbers(
    df: DataFrame, preset: RecordPreset, thousands: str | None = None, yes_no: bool = False
) -> DataFrame:
    """Decimal commas in the named columns and every grade column, as doubles.

    ``thousands`` also accepts grouped numbers and ``yes_no`` maps yes/no words; both are off by
    default, where such text becomes NULL.
    """

    def parse(name: str) -> Column:
        number = parse_grouped_decimal(name, thousands) if thousands else parse_decimal_comma(name)
        return parse_yes_no(name, otherwise=number) if yes_no else number

    grades = [c for c in df.columns if c.startswith(preset.grade_prefix)]
    wanted = [c for c in dict.fromkeys([*preset.decimals, *grades]) if c in df.columns]
    return df.withColumns({c: as_number(df, c, parse) for c in wanted})


def fill_and_mask_grades(df: DataFrame, preset: RecordPreset) -> DataFrame:
    """Missing grades become 0.0, then the grades of the other admission route become NULL."""
    grades = {
        c: F.coalesce(F.col(c), F.lit(0.0)) for c in df.columns if c.startswith(preset.grade_prefix)
    }
    if preset.route is not None and preset.route in df.columns:
        for rule in preset.route_rules:
            hit = match_route(preset.route, rule.pattern)
            for c in rule.blank:
                if c in df.columns:
                    grades[c] = F.when(~hit, grades.get(c, F.col(c)))
    return df.withColumns(grades) if grades else df


def upper_text(df: DataFrame, preset: RecordPreset) -> DataFrame:
    return df.withColumns({c: upper_trimmed(c) for c in preset.uppers if c in df.columns})


def clean_records(
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    preset: RecordPreset = SCORING_PRESET,
    as_of: date | Column | None = None,
    thousands: str | None = None,
    yes_no: bool = False,
) -> DataFrame:
    """Rename, whitelist, complete, type and normalise. No shuffle, no Python workers."""
    kept = keep_fields(rename_columns(raw, mapping or {}, preset.fields), preset.fields)
    extra = [preset.status] + ([preset.birth_date] if preset.birth_date else [])
    df = ensure_columns(kept, [*preset.features, *extra])
    df = fill_age(df, preset, date.today() if as_of is None else as_of)
    df = parse_numbers(df, preset, thousands, yes_no)
    return upper_text(fill_and_mask_grades(df, preset), preset)


def records_for_scoring(
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    preset: RecordPreset = SCORING_PRESET,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(ordered clean rows, audit of dropped columns)."""
    clean = order_scoring(clean_records(raw, mapping, preset, **options), preset)
    return clean, dropped_columns(raw, mapping or {}, preset.fields)


def records_for_training(
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    preset: RecordPreset = TRAINING_PRESET,
    label: LabelSpec | None = None,
    decided_only: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`records_for_scoring`, labelled when the history columns are there.

    The audit lists every column that was not renamed. ``decided_only`` keeps rows whose status is
    final (after labelling, which needs the whole history); it is off because undecided rows are
    what a prospective model learns from.
    """
    df = clean_records(raw, mapping, preset, **options)
    spec = label or LabelSpec()
    if set(spec.needed) <= set(df.columns):
        when = [] if spec.time else [spec.year, spec.half]
        df = df.withColumns({c: as_number(df, c).cast("int") for c in when})
        df = label_future_events(df, spec)
    if decided_only:
        df = terminal_only(df, preset.status)
    return order_training(df, preset), dropped_columns(
        raw, mapping or {}, preset.fields, renamed_only=True
    )
