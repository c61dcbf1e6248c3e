"""Projections: renames, whitelists, audits, typed columns and output orders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.functions import named, parse_number, parse_record_date
from earlywarn.presets import DISPLAY_FIRST, TECHNICAL_COLUMNS, RecordPreset


class AmbiguousMapping(ValueError):
    """Two columns would end up with the same name."""


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_number(df: DataFrame, name: str, parse=parse_number) -> Column:
    """A column as double: numbers are cast, text is parsed, NaN becomes NULL."""
    kind = column_type(df, name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(named(name)), named(name).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return named(name).cast("double")
    return parse(name)


def plan_renames(
    columns: Sequence[str], mapping: Mapping[str, str | None], fields: Iterable[str]
) -> dict[str, str]:
    """Resolve a mapping given in either direction into source -> canonical renames.

    Field -> source is tried before source -> field. Of two fields that claim one source the later
    wins. A rename onto a name that is already taken is an error rather than a duplicate column.
    """
    present, allowed = set(columns), set(fields)
    renames: dict[str, str] = {}
    for key, value in mapping.items():
        if value is None:
            continue
        if value in present and key in allowed:
            renames[value] = key
        elif key in present and value in allowed:
            renames[key] = value
    final = [renames.get(c, c) for c in columns]
    repeated = sorted({c for c in final if final.count(c) > 1})
    if repeated:
        raise AmbiguousMapping(f"more than one column would be named {repeated}")
    return renames


def rename_columns(
    df: DataFrame, mapping: Mapping[str, str | None], fields: Iterable[str]
) -> DataFrame:
    return df.withColumnsRenamed(plan_renames(df.columns, mapping, fields))


def keep_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The canonical columns that exist, in canonical order."""
    present = set(df.columns)
    return df.select(*[named(c) for c in fields if c in present])


def dropped_columns(
    df: DataFrame,
    mapping: Mapping[str, str | None],
    fields: Iterable[str],
    renamed_only: bool = False,
) -> DataFrame:
    """Audit frame of the source columns that did not make it, names sorted.

    With ``renamed_only`` every column that was not renamed is reported, even when its own name is
    canonical and it is kept.
    """
    renames = plan_renames(df.columns, mapping, fields)
    allowed = set(fields)
    if renamed_only:
        kept = set(renames)
    else:
        kept = {c for c in df.columns if renames.get(c, c) in allowed}
    return df.select(*[named(c) for c in sorted(set(df.columns) - kept)])


def ensure_columns(df: DataFrame, names: Iterable[str], kind: str = "string") -> DataFrame:
    """Add the missing columns as NULL."""
    present = set(df.columns)
    missing = [c for c in dict.fromkeys(names) if c not in present]
    return df.withColumns({c: F.lit(None).cast(kind) for c in missing}) if missing else df


def ensure_typed(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Add missing model inputs and coerce: numbers to double, categories to text."""
    df = ensure_columns(ensure_columns(df, numeric, "double"), categorical)
    casts: dict[str, Column] = {c: as_number(df, c) for c in numeric}
    casts.update({c: F.col(c).cast("string") for c in categorical})
    return df.withColumns(casts)


def order_scoring(df: DataFrame, preset: RecordPreset) -> DataFrame:
    """Ids first (the last one declared leads), features, status."""
    present = set(df.columns)
    ids = [c for c in reversed(preset.ids) if c in present]
    body = [c for c in preset.features if c in present]
    return df.select(*[named(c) for c in dict.fromkeys([*ids, *body, preset.status])])


def order_training(df: DataFrame, preset: RecordPreset) -> DataFrame:
    """Features, everything else, status last."""
    present = set(df.columns)
    body = [c for c in preset.features if c in present]
    others = [c for c in df.columns if c not in set(body) and c != preset.status]
    tail = [preset.status] if preset.status in present else []
    return df.select(*[named(c) for c in [*body, *others, *tail]])


def model_input(
    df: DataFrame, features: Sequence[str], status: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Exact feature order with missing ones as NULL; status last when present; extras go."""
    df = ensure_columns(df, features)
    tail = [status] if status is not None and status in df.columns else []
    return df.select(*[named(c) for c in dict.fromkeys([*keep, *features, *tail])])


def drop_technical(df: DataFrame, columns: Sequence[str] = tuple(TECHNICAL_COLUMNS)) -> DataFrame:
    return df.drop(*columns)


def display_order(df: DataFrame, first: Sequence[str] = tuple(DISPLAY_FIRST)) -> DataFrame:
    present = set(df.columns)
    lead = [c for c in first if c in present]
    rest = [c for c in df.columns if c not in set(lead)]
    return df.select(*[named(c) for c in [*lead, *rest]])


def typed_records(
    df: DataFrame,
    schema: T.StructType,
    dates: Sequence[str] = (),
    required: Sequence[str] = (),
    error: str = "_error",
) -> DataFrame:
    """Project onto ``schema`` and say in ``error`` why a row is unacceptable (NULL when it is fine).

    Unknown columns are ignored, absent ones become NULL.
    """
    df = ensure_columns(df, schema.names)
    out, problems = [], []
    for f in schema.fields:
        if f.name in dates:
            parsed, bad = parse_record_date(f.name)
            out.append(parsed.alias(f.name))
            problems.append(F.when(bad, F.lit(f"{f.name}: not a date")))
        elif isinstance(f.dataType, T.NumericType):
            value = as_number(df, f.name)
            whole = isinstance(f.dataType, T.IntegralType)
            cast = value.try_cast(f.dataType)
            unfit = F.col(f.name).isNotNull() & (cast.isNull() | (F.lit(whole) & (value % 1 != 0)))
            out.append(cast.alias(f.name))
            problems.append(F.when(unfit, F.lit(f"{f.name}: not a number of its type")))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    problems += [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in required]
    reason = F.concat_ws("; ", *problems) if problems else F.lit("")
    return df.select(*out, F.when(reason != "", reason).alias(error))


def split_quarantine(df: DataFrame, error: str = "_error") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
