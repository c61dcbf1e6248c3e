"""Date parsing per value: each row is read with the format whose shape it has."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from earlywarn.functions.text import _col, strip_all

DAY_FIRST = (
    "d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy",
)
RECORD_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy")

# A time of day behind a date, and a zone behind that.
_TIME = r"[ T]+\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?$"
# Two-digit years from here on belong to the last century.
_LAST_CENTURY = 2069

_SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}


def _shape(fmt: str) -> str:
    parts = re.split(r"(yyyy|yy|MM|dd|M|d)", fmt)
    return "^" + "".join(_SHAPES.get(p, re.escape(p)) for p in parts) + "$"


def parse_dates(c: Column | str, formats: Sequence[str]) -> Column:
    """The first format whose digit layout fits decides; a time of day is left off, an impossible date is NULL.

    Choosing by layout keeps each value to one parse. Trying the formats in turn would raise and
    catch an error for every value that is not in the first one.
    """
    text = strip_all(c)
    text = F.when(text.contains(":"), F.regexp_replace(text, _TIME, "")).otherwise(text)
    out = F.when(text.rlike(_shape(formats[0])), _date(text, formats[0]))
    for fmt in formats[1:]:
        out = out.when(text.rlike(_shape(fmt)), _date(text, fmt))
    return out


def _date(text: Column, fmt: str) -> Column:
    date = F.try_to_date(text, fmt)
    if "yyyy" in fmt or "yy" not in fmt:
        return date
    return F.when(F.year(date) >= _LAST_CENTURY, F.add_months(date, -1200)).otherwise(date)


def parse_day_first(c: Column | str, formats: Sequence[str] = DAY_FIRST) -> Column:
    return parse_dates(c, formats)


def parse_record_date(c: Column | str) -> tuple[Column, Column]:
    """The parsed date and a flag marking non-empty text that no accepted format fits."""
    text = strip_all(c)
    parsed = parse_dates(c, RECORD_FORMATS)
    return parsed, F.coalesce(text != "", F.lit(False)) & parsed.isNull()


def age_in_years(birth: Column | str, as_of: Column | date) -> Column:
    """Whole years as floor(days / 365)."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.floor(F.datediff(today, _col(birth)) / F.lit(365)).cast("double")


def first_present(given: Column, computed: Column) -> Column:
    return F.coalesce(given, computed)
