"""Column expressions. Every function takes and returns Spark columns; none needs a Python worker."""

from earlywarn.functions.dates import age_in_years, first_present, parse_day_first, parse_record_date
from earlywarn.functions.numbers import (
    parse_decimal_comma,
    parse_grouped_decimal,
    parse_number,
    parse_yes_no,
    present_sum,
    share,
)
from earlywarn.functions.risk import class_at, risk_label, risk_level, risk_percent
from earlywarn.functions.status import half_year_index, match_route, status_to_binary, time_index
from earlywarn.functions.text import (
    blank_placeholders,
    clean_categories,
    fold_accents,
    named,
    normalise_header,
    normalise_status,
    null_tokens,
    strip_all,
    upper_trimmed,
)

__all__ = [
    "age_in_years", "blank_placeholders", "class_at", "clean_categories", "first_present",
    "fold_accents", "half_year_index", "match_route", "named", "normalise_header", "normalise_status",
    "null_tokens", "parse_day_first", "parse_decimal_comma", "parse_grouped_decimal",
    "parse_number", "parse_record_date", "parse_yes_no", "present_sum", "risk_label", "risk_level",
    "risk_percent", "share", "status_to_binary", "strip_all", "time_index", "upper_trimmed",
]
