"""Number parsing and small arithmetic that never throws under ANSI mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from earlywarn.functions.text import _col, strip_all
from earlywarn.presets import BOOLEAN_TOKENS

# Spark's cast also takes "1d" and "1f", which are not numbers in a data file.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column | str) -> Column:
    """Text to double, NULL when it is not a plain finite number."""
    text = strip_all(c)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_decimal_comma(c: Column | str) -> Column:
    """``"12,5"`` and ``"12.5"`` to 12.5; grouped numbers such as ``"2.000,00"`` stay NULL."""
    return parse_number(F.replace(_col(c).cast("string"), F.lit(","), F.lit(".")))


def parse_grouped_decimal(c: Column | str, thousands: str = ".") -> Column:
    """Like :func:`parse_decimal_comma`, with a thousands separator removed first."""
    text = _col(c).cast("string")
    grouped = parse_decimal_comma(F.replace(text, F.lit(thousands), F.lit("")))
    return F.when(text.contains(","), grouped).otherwise(parse_number(text))


def parse_yes_no(
    c: Column | str,
    tokens: Mapping[str, float] = BOOLEAN_TOKENS,
    otherwise: Column | None = None,
) -> Column:
    """Yes/no words to 1.0/0.0, anything else through the number parser."""
    word = F.lower(strip_all(c))
    out = parse_decimal_comma(c) if otherwise is None else otherwise
    for token, value in tokens.items():
        out = F.when(word == token, F.lit(value)).otherwise(out)
    return out


def present_sum(cols: Sequence[Column | str]) -> Column:
    """Row sum that skips NULLs; NULL only when every input is."""
    if not cols:
        return F.lit(None).cast("double")
    inputs = [_col(c) for c in cols]
    total = F.coalesce(inputs[0], F.lit(0.0))
    for c in inputs[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*inputs).isNotNull(), total)


def share(part: Column | str, rest: Column | str) -> Column:
    """part / (part + rest); NULL when the total is zero or either side is missing."""
    p, r = _col(part), _col(rest)
    total = p + r
    return F.when(total != 0, F.try_divide(p, total))
