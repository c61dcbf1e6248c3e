"""Text cleaning as native expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.presets import NA_TOKENS, PLACEHOLDER_TOKENS

# Every character Python's str.strip() removes.
_SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_NON_ASCII = r"[^\x00-\x7F]"


def named(name: str) -> Column:
    """A column by its literal name: source headers may hold dots, spaces or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def _col(c: Column | str) -> Column:
    return named(c) if isinstance(c, str) else c


def _ascii_of(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")


@cache
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """The accent table, derived from the whole Unicode database.

    Characters that fold to one letter become a ``translate``; those that fold to several (ligatures,
    fractions, unit signs, the ellipsis) are looked up, in the few values that hold any.
    """
    source, target, wide = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        folded = _ascii_of(chr(code))
        if len(folded) == 1:
            source.append(chr(code))
            target.append(folded)
        elif folded:
            wide[chr(code)] = folded
    return "".join(source), "".join(target), wide


def strip_all(c: Column | str) -> Column:
    """Trim every kind of Unicode white space, not just blanks."""
    return F.btrim(_col(c).cast("string"), F.lit(_SPACES))


def fold_accents(c: Column | str) -> Column:
    """Lower-case, drop accents (compatibility decomposition), remove what is left beyond ASCII.

    The input is read several times: give it a plain column, not a long expression.
    """
    source, target, wide = _accent_tables()
    raw = _col(c).cast("string")
    lowered = F.lower(raw)
    folds = F.from_json(F.lit(json.dumps(wide)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(lowered, ""), lambda x: F.coalesce(F.try_element_at(folds, x), x)), "")
    # Taking characters out looks each up in a hash table; an expression would try them one by one.
    has_wide = F.length(F.translate(lowered, "".join(wide), "")) < F.length(lowered)
    folded = F.translate(F.when(has_wide, spelled).otherwise(lowered), source, target)
    # Comparing two lengths is far cheaper than the rewriting, and most values are plain ASCII.
    plain = F.octet_length(raw) == F.length(raw)
    return F.when(plain, lowered).otherwise(F.regexp_replace(folded, _NON_ASCII, ""))


def normalise_header(c: Column | str) -> Column:
    return F.lower(strip_all(fold_accents(c)))


def normalise_status(c: Column | str) -> Column:
    """Trim and lower-case; accents stay."""
    return F.lower(strip_all(c))


def upper_trimmed(c: Column | str) -> Column:
    return F.upper(strip_all(c))


def null_tokens(c: Column | str, tokens: Iterable[str] = tuple(NA_TOKENS)) -> Column:
    """Scan-time missing markers (exact, case-sensitive) to NULL."""
    col = _col(c)
    return F.when(~col.isin(list(tokens)), col)


def blank_placeholders(c: Column | str, tokens: Iterable[str] = tuple(PLACEHOLDER_TOKENS)) -> Column:
    """Trim, then turn placeholder words (any case) into NULL."""
    text = strip_all(c)
    return F.when(~F.lower(text).isin(list(tokens)), text)



def clean_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The clean-up before encoding: placeholders out, then accent fold, as two projections so that
    the trimmed text is computed once."""
    trimmed = df.withColumns({c: blank_placeholders(c) for c in columns})
    return trimmed.withColumns({c: fold_accents(c) for c in columns})
