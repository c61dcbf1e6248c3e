"""Header matching for a whole landing zone: (file, position, header) -> canonical field.

Per (file, field) the first of these wins: an exact alias, the special rule for the field, the number
of hint words in the header, a fuzzy name score. Files of one source share most of their headers, so a
dictionary of distinct headers is scored, once each, and joined to their occurrences. The choice of the
best header is one maximum per field in a single aggregation by file, which combines map-side: no task
ever holds all headers of a file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import normalise_header
from earlywarn.operators.lookups import lookup_join
from earlywarn.presets import (
    FUZZY_THRESHOLD,
    HEADER_ALIASES,
    HEADER_HINTS,
    ID_COLUMNS,
    SCORING_FIELDS,
    TRAINING_FIELDS,
)
from earlywarn.session import pin


@dataclass(frozen=True)
class MatchSpec:
    fields: tuple[str, ...] = tuple(SCORING_FIELDS)
    aliases: Mapping[str, str | None] = field(default_factory=lambda: dict(HEADER_ALIASES))
    hints: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(HEADER_HINTS))
    # A field whose name holds a family word only matches headers that hold it too.
    families: tuple[str, ...] = ("enem", "vestibular")
    # Field -> (word its header must hold, word that makes a header second choice).
    special: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {"municipio_residencia": ("municipio", "sisu")}
    )
    threshold: float = FUZZY_THRESHOLD


def training_match() -> MatchSpec:
    """Matching for training extracts: id and time fields have no aliases, only fuzzy scores."""
    aliases = {k: v for k, v in HEADER_ALIASES.items() if v not in ID_COLUMNS}
    return MatchSpec(fields=tuple(TRAINING_FIELDS), aliases=aliases)


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Letters and digits that spellings are compared by before any edit distance, each a bit of a number.
_BAG = "abcdefghijklmnopqrstuvwxyz0123456789"


def _bag(text: str) -> int:
    return sum(1 << i for i, c in enumerate(_BAG) if c in text)


def _spell(df: DataFrame) -> DataFrame:
    """Add the forms of the header that the scores look at."""
    bits = " | ".join(f"IF(contains(norm, '{c}'), {1 << i}L, 0L)" for i, c in enumerate(_BAG))
    words = df.selectExpr("*", "translate(norm, '_', ' ') AS plain", "length(norm) AS size", f"{bits} AS bag")
    return words.selectExpr("*", "array_join(array_sort(split(plain, ' ')), ' ') AS sorted")


def _fuzzy_sql(name: str, spec: MatchSpec) -> str:
    """0-100 from the edit distance, the better of the plain and the word-sorted spelling.

    The distance is at least the difference in length, and at least the number of letters that only one
    of the two has. Most pairs are ruled out by these without computing it: they score NULL.
    """
    n, words, bag = len(name), name.replace("_", " "), _bag(name)
    ordered = " ".join(sorted(words.split(" ")))
    least = f"greatest(abs(size - {n}), bit_count(bag & {~bag}L), bit_count({bag}L & ~bag))"
    return f"""CASE WHEN {least} <= greatest(size, {n}) * {1.0 - spec.threshold / 100.0!r}D
        THEN 100D * (1D - least(levenshtein({_text(words)}, plain), levenshtein({_text(ordered)}, sorted))
                          / CAST(greatest(size, {n}) AS DOUBLE)) END"""


def _fit_sql(i: int, name: str, spec: MatchSpec) -> str:
    """How well the row's header fits one field: (stage, grade) or NULL.

    Stage 4 alias, 3 special rule, 2 hints, 1 fuzzy; the grade orders headers within a stage.
    """

    def fit(stage: int, grade: str) -> str:
        return f"named_struct('stage', {stage}, 'grade', CAST({grade} AS DOUBLE))"

    def holds(word: str) -> str:
        return f"contains(norm, {_text(word)})"

    rules = []
    aliases = [alias for alias, target in spec.aliases.items() if target == name]
    if aliases:
        rules.append((f"norm IN ({', '.join(map(_text, aliases))})", fit(4, "0")))
    rules += [(f"NOT {holds(f)}", "NULL") for f in spec.families if f in name]
    if name in spec.special:
        must, second = spec.special[name]
        rules.append((holds(must), fit(3, f"IF({holds(second)}, 0, 1)")))
    if name in spec.hints:
        found = " + ".join(f"CAST({holds(h)} AS INT)" for h in spec.hints[name])
        rules.append((f"{found} > 0", fit(2, found)))
    rules.append((f"z{i} >= {float(spec.threshold)!r}D", fit(1, f"z{i}")))
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in rules) + " END"


def header_dictionary(catalogue: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """``header, c0, c1, …``: how well each distinct header fits each field, stored.

    Spellings that normalise alike are scored once.
    """
    fields = list(enumerate(spec.fields))
    heads = catalogue.where(F.col("header").isNotNull()).select("header").distinct()
    heads = pin(heads.select("header", normalise_header("header").alias("norm")))
    spelled = _spell(heads.select("norm").distinct())
    graded = spelled.selectExpr("*", *[f"{_fuzzy_sql(name, spec)} AS z{i}" for i, name in fields])
    fitted = graded.selectExpr("norm", *[f"{_fit_sql(i, name, spec)} AS c{i}" for i, name in fields])
    return pin(heads.join(fitted, "norm").drop("norm"))


def match_headers(catalogue: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """One row per file and field: the chosen header (NULL when none fits), stage and grade.

    ``catalogue`` has columns ``file``, ``position``, ``header``. One header may serve several
    fields; an alias that points nowhere does not take its header out of the later stages.
    """
    fields = list(enumerate(spec.fields))
    dictionary = header_dictionary(catalogue, spec)
    listed = catalogue.select("file", "position", "header")
    fitted = lookup_join(listed, dictionary, ["header"], rows=dictionary.count())
    # Ordered by stage, then grade, then the earliest header.
    full = "named_struct('stage', {0}.stage, 'grade', {0}.grade, 'early', -position, 'header', header)"
    scored = fitted.selectExpr(
        "file", *[f"CASE WHEN c{i} IS NOT NULL THEN {full.format(f'c{i}')} END AS c{i}" for i, _ in fields]
    )
    best = scored.groupBy("file").agg(
        *[F.max(f"c{i}").alias(f"c{i}") for i in range(len(spec.fields))]
    )
    slots = ", ".join(
        f"named_struct('field_order', {i}, 'field', {_text(name)}, 'header', c{i}.header, "
        f"'stage', c{i}.stage, 'grade', c{i}.grade)"
        for i, name in fields
    )
    names = " ".join(f"WHEN {stage} THEN '{text}'" for stage, text in _STAGES.items())
    return best.selectExpr("file", f"inline(array({slots}))").selectExpr(
        "file", "field_order", "field", "header", f"CASE stage {names} END AS matched_by", "grade"
    )


_STAGES = {4: "alias", 3: "special", 2: "hint", 1: "fuzzy"}


def mapping_of(matches: DataFrame, file: str) -> dict[str, str | None]:
    """The field -> header mapping of one file, ready for the cleaning plan."""
    rows = matches.where(F.col("file") == file).select("field_order", "field", "header")
    # One row per canonical field.
    return {r["field"]: r["header"] for r in rows.orderBy("field_order").collect()}
