"""Exact medians without sorting everything or holding all values in one place."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A column's remaining candidates are listed in one place only when there are at most this many.
FINAL_VALUES = 20_000
# The sketch's rank error is at most rows / _ACCURACY; the bracket reaches _MARGIN to either side.
_ACCURACY = 10_000
_MARGIN = 0.001
_SPREAD = 2 * _MARGIN + 4 / _ACCURACY
# One task merges the sketches of all others, which takes longer than making them if there are many.
_SKETCHES_PER_CORE = 2


@dataclass
class _Bracket:
    """Open interval known to hold the wanted ranks, how many values lie below and inside it, and
    sketched values just around the wanted ranks."""

    column: str
    ranks: tuple[int, ...]
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    ends: tuple[float, float] | None = None

    def inside(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > self.low)
        if self.high is not None:
            test = test & (c < self.high)
        return F.when(test, c)

    def around(self) -> list[float]:
        shares = [(r - self.below + 0.5) / self.size for r in self.ranks]
        return [max(0.0, shares[0] - _MARGIN), min(1.0, shares[-1] + _MARGIN)]

    def holds(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.size


def exact_medians(
    df: DataFrame, columns: Sequence[str], final_values: int = FINAL_VALUES
) -> dict[str, float | None]:
    """Median of each double column (mean of the middle two), NULLs ignored, None when all NULL."""
    middle = lambda n: ((n - 1) // 2,) if n % 2 else (n // 2 - 1, n // 2)
    found = exact_ranks(df, columns, 0.5, middle, final_values)
    return {c: sum(found[c]) / len(found[c]) if found[c] else None for c in columns}


def exact_ranks(
    df: DataFrame, columns: Sequence[str], share: float, ranks_of: Callable[[int], Sequence[int]],
    final_values: int = FINAL_VALUES,
) -> dict[str, list[float]]:
    """The values at ``ranks_of(n)`` among the n values of each double column, which lie near ``share``.

    Ranks count from 0 and ascend; NULLs are ignored. Every step is a single aggregation over all columns
    at once, combined map-side. Sketch quantiles bracket the ranks; exact counts below, at and between
    the bracket ends say which side holds a wanted rank, so the sketch only affects how fast the bracket
    shrinks, never the answer. Two passes settle columns of up to a few million values, three or four
    any size.
    """
    if not columns:
        return {}
    around = [max(0.0, share - _MARGIN), min(1.0, share + _MARGIN)]
    # Partitions are merged, never added; every core still has sketches to make.
    sketched = df.coalesce(_SKETCHES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    first = sketched.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, around, _ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    found: dict[tuple[str, int], float] = {}
    wanted = {c: tuple(ranks_of(first[f"n{i}"])) if first[f"n{i}"] else () for i, c in enumerate(columns)}
    brackets = [
        _Bracket(c, wanted[c], first[f"n{i}"], ends=tuple(first[f"q{i}"])) for i, c in enumerate(columns) if wanted[c]
    ]
    while brackets:
        brackets = _settle(df, brackets, found, final_values)
        stuck = [b for b in brackets if b.size > final_values]
        if stuck:
            row = sketched.agg(
                *[F.percentile_approx(b.inside(), b.around(), _ACCURACY) for b in stuck]
            ).first()
            for b, ends in zip(stuck, row, strict=True):
                b.ends = tuple(ends)
    return {c: [found[c, r] for r in ranks] for c, ranks in wanted.items()}


def _settle(
    df: DataFrame, brackets: list[_Bracket], found: dict, final_values: int
) -> list[_Bracket]:
    """One pass: place the wanted ranks, read off those that can be, return what is left."""
    aggs = []
    for i, b in enumerate(brackets):
        c = b.inside()
        if b.size <= final_values:
            aggs.append(F.sort_array(F.collect_list(c)).alias(f"all{i}"))
            continue
        low, high = b.ends
        between = F.when((c > low) & (c < high), c)
        aggs += [
            F.count_if(c < low).alias(f"a{i}"),
            F.count_if(c == low).alias(f"b{i}"),
            F.count(between).alias(f"c{i}"),
            F.count_if((c == high) & F.lit(high > low)).alias(f"d{i}"),
        ]
        # The sketch bounds how many values can lie strictly between its two ends.
        if b.size * _SPREAD <= final_values:
            aggs.append(F.sort_array(F.collect_list(between)).alias(f"mid{i}"))
    row = df.agg(*aggs).first().asDict()
    rest: list[_Bracket] = []
    for i, b in enumerate(brackets):
        if f"all{i}" in row:
            found.update({(b.column, r): row[f"all{i}"][r - b.below] for r in b.ranks})
            continue
        low, high = b.ends
        sizes = [row[f"{s}{i}"] for s in "abcd"]
        limits = [(b.low, low), (low, low), (low, high), (high, high), (high, b.high)]
        start = b.below
        for k, size in enumerate([*sizes, b.size - sum(sizes)]):
            part = _Bracket(b.column, (), size, start, *limits[k])
            ranks = tuple(r for r in b.ranks if part.holds(r))
            if ranks and k in (1, 3):
                found.update({(b.column, r): part.low for r in ranks})
            elif ranks and k == 2 and f"mid{i}" in row:
                found.update({(b.column, r): row[f"mid{i}"][r - start] for r in ranks})
            elif ranks:
                part.ranks = ranks
                rest.append(part)
            start += size
    return rest
