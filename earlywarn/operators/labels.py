"""Prospective labels: does a bad event follow within the horizon?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import half_year_index, named, normalise_status
from earlywarn.operators.ordered import MAX_GROUP_ROWS, next_name, with_followers, with_next_event
from earlywarn.presets import COMPLETED_STATUSES, DROPOUT_STATUSES


@dataclass(frozen=True)
class LabelSpec:
    entity: str = "codigo_aluno"
    year: str = "ano_referencia"
    half: str = "periodo_referencia"
    status: str = "situacao"
    # Ready-made integer time column; when set, year and half are not used.
    time: str | None = None
    # Columns that put rows of one entity and one time in a fixed order; by default a hash of the
    # whole row, which is stable and keeps even one crowded moment divisible.
    tie: tuple[str, ...] = ()
    events: tuple[str, ...] = tuple(DROPOUT_STATUSES)
    terminals: tuple[str, ...] = tuple(DROPOUT_STATUSES + COMPLETED_STATUSES)
    horizon: int = 2
    label: str = "target_evasao"
    valid: str = "is_target_valid"
    # Also require that some later row exists before a row may be used for training.
    require_observed_future: bool = False
    max_group_rows: int | None = MAX_GROUP_ROWS

    @property
    def needed(self) -> list[str]:
        when = [self.time] if self.time else [self.year, self.half]
        return [self.entity, *when, self.status]


def _check(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns needed for the label are missing: {missing}")


def label_future_events(df: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """Add the label (1.0 / 0.0) and the validity flag.

    A row is positive when one of the entity's next ``horizon`` rows is an event at most ``horizon``
    time steps away. A row is valid unless its own status already ends the history.
    """
    _check(df, spec.needed)
    status = normalise_status(spec.status)
    when = F.col(spec.time) if spec.time else half_year_index(spec.year, spec.half)
    marked = df.withColumns(
        {"_t": when, "_event": F.coalesce(status.isin(list(spec.events)), F.lit(False))}
    )
    order = [spec.time] if spec.time else [spec.year, spec.half]
    if not spec.tie:
        marked = marked.withColumn("_tie", F.xxhash64(*[named(c) for c in df.columns]))
    ahead = with_followers(
        marked, [spec.entity], [*order, *(spec.tie or ("_tie",))], ["_t", "_event"], spec.horizon,
        spec.max_group_rows,
    )
    hits = [
        F.col(next_name("_event", k))
        & (F.col(next_name("_t", k)) - F.col("_t") <= F.lit(spec.horizon))
        for k in range(1, spec.horizon + 1)
    ]
    hit = reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])
    valid = ~F.coalesce(status.isin(list(spec.terminals)), F.lit(False))
    if spec.require_observed_future:
        valid = valid & F.col(next_name("_t", 1)).isNotNull()
    out = ahead.withColumns({spec.label: hit.cast("double"), spec.valid: valid})
    return out.select(*[named(c) for c in [*df.columns, spec.label, spec.valid]])


def label_time_range(df: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """The label by time alone: any event in (t, t + horizon], however many rows lie between.

    That is so when the entity's next event after the row is near enough. One pass over each history,
    backwards, finds it for every row; long histories are cut into ranges.
    """
    _check(df, spec.needed)
    status = normalise_status(spec.status)
    when = F.col(spec.time) if spec.time else half_year_index(spec.year, spec.half)
    marked = df.withColumns({
        "_t": when.cast("bigint"),
        "_event": F.coalesce(status.isin(list(spec.events)), F.lit(False)),
        "_tie": F.xxhash64(*[named(c) for c in spec.tie or df.columns]),
    })
    ahead = with_next_event(marked, spec.entity, "_t", "_event", "_next", ["_tie"], spec.max_group_rows)
    near = F.coalesce(F.col("_next") - F.col("_t") <= spec.horizon, F.lit(False))
    valid = ~F.coalesce(status.isin(list(spec.terminals)), F.lit(False))
    out = ahead.withColumns({spec.label: near.cast("double"), spec.valid: valid})
    return out.select(*[named(c) for c in [*df.columns, spec.label, spec.valid]])
