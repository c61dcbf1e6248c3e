"""Risk tables, key figures, top lists and importance roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import risk_label, risk_percent
from earlywarn.operators.filters import is_active
from earlywarn.operators.lookups import MAX_BROADCAST_ROWS, lookup_join
from earlywarn.operators.quantiles import exact_medians
from earlywarn.presets import ACTIVE_STATUS, DEFAULT_RISK_THRESHOLD, RISK_LABELS

SCORE = "prob_evasao"


def with_risk(
    df: DataFrame, score: str = SCORE, threshold: float = DEFAULT_RISK_THRESHOLD
) -> DataFrame:
    return df.withColumns(
        {"risk_pct": risk_percent(score), "risk_label": risk_label(score, threshold)}
    )


def key_figures(
    df: DataFrame,
    score: str = SCORE,
    status: str | None = "situacao",
    active: str = ACTIVE_STATUS,
    threshold: float = DEFAULT_RISK_THRESHOLD,
) -> DataFrame:
    """One row: totals, counts and percentages per risk label, active share, mean and median score."""
    median = exact_medians(df, [score])[score]
    label = risk_label(score, threshold)
    names = dict(zip(("low", "medium", "high"), RISK_LABELS, strict=True))
    has_status = status is not None and status in df.columns
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(label == text).alias(name) for name, text in names.items()],
        (F.count_if(is_active(status, active)) if has_status else F.lit(None).cast("bigint")).alias(
            "active"
        ),
        F.avg(score).alias("mean_score"),
    )

    def percent(name: str):
        return F.try_divide(F.col(name) * F.lit(100.0), F.col("total")).alias(f"{name}_pct")

    return counts.select(
        "total", "low", "medium", "high", "active",
        *[percent(n) for n in ("low", "medium", "high", "active")],
        "mean_score", F.lit(median).cast("double").alias("median_score"),
    )


def label_counts(df: DataFrame, label: str = "risk_label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def top_scored(df: DataFrame, keys: Sequence[str], n: int = 10, score: str = SCORE) -> DataFrame:
    """The n highest scores, ties by key. Each task keeps only its own best n."""
    return df.orderBy(F.col(score).desc_nulls_last(), *keys).limit(n)


def mean_importance(folds: DataFrame) -> DataFrame:
    """Average over folds (or runs) by feature, strongest first."""
    return (
        folds.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(F.abs("importance").desc(), "feature")
    )


def top_importance(df: DataFrame, n: int = 20, signed: bool = False) -> DataFrame:
    strength = F.col("importance") if signed else F.abs("importance")
    return df.orderBy(strength.desc(), "feature").limit(n)


def roll_up_sources(
    contributions: DataFrame,
    lineage: DataFrame,
    row: str | None = None,
    rows: DataFrame | None = None,
    value: str = "contribution",
) -> DataFrame:
    """Sum encoded-column values up to their source column.

    ``contributions`` is long (``row``, ``feature``, value); ``lineage`` says which source each
    encoded feature came from, one row per feature. ``rows`` lists all row ids: with it every
    (row, source) pair is present, a source without a contribution being 0.
    """
    keys = [row] if row else []
    features = lineage.limit(MAX_BROADCAST_ROWS + 1).count()
    joined = lookup_join(contributions, lineage, ["feature"], rows=features)
    parts = joined.where(F.col("source").isNotNull()).select(*keys, "source", value)
    if rows is not None:
        # Sources are columns of a table, so their list is short. Adding a zero for every pair keeps
        # it one shuffle, where an outer join would take two.
        sources = [r[0] for r in lineage.select("source").distinct().orderBy("source").collect()]
        zeros = rows.select(
            row, F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"),
            F.lit(0.0).alias(value),
        )
        parts = parts.unionByName(zeros)
    return parts.groupBy(*keys, "source").agg(F.sum(value).alias(value))
