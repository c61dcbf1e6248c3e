"""Categorical statistics and the adaptive encoder: one-hot for few values, smoothed means for many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import named
from earlywarn.operators.lookups import lookup_join
from earlywarn.session import pin


# Fixed value: what a missing category is called before it is encoded.
MISSING = "missing"


@dataclass(frozen=True)
class EncoderSpec:
    max_onehot: int = 20
    smoothing: float = 10.0
    min_samples_leaf: int = 20


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """One row per (row, column): ``feature``, ``value`` plus ``keep``. Narrow, no shuffle."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), named(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(pairs))


def category_counts(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(feature, value) -> n [, mean of the label]. Hot categories combine before the shuffle."""
    keep = [F.col(label).cast("double").alias("_y")] if label else []
    stats = [F.count("*").alias("n")]
    if label:
        stats.append(F.avg("_y").alias("mean"))
    return long_form(df, columns, keep).groupBy("feature", "value").agg(*stats)


def smoothed_mean(n: Column, mean: Column, prior: Column, spec: EncoderSpec) -> Column:
    """Sigmoid-weighted blend of a category's mean with the overall mean."""
    leaf, smoothing = F.lit(float(spec.min_samples_leaf)), F.lit(float(spec.smoothing))
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - leaf) / smoothing))
    return prior * (F.lit(1.0) - weight) + mean * weight


def target_encodings(
    df: DataFrame, columns: Sequence[str], label: str, spec: EncoderSpec = EncoderSpec()
) -> DataFrame:
    """(feature, value, n, mean, prior, encoded) for every category of every column.

    The rows are read once: the overall mean follows from the per-category sums, as every row has
    exactly one category (possibly NULL) in each column.
    """
    # The reduction is read twice below; materialised, it is not computed twice.
    stats = pin(category_counts(df, columns, label))
    one = stats.where(F.col("feature") == columns[0])
    prior = one.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    full = stats.withColumn("prior", prior)
    encoded = smoothed_mean(F.col("n"), F.col("mean"), F.col("prior"), spec)
    return full.withColumn("encoded", encoded)


def one_hot(column: Column, values: Sequence[str]) -> list[Column]:
    """0/1 doubles, one for each known value; an unknown value is all zeros."""
    return [F.coalesce((column == F.lit(v)).cast("double"), F.lit(0.0)) for v in values]


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted known values per column with their count."""
    return (
        category_counts(df, columns)
        .where(F.col("value").isNotNull())
        .orderBy("feature", "value")
    )


def one_hot_frame(df: DataFrame, column: str, spec: EncoderSpec = EncoderSpec()) -> DataFrame:
    """Append ``{column}_{value}`` for every known value of a column with few of them."""
    # At most max_onehot + 1 values come back; more than that is not a case for one-hot.
    known = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = [r[0] for r in known.limit(spec.max_onehot + 1).collect()]
    if len(values) > spec.max_onehot:
        raise ValueError(f"{column} has more than {spec.max_onehot} values")
    values.sort()
    flags = one_hot(F.col(column), values)
    return df.withColumns({f"{column}_{v}": c for v, c in zip(values, flags, strict=True)})


def encode_by_target(
    df: DataFrame, fitted_on: DataFrame, column: str, label: str, spec: EncoderSpec = EncoderSpec()
) -> DataFrame:
    """Append ``{column}_encoded``; values unseen in ``fitted_on`` get the overall mean.

    NULL is the value :data:`MISSING` on both sides, as in the feature pipeline.
    """
    filled = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    fitted = target_encodings(fitted_on.withColumn(column, filled), [column], label, spec)
    rows = fitted.count()
    prior = fitted.agg(F.first("prior")).scalar()
    table = fitted.select(
        F.col("value").alias("_filled"), F.col("encoded").alias(f"{column}_encoded")
    )
    joined = lookup_join(df.withColumn("_filled", filled), table, ["_filled"], rows=rows)
    encoded = F.coalesce(F.col(f"{column}_encoded"), prior)
    return joined.withColumn(f"{column}_encoded", encoded).drop("_filled")
