"""Model quality measures as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.operators.ranking import score_steps


def score_bucket(p: Column | str, buckets: int) -> Column:
    """Equal-width bucket 1..n on [0, 1]; a score of exactly one belongs to the last bucket."""
    col = F.col(p) if isinstance(p, str) else p
    raw = F.width_bucket(col, F.lit(0.0), F.lit(1.0), F.lit(buckets))
    return F.least(raw, F.lit(buckets).cast("bigint"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights of the binary classes that occur: n / (classes * n of the class)."""
    y = F.col(label).cast("int")
    counts = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    rows = counts.select(
        (F.col("n0") + F.col("n1")).alias("total"),
        ((F.col("n0") > 0).cast("int") + (F.col("n1") > 0).cast("int")).alias("classes"),
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("n")) for k in (0, 1)]
            )
        ),
    )
    weight = F.col("total").cast("double") / (F.col("classes") * F.col("n"))
    return rows.where("n > 0").select("label", "n", weight.alias("weight"))


def _won_pairs() -> Column:
    # Pairs (positive, negative) the score puts in the right order, ties as a half.
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    return F.sum(pos * (F.col("neg_upto") - neg + neg / F.lit(2.0)))


def _auc() -> Column:
    pairs = F.first("pos_all").cast("double") * F.first("neg_all")
    return F.try_divide(_won_pairs(), F.when(pairs != 0, pairs))


def _average_precision() -> Column:
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    total = F.first("pos_all")
    gained = F.sum((F.col("pos") * tp / (tp + fp)).cast("double"))
    return F.try_divide(gained, F.when(total != 0, total))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL when a class is absent."""
    return score_steps(df, score, label).agg(
        _auc().alias("roc_auc"),
        F.coalesce(F.first("pos_all"), F.lit(0)).alias("positives"),
        F.coalesce(F.first("neg_all"), F.lit(0)).alias("negatives"),
    )


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall curve, by average precision over distinct scores."""
    return score_steps(df, score, label).agg(_average_precision().alias("pr_auc"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean squared error of the scores beside that of always predicting the base rate."""
    y = F.col(label).cast("double")
    base = F.avg(y)
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(
        F.avg(F.pow(F.col(score) - y, F.lit(2.0))).alias("brier"),
        (base * (F.lit(1.0) - base)).alias("brier_base"),
        base.alias("base_rate"),
    )


def reliability(df: DataFrame, score: str, label: str, buckets: int = 10) -> DataFrame:
    return (
        df.groupBy(score_bucket(score, buckets).alias("bucket"))
        .agg(
            F.avg(score).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("observed"),
            F.count("*").alias("n"),
        )
    )


def score_histogram(
    df: DataFrame, score: str, buckets: int = 30, by: str | None = None
) -> DataFrame:
    """Counts per bucket, per class when ``by`` names the label."""
    keys = [F.col(by)] if by else []
    return df.groupBy(*keys, score_bucket(score, buckets).alias("bucket")).agg(
        F.count("*").alias("n")
    )


def _top_share(tiles: int) -> dict[str, Column]:
    """Measures of the best-scored 1/``tiles`` of the rows, as aggregations of a score ladder."""
    n = F.col("pos") + F.col("neg")
    total = F.col("pos_all") + F.col("neg_all")
    above = total - (F.col("pos_upto") + F.col("neg_upto"))
    size = F.ceil(total / F.lit(float(tiles)))
    taken = F.greatest(F.least(size - above, n), F.lit(0))
    hits, rows = F.sum(F.col("pos") * taken / n), F.sum(taken)
    base = F.first("pos_all") / (F.first("pos_all") + F.first("neg_all"))
    return {
        "top_rows": rows.cast("bigint"),
        "top_rate": F.try_divide(hits, rows).cast("double"),
        "base_rate": base.cast("double"),
        "lift": F.try_divide(F.try_divide(hits, rows), base).cast("double"),
    }


def top_decile_lift(df: DataFrame, score: str, label: str, tiles: int = 10) -> DataFrame:
    """Share of positives among the best-scored 1/``tiles`` of the rows, against the base rate.

    The cut is exact. Rows that share the score at the cut count in proportion, so the result does
    not depend on how ties are ordered.
    """
    return score_steps(df, score, label).agg(*[c.alias(name) for name, c in _top_share(tiles).items()])


def rank_quality(df: DataFrame, score: str, label: str, tiles: int = 10) -> DataFrame:
    """ROC AUC, PR AUC, Brier score and top-share measures in one row, from one ladder of distinct scores."""
    p = F.col("score")
    error = F.col("pos") * F.pow(F.lit(1.0) - p, F.lit(2.0)) + F.col("neg") * p * p
    rows = F.sum("pos") + F.sum("neg")
    base = F.try_divide(F.sum("pos"), rows)
    return score_steps(df, score, label).agg(
        F.coalesce(F.first("pos_all"), F.lit(0)).alias("positives"),
        F.coalesce(F.first("neg_all"), F.lit(0)).alias("negatives"),
        _auc().alias("roc_auc"), _average_precision().alias("pr_auc"),
        F.try_divide(F.sum(error), rows).alias("brier_score"), (base * (F.lit(1.0) - base)).alias("brier_base_rate"),
        *[c.alias(name) for name, c in _top_share(tiles).items() if name != "base_rate"],
    )


def confusion(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Actual against predicted class; rows without a label do not count."""
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(
            F.col(label).cast("int").alias("actual"),
            (F.col(score) >= cut).cast("int").alias("predicted"),
        )
        .agg(F.count("*").alias("n"))
    )


def holdout_metrics(df: DataFrame, score: str, label: str) -> dict[str, float | None]:
    """All hold-out measures from one reduction to distinct scores."""
    row = rank_quality(df, score, label).select("roc_auc", "pr_auc", "brier_score", "brier_base_rate")
    return row.first().asDict()
