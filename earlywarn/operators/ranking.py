"""Running totals over a score order, without a window that holds the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.session import pin

MAX_RANGES = 2000


def _range_bounds(df: DataFrame, order: str, ranges: int) -> list[float]:
    if ranges <= 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(order, shares, 0.5 / ranges)))


def running_totals(
    df: DataFrame, order: str, values: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add ``{v}_upto`` (inclusive, ascending ``order``) and ``{v}_all`` for every value column.

    ``df`` must hold each ``order`` value once (aggregate first). The order is cut into ranges of
    about equal row counts; each range is summed in its own task and shifted by the totals of the
    ranges before it, of which there are at most ``MAX_RANGES``.
    """
    if ranges is None:
        ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    bounds = _range_bounds(df, order, ranges)
    if bounds:
        edges = [float("-inf"), *bounds, float("inf")]
        cut = Bucketizer(splits=edges, inputCol=order, outputCol="_range").transform(df)
    else:
        cut = df.withColumn("_range", F.lit(0.0))
    sums = cut.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # At most len(bounds) + 1 rows: one task and a broadcast are safe.
    shifts = sums.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_shift_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"{v}_all") for v in values],
    )
    inside = Window.partitionBy("_range").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(F.broadcast(shifts), "_range").withColumns(
        {f"{v}_upto": F.sum(v).over(upto) + F.col(f"_shift_{v}") for v in values}
    )
    return out.select(*df.columns, *[f"{v}_upto" for v in values], *[f"{v}_all" for v in values])


def score_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with their positives and negatives, and running totals of both. Rows without a
    score or a label do not count.

    The reduction is stored once: cutting it into ranges, the ranges' totals and the running totals
    read what is stored, so the scores themselves are read, and computed, a single time.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    steps = (
        df.where(usable & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(label).cast("bigint")).alias("pos"),
            F.sum(F.lit(1) - F.col(label).cast("bigint")).alias("neg"),
        )
    )
    return running_totals(pin(steps), "score", ["pos", "neg"])
