"""Dataset profiling, label statistics and drift between two batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import named
from earlywarn.operators.encoders import long_form
from earlywarn.operators.quantiles import exact_medians
from earlywarn.presets import BOOLEAN_TOKENS

HIGH_MISSING = 0.3
_INTEGER = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d{1,3}(\.\d{3})+,\d*|\d+[.,]\d*|[.,]\d+|\d+)$"
_ADVICE = {
    "int": "convert to a number; impute with the median",
    "float": "parse the decimal comma; impute with the median",
    "boolean_like": "map yes/no to 1/0",
    "categorical_string": "one-hot when there are few values, target encoding when many",
    "empty": "drop",
}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def missing_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, missing, fraction), all columns in a single pass."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(named(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select("rows", F.inline(pairs)).select(
        "column", "rows", "missing",
        F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0)).alias("fraction"),
    )


def high_missing(df: DataFrame, cut: float = HIGH_MISSING) -> DataFrame:
    return (
        missing_fractions(df)
        .where(F.col("fraction") > cut)
        .orderBy(F.desc("fraction"), "column")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, NULL being a value."""
    return df.groupBy(named(column).alias("value")).agg(F.count("*").alias("n"))


def distinct_counts(
    df: DataFrame, columns: Sequence[str], limit: int = 20
) -> dict[str, tuple[int, bool]]:
    """Distinct non-null values per column, and whether there are at most ``limit``; always exact.

    The values are made distinct map-side first; one count per column comes back.
    """
    if not columns:
        return {}
    exact = (
        long_form(df, columns).where(F.col("value").isNotNull()).distinct()
        .groupBy("feature").count().collect()
    )
    counts = {r["feature"]: r["count"] for r in exact}
    return {c: (counts.get(c, 0), counts.get(c, 0) <= limit) for c in columns}


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """One row per column: nulls, distinct values, inferred type, most frequent values, advice.

    The table is reduced to (column, value, count) once, combined map-side; everything else runs on
    that reduction.
    """
    columns = list(columns or df.columns)
    counts = long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    yes_no = F.lower("value").isin(list(BOOLEAN_TOKENS))
    summary = counts.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("_known"),
        F.coalesce(F.sum(F.when(F.col("value").rlike(_INTEGER), F.col("n"))), F.lit(0)).alias("_int"),
        F.coalesce(F.sum(F.when(F.col("value").rlike(_FLOAT), F.col("n"))), F.lit(0)).alias("_float"),
        F.coalesce(F.sum(F.when(yes_no, F.col("n"))), F.lit(0)).alias("_yes_no"),
    )
    kind = (
        F.when(F.col("_known") == 0, "empty")
        .when(F.col("_yes_no") == F.col("_known"), "boolean_like")
        .when(F.col("_int") == F.col("_known"), "int")
        .when(F.col("_float") == F.col("_known"), "float")
        .otherwise("categorical_string")
    )
    # The rank filter is applied before the shuffle too, so a column with very many values sends
    # only its best few from each task.
    # NULL ranks last instead of being filtered first, so that both uses share one reduction.
    w = Window.partitionBy("feature").orderBy(~known, F.desc("n"), F.asc("value"))
    best = (
        counts.withColumn("_rank", F.row_number().over(w))
        .where((F.col("_rank") <= top) & known)
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "value", "n"))).alias("_best"))
    )
    shown = F.concat_ws(
        " | ",
        F.transform("_best", lambda b: F.concat(b["value"], F.lit(": "), b["n"].cast("string"))),
    )
    advice = F.lit(None).cast("string")
    for name, text in _ADVICE.items():
        advice = F.when(F.col("inferred_type") == name, F.lit(text)).otherwise(advice)
    return (
        summary.withColumn("inferred_type", kind)
        .join(best, "feature", "left")
        .select(
            F.col("feature").alias("column"), "rows", "nulls",
            (F.col("nulls") / F.col("rows")).alias("null_share"),
            "distinct_values", "inferred_type",
            F.coalesce(shown, F.lit("")).alias("top_values"), advice.alias("recommendation"),
        )
    )


def label_stats(df: DataFrame, label: str = "target_evasao", valid: str = "is_target_valid") -> DataFrame:
    ok = F.coalesce(F.col(valid), F.lit(False))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(ok).alias("valid"),
        F.count_if(ok & (F.col(label) == 1)).alias("positive"),
    ).select(
        "rows", "valid", "positive",
        F.try_divide("valid", "rows").alias("valid_share"),
        F.try_divide("positive", "valid").alias("positive_share"),
    )


def category_drift(
    before: DataFrame, after: DataFrame, columns: Sequence[str], floor: float = 1e-6
) -> DataFrame:
    """Shares per (column, value) in two batches, their difference and the PSI contribution.

    NULL is a value here, so missing rates drift too. Both batches are counted in one aggregation,
    without a join.
    """
    both = before.select(*columns, F.lit(True).alias("_old")).unionByName(
        after.select(*columns, F.lit(False).alias("_old"))
    )
    counts = long_form(both, columns, ["_old"]).groupBy("feature", "value").agg(
        F.count_if("_old").alias("n_before"), F.count_if(~F.col("_old")).alias("n_after")
    )
    totals = both.agg(F.count_if("_old").alias("a"), F.count_if(~F.col("_old")).alias("b"))
    a = F.coalesce(F.try_divide("n_before", totals.select("a").scalar()), F.lit(0.0))
    b = F.coalesce(F.try_divide("n_after", totals.select("b").scalar()), F.lit(0.0))
    shares = counts.select(
        F.col("feature").alias("column"), F.col("value").isNull().alias("missing"),
        F.coalesce("value", F.lit("")).alias("value"),
        a.alias("share_before"), b.alias("share_after"),
    )
    p, q = F.greatest("share_before", F.lit(floor)), F.greatest("share_after", F.lit(floor))
    return shares.withColumns(
        {"change": F.col("share_after") - F.col("share_before"), "psi": (q - p) * F.log(q / p)}
    )


def numeric_drift(
    before: DataFrame, after: DataFrame, columns: Sequence[str], label: str | None = None
) -> DataFrame:
    """Mean, median, deviation and missing rate per column in two batches; the label rate is one of
    them."""
    names = [*columns, *([label] if label else [])]

    def stats(df: DataFrame, suffix: str) -> DataFrame:
        numbers = df.select(*[named(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
        medians = exact_medians(numbers, numbers.columns)
        aggs = []
        for i in range(len(names)):
            x = F.col(f"_x{i}")
            aggs += [F.avg(x).alias(f"_a{i}"), F.stddev_pop(x).alias(f"_s{i}"),
                     F.avg(x.isNull().cast("double")).alias(f"_m{i}")]
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.col(f"_a{i}").alias(f"mean_{suffix}"),
                    F.lit(medians[f"_x{i}"]).cast("double").alias(f"median_{suffix}"),
                    F.col(f"_s{i}").alias(f"std_{suffix}"), F.col(f"_m{i}").alias(f"missing_{suffix}"),
                )
                for i, c in enumerate(names)
            ]
        )
        return numbers.agg(*aggs).select(F.inline(rows))

    # One row per column on either side.
    both = stats(before, "before").join(stats(after, "after"), "column")
    shift = F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("std_before"))
    return both.withColumn("shift", shift)


def distribution_drift(
    before: DataFrame, after: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-6
) -> DataFrame:
    """How far each number's distribution moved: PSI, largest gap, and the shares beyond the earlier range.

    The earlier batch sets the bins: ``bins`` of equal width from its least to its greatest value, one
    below, one above and one for missing values (NULL and NaN). Both batches then pass one flagged scan
    into one histogram, whose counts add up, so it can be merged with those of other batches. ``psi``
    sums over all bins with shares of at least ``floor``; ``largest_gap`` is the largest difference of
    the cumulated shares of present values at the bins' ends. A column without a value in the earlier
    batch has a single bin for whatever comes; a batch without rows has shares of zero.
    """
    names = list(columns)

    def numbers(df: DataFrame, old: bool) -> DataFrame:
        xs = [F.nanvl(named(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(names)]
        return df.select(F.lit(old).alias("_old"), *xs)

    both = numbers(before, True).unionByName(numbers(after, False))
    edges = both.where("_old").agg(
        *[F.min(f"_x{i}").alias(f"lo{i}") for i in range(len(names))],
        *[F.max(f"_x{i}").alias(f"hi{i}") for i in range(len(names))],
    ).first()

    def bin_of(i: int) -> Column:
        x, lo, hi = F.col(f"_x{i}"), edges[f"lo{i}"], edges[f"hi{i}"]
        if lo is None:
            return F.when(x.isNull(), -1).otherwise(bins + 1)
        inside = F.lit(1)
        if hi > lo:
            inside = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("int") + 1
        return F.when(x.isNull(), -1).when(x < lo, 0).when(x > hi, bins + 1).otherwise(inside)

    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), bin_of(i).alias("bin")) for i in range(len(names))])
    histogram = both.select("_old", F.inline(pairs)).groupBy("_i", "bin").agg(
        F.count_if("_old").alias("n_before"), F.count_if(~F.col("_old")).alias("n_after")
    )
    # From here on, bins + 3 rows a column at most.
    every = Window.partitionBy("_i")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.when(F.col("bin") >= 0, 1).otherwise(0)
    shares = {}
    for side in ("before", "after"):
        n = F.col(f"n_{side}")
        shares[f"p_{side}"] = F.coalesce(F.try_divide(n, F.sum(n).over(every)), F.lit(0.0))
        shares[f"c_{side}"] = F.coalesce(
            F.try_divide(F.sum(n * shown).over(upto), F.sum(n * shown).over(every)), F.lit(0.0)
        )
    p, q = F.greatest("p_before", F.lit(floor)), F.greatest("p_after", F.lit(floor))
    beyond = F.col("bin").isin(0, bins + 1)
    out = histogram.withColumns(shares).groupBy("_i").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"), F.max(F.abs(F.col("c_after") - F.col("c_before"))).alias("largest_gap"),
        F.sum(F.when(beyond, F.col("p_after")).otherwise(0.0)).alias("beyond"),
        F.sum(F.when(F.col("bin") == -1, F.col("p_before")).otherwise(0.0)).alias("missing_before"),
        F.sum(F.when(F.col("bin") == -1, F.col("p_after")).otherwise(0.0)).alias("missing_after"),
    )
    listed = F.array(*map(F.lit, names))
    return out.select(F.get(listed, F.col("_i")).alias("column"), "psi", "largest_gap", "beyond", "missing_before", "missing_after")
