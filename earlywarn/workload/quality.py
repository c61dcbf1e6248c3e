"""Model quality measures on a deterministic score of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.functions import class_at, risk_level
from earlywarn.operators.calibration import ISOTONIC, SIGMOID, fit_calibrator, sigmoid_input
from earlywarn.operators.filters import label_counts
from earlywarn.operators.metrics import (
    brier,
    confusion,
    pr_auc,
    rank_quality,
    reliability,
    roc_auc,
    score_histogram,
    top_decile_lift,
)
from earlywarn.workload.registry import query, r6, table

# A score with ties: prices in steps of 500 on [0, 1].
_SCORED = """scored AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
  round(o_totalprice / 500) / 1000e0 AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)"""


def scored_orders(spark, sf_dir):
    p = F.round(F.col("o_totalprice") / 500) / F.lit(1000.0)
    y = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), y.alias("y"))


@query(
    "auc_exact",
    f"""WITH {_SCORED},
r AS (SELECT y, rank() OVER (ORDER BY p) AS lo, count(*) OVER (PARTITION BY p) AS k FROM scored),
a AS (SELECT sum(CASE WHEN y = 1 THEN lo + (k - 1) / 2e0 END) AS s,
             CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM r)
SELECT round((s - np * (np + 1) / 2e0) / nullif(np * nn, 0), 6) AS roc_auc,
       CAST(np AS BIGINT) AS positives, CAST(nn AS BIGINT) AS negatives FROM a""",
)
def auc_exact(spark, sf_dir):
    df = roc_auc(scored_orders(spark, sf_dir), "p", "y")
    return df.select(r6("roc_auc").alias("roc_auc"), "positives", "negatives")


@query(
    "auc_one_class",
    "SELECT CAST(NULL AS DOUBLE) AS roc_auc, count(*) AS positives FROM orders WHERE o_orderstatus = 'F'",
)
def auc_one_class(spark, sf_dir):
    return roc_auc(scored_orders(spark, sf_dir).where("y = 1"), "p", "y").select("roc_auc", "positives")


@query(
    "pr_auc",
    f"""WITH {_SCORED},
g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g
      WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(pos * (tp / CAST(k AS DOUBLE))) / sum(pos), 6) AS pr_auc FROM c""",
)
def average_precision(spark, sf_dir):
    return pr_auc(scored_orders(spark, sf_dir), "p", "y").select(r6("pr_auc").alias("pr_auc"))


@query(
    "brier",
    f"""WITH {_SCORED} SELECT round(avg((p - y) * (p - y)), 6) AS brier,
  round(avg(y) * (1e0 - avg(y)), 6) AS brier_base, round(avg(y), 6) AS base_rate FROM scored""",
)
def brier_scores(spark, sf_dir):
    df = brier(scored_orders(spark, sf_dir), "p", "y")
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query(
    "reliability",
    f"""WITH {_SCORED} SELECT CAST(least(floor(p * 10) + 1, 10) AS BIGINT) AS bucket,
  round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed, count(*) AS n FROM scored GROUP BY 1""",
)
def reliability_curve(spark, sf_dir):
    df = reliability(scored_orders(spark, sf_dir), "p", "y")
    return df.select("bucket", r6("mean_score").alias("mean_score"), r6("observed").alias("observed"), "n")


@query(
    "score_hist",
    f"WITH {_SCORED} SELECT CAST(least(floor(p * 30) + 1, 30) AS BIGINT) AS bucket, count(*) AS n FROM scored GROUP BY 1",
)
def score_hist(spark, sf_dir):
    return score_histogram(scored_orders(spark, sf_dir), "p")


@query(
    "score_hist_by_class",
    f"""WITH {_SCORED} SELECT CAST(y AS BIGINT) AS y, CAST(least(floor(p * 30) + 1, 30) AS BIGINT) AS bucket,
  count(*) AS n FROM scored GROUP BY ALL""",
)
def score_hist_by_class(spark, sf_dir):
    df = score_histogram(scored_orders(spark, sf_dir), "p", by="y")
    return df.withColumn("y", F.col("y").cast("bigint"))


@query(
    "decile_lift",
    f"""WITH {_SCORED},
g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p),
c AS (SELECT pos, n, coalesce(sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS above, ceil(sum(n) OVER () / 10e0) AS size, sum(pos) OVER () / CAST(sum(n) OVER () AS DOUBLE) AS base FROM g),
t AS (SELECT pos, n, base, greatest(least(size - above, n), 0) AS taken FROM c)
SELECT CAST(sum(taken) AS BIGINT) AS top_rows, round(sum(pos * taken / CAST(n AS DOUBLE)) / sum(taken), 6) AS top_rate,
  round(max(base), 6) AS base_rate, round(sum(pos * taken / CAST(n AS DOUBLE)) / sum(taken) / max(base), 6) AS lift
FROM t""",
)
def decile_lift(spark, sf_dir):
    df = top_decile_lift(scored_orders(spark, sf_dir), "p", "y")
    return df.select("top_rows", *[r6(c).alias(c) for c in ("top_rate", "base_rate", "lift")])


@query(
    "rank_quality",
    f"""WITH {_SCORED},
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS k, sum(pos) OVER () AS np, sum(neg) OVER () AS nn,
        sum(neg) OVER w - neg AS neg_above FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, greatest(least(ceil((np + nn) / 10e0) - (k - pos - neg), pos + neg), 0) AS taken FROM c)
SELECT CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives,
  round(1 - sum(CAST(pos AS DOUBLE) * (neg_above + neg / 2e0)) / (max(np) * CAST(max(nn) AS DOUBLE)), 6) AS roc_auc,
  round(sum(pos * (tp / CAST(k AS DOUBLE))) / max(np), 6) AS pr_auc,
  round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg), 6) AS brier_score,
  round(sum(taken * pos / CAST(pos + neg AS DOUBLE)) / sum(taken) / (max(np) / CAST(max(np) + max(nn) AS DOUBLE)), 6) AS lift
FROM t""",
)
def rank_quality_(spark, sf_dir):
    df = rank_quality(scored_orders(spark, sf_dir), "p", "y")
    return df.select("positives", "negatives", *[r6(c).alias(c) for c in ("roc_auc", "pr_auc", "brier_score", "lift")])


@query(
    "isotonic_calibrator",
    f"""WITH {_SCORED},
g AS (SELECT p, avg(y) AS y, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY p),
c AS (SELECT p, row_number() OVER w AS i, sum(n * y) OVER w AS s, sum(n) OVER w AS k FROM g
      WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
z AS (SELECT i, p, s, k, lag(s, 1, 0) OVER (ORDER BY i) AS s0, lag(k, 1, 0) OVER (ORDER BY i) AS k0 FROM c),
m AS (SELECT a.i AS a, b.i AS i, b.p, min((b.s - a.s0) / (b.k - a.k0)) OVER (
        PARTITION BY a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS low FROM z a JOIN z b ON b.i >= a.i)
SELECT round(p, 6) AS score, round(max(low), 6) AS calibrated FROM m GROUP BY p""",
)
def isotonic_calibrator(spark, sf_dir):
    rows = scored_orders(spark, sf_dir).select(F.col("p").alias("_p"), "y")
    fitted = fit_calibrator(rows, "y", ISOTONIC)
    out = fitted.transform(rows.select("_p").distinct())
    return out.select(r6("_p").alias("score"), r6("_cal").alias("calibrated"))


@query(
    "sigmoid_calibrator",
    f"""WITH {_SCORED} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, TRUE AS optimal, TRUE AS rising
FROM scored""",
)
def sigmoid_calibrator(spark, sf_dir):
    """Fitted on scores down to 1e-7; at the optimum the likelihood of all rows has no slope left."""
    tiny = F.pow(F.lit(10.0), F.col("p") * 6.5 - 7.0)
    rows = scored_orders(spark, sf_dir).select(F.least(tiny, F.lit(1.0)).alias("_p"), "y")
    slope, intercept = fit_calibrator(rows, "y", SIGMOID)
    x = sigmoid_input(F.col("_p"))
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (n - pos + 2.0)
    gap = F.when(F.col("y") == 1, high).otherwise(low) - 1.0 / (1.0 + F.exp(-(x * slope + intercept)))
    flat = (F.abs(F.avg(gap)) < 1e-4) & (F.abs(F.avg(gap * x)) < 1e-3)
    return rows.agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), flat.alias("optimal"),
        F.lit(slope != 0.0).alias("rising"),
    )


@query(
    "label_guard",
    f"""WITH {_SCORED} SELECT count_if(y = 0) AS negative, count_if(y = 1) AS positive,
  count_if(y IS NULL OR y NOT IN (0, 1)) AS other FROM scored""",
)
def label_guard(spark, sf_dir):
    return label_counts(scored_orders(spark, sf_dir), "y")


@query(
    "confusion",
    f"""WITH {_SCORED} SELECT CAST(y AS BIGINT) AS actual, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted,
  count(*) AS n FROM scored GROUP BY ALL""",
)
def confusion_matrix(spark, sf_dir):
    df = confusion(scored_orders(spark, sf_dir), "p", "y")
    return df.select(F.col("actual").cast("bigint").alias("actual"),
                     F.col("predicted").cast("bigint").alias("predicted"), "n")


@query(
    "class_and_level",
    f"""WITH {_SCORED} SELECT o_orderkey, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS class_pred,
  CASE WHEN p < 0.33 THEN 'Baixo' WHEN p < 0.66 THEN 'Médio' ELSE 'Alto' END AS risk_level FROM scored""",
)
def class_and_level(spark, sf_dir):
    return scored_orders(spark, sf_dir).select(
        "o_orderkey", class_at("p").cast("bigint").alias("class_pred"),
        risk_level("p").alias("risk_level"),
    )
