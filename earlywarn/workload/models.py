"""Training, calibration, search, saved models and batch scoring on labelled orders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from earlywarn.operators.calibration import (
    GBT,
    LOGREG,
    SIGMOID,
    ModelSpec,
    fit_ensemble,
    out_of_fold_scores,
)
from earlywarn.operators.features import FeatureSpec
from earlywarn.operators.filters import valid_labels
from earlywarn.operators.metrics import brier, roc_auc
from earlywarn.operators.report import with_risk
from earlywarn.plans.score import score
from earlywarn.plans.train import TrainSpec, search, train, training_rows, validate_holdout
from earlywarn.session import scratch_path
from earlywarn.sources.files import write_delimited
from earlywarn.sources.registry import importance_of, list_runs, load_model
from earlywarn.streaming.arrivals import run_files_with_model
from earlywarn.workload.features import ORDER_FEATURES, labelled_docs, order_inputs
from earlywarn.workload.labels import HASH_SQL, YEARS, labelled_orders
from earlywarn.workload.registry import LABELLED_ORDERS_SQL, query, r6

LOGREG_SPEC = ModelSpec(LOGREG, params=(("max_iter", 50),), folds=3)
GBT_SPEC = ModelSpec(GBT, params=(("n_estimators", 8), ("max_depth", 3)), folds=2)
SPEC = TrainSpec(
    year="year", half="half", keys=("o_orderkey",), features=ORDER_FEATURES, model=LOGREG_SPEC,
    split=YEARS,
)
DOC_FEATURES = FeatureSpec(
    numeric=("n_chars",), categorical=("source", "lang"), totals=(), shares=(),
    technical=("doc_id", "quality", "toxic"),
)


# Rows a model is trained on: with a usable label, in the years of the split if there is one.
_USED_SQL = f"""{LABELLED_ORDERS_SQL},
valid AS (SELECT * FROM labelled WHERE is_target_valid),
used AS (SELECT * FROM valid WHERE year BETWEEN 1995 AND 2000)"""


def _sound(p: str):
    """A probability, present and between 0 and 1."""
    return F.coalesce(F.col(p).between(0.0, 1.0), F.lit(False))


def training_orders(spark, sf_dir):
    return order_inputs(labelled_orders(spark, sf_dir))


def _held_sql(held: str) -> str:
    """Facts of the rows a run is measured on: how many, how many events, Brier score of the base rate."""
    return f"""held AS ({held}),
facts AS (SELECT count(*) AS n_held, CAST(coalesce(sum(target_evasao), 0) AS BIGINT) AS held_events,
  round(avg(target_evasao) * (1e0 - avg(target_evasao)), 6) AS brier_base_rate FROM held)"""


def _recomputed(spark, run):
    """The run's measures again, from the written scores of its later side: the Brier score row by row in
    SQL, the areas by Spark's own evaluator."""
    path = scratch_path(spark, "held-scores")
    run.validation.select("prob_evasao", "target_evasao").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("held_scores")
    row = spark.sql(
        """SELECT count(*) AS n, CAST(coalesce(sum(target_evasao), 0) AS BIGINT) AS events,
          avg((prob_evasao - target_evasao) * (prob_evasao - target_evasao)) AS brier FROM held_scores"""
    ).first()
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="prob_evasao", labelCol="target_evasao", metricName="areaUnderROC", numBins=0
    )
    return row, evaluator.evaluate(spark.table("held_scores"))


def _metrics(spark, run):
    """A run's record beside what SQL recomputes from the tables and from the written scores."""
    record, m = run.record, run.record["metrics"]
    row, area = _recomputed(spark, run)
    line = (
        record["model_type"], record["validation_strategy"].split("_")[0], record["n_samples"], row["n"],
        row["events"], round(m["brier_base_rate"], 6), abs(m["brier_score"] - row["brier"]) < 1e-9,
        abs(m["roc_auc"] - area) < 1e-9,
    )
    return spark.createDataFrame(
        [line],
        "model_type string, validation_strategy string, n_samples bigint, n_held bigint, held_events bigint, "
        "brier_base_rate double, same_brier boolean, same_auc boolean",
    )


@query(
    "train_logreg",
    f"""WITH {_USED_SQL}, {_held_sql("SELECT * FROM used WHERE year = 1999")}
SELECT 'logreg' AS model_type, 'configured' AS validation_strategy, (SELECT count(*) FROM used) AS n_samples, *,
  TRUE AS same_brier, TRUE AS same_auc FROM facts""",
)
def train_logreg(spark, sf_dir):
    return _metrics(spark, train(training_orders(spark, sf_dir), SPEC))


@query(
    "train_boosted",
    f"""WITH {_USED_SQL},
p AS (SELECT DISTINCT year * 10 + half AS t FROM valid),
c AS (SELECT t AS cutoff FROM (SELECT t, row_number() OVER (ORDER BY t DESC) AS k, count(*) OVER () AS n FROM p)
      WHERE k = CASE WHEN n >= 4 THEN 2 ELSE 1 END),
s AS (SELECT *, year * 10 + half >= (SELECT cutoff FROM c) AS late, count(*) OVER (PARTITION BY target_evasao) AS n,
        row_number() OVER (PARTITION BY target_evasao
          ORDER BY substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 13)) AS k FROM valid),
-- a side of fewer than fifty rows: a fifth of every class instead
w AS (SELECT least(count_if(late), count_if(NOT late)) >= 50 AS by_time FROM s),
{_held_sql("SELECT * FROM s WHERE CASE WHEN (SELECT by_time FROM w) THEN late ELSE k <= round(n / 5e0) END")}
SELECT 'gbt' AS model_type, 'automatic' AS validation_strategy, (SELECT count(*) FROM valid) AS n_samples, *,
  TRUE AS same_brier, TRUE AS same_auc FROM facts""",
)
def train_boosted(spark, sf_dir):
    spec = replace(SPEC, model=GBT_SPEC, split=None)
    return _metrics(spark, train(training_orders(spark, sf_dir), spec))


@query(
    "calibrated_scores",
    "SELECT doc_id, toxic, TRUE AS sound FROM documents JOIN labels USING (doc_id)",
)
def calibrated_scores(spark, sf_dir):
    docs = labelled_docs(spark, sf_dir)
    model = fit_ensemble(docs, "toxic", ["doc_id"], DOC_FEATURES, replace(LOGREG_SPEC, method=SIGMOID))
    return model.transform(docs).select("doc_id", "toxic", _sound("prob_evasao").alias("sound"))


@query(
    "out_of_fold",
    f"""WITH {_USED_SQL} SELECT o_orderkey,
  CAST(floor({HASH_SQL.replace("doc_id", "o_orderkey")} * 3) AS BIGINT) AS fold, TRUE AS sound FROM valid""",
)
def out_of_fold(spark, sf_dir):
    df = valid_labels(training_orders(spark, sf_dir))
    oof = out_of_fold_scores(df, "target_evasao", ["o_orderkey"], ORDER_FEATURES, LOGREG_SPEC)
    return oof.select(
        "o_orderkey", F.col("fold").cast("bigint").alias("fold"), _sound("prob_evasao").alias("sound")
    )


@query("search_boosted", """SELECT i AS trial, TRUE AS sound, TRUE AS complete FROM range(3) AS t(i)
WHERE (SELECT count(*) FROM orders) > 0""")
def search_boosted(spark, sf_dir):
    model = ModelSpec(GBT, params=(("n_estimators", 6),))
    found = search(training_orders(spark, sf_dir), replace(SPEC, model=model, trials=3))
    names = F.array_sort(F.map_keys("params"))
    wanted = sorted([
        "feature_fraction", "learning_rate", "max_depth", "min_child_samples", "n_estimators", "num_leaves", "subsample",
    ])
    return found.select(
        F.col("trial").cast("bigint").alias("trial"), _sound("loss").alias("sound"),
        (names == F.array(*map(F.lit, wanted))).alias("complete"),
    )


def _saved(spark, sf_dir):
    root = scratch_path(spark, "registry")
    spec = replace(SPEC, model=replace(LOGREG_SPEC, folds=2))
    run = train(training_orders(spark, sf_dir), spec, registry=root, model_id="orders")
    return root, run


@query(
    "score_batch",
    "SELECT o_orderkey, o_orderstatus, TRUE AS sound, TRUE AS labelled FROM orders",
)
def score_batch(spark, sf_dir):
    root, _ = _saved(spark, sf_dir)
    model = load_model("orders", root)
    rows = training_orders(spark, sf_dir)
    scored = with_risk(score(model, rows, status="o_orderstatus"))
    p = F.col("prob_evasao")
    label = F.when(p < 0.33, "Baixo").when(p < 0.4, "Médio").otherwise("Alto")
    return scored.select(
        "o_orderkey", "o_orderstatus", _sound("prob_evasao").alias("sound"),
        (F.col("risk_label") == label).alias("labelled"),
    )


@query(
    "model_registry",
    f"""WITH {_USED_SQL} SELECT 'orders' AS model_id, '1.0.0' AS version, 'logreg' AS model_type, TRUE AS sound,
  count(*) AS n_samples, TRUE AS complete FROM used""",
)
def model_registry(spark, sf_dir):
    root, _ = _saved(spark, sf_dir)
    return list_runs(spark, root).select(
        "model_id", "version", "model_type",
        (_sound("metrics.roc_auc") & _sound("metrics.brier_score")).alias("sound"), "n_samples",
        (F.col("n_features") <= F.size("feature_importance")).alias("complete"),
    )


@query(
    "importance_lookup",
    f"""WITH {_USED_SQL}, seen AS (
  SELECT unnest(['grade_a', 'grade_b', 'won', 'lost', 'won_share', 'grade_total']) AS feature
  UNION ALL SELECT DISTINCT 'o_orderpriority_' || lower(trim(o_orderpriority)) FROM used)
SELECT feature, TRUE AS finite, TRUE AS equal FROM seen""",
)
def importance_lookup(spark, sf_dir):
    """Every encoded feature with its importance, equal to the mean over the saved members' coefficients."""
    root, _ = _saved(spark, sf_dir)
    found = importance_of(spark, "orders", root)
    members = load_model("orders", root).fold_importances(spark).groupBy("feature").agg(F.avg("importance").alias("_mean"))
    finite = F.abs("importance") < float("inf")
    return found.join(members, "feature", "left").select(
        "feature", finite.alias("finite"),
        F.coalesce(F.abs(F.col("importance") - F.col("_mean")) < 1e-9, F.lit(False)).alias("equal"),
    )


@query(
    "score_arrivals",
    """SELECT o_orderkey, 'second' AS model_id, TRUE AS same FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'first', TRUE FROM orders WHERE o_orderkey % 2 = 1""",
)
def score_arrivals(spark, sf_dir):
    """Files that arrive before and after a newer model was saved, each scored by the newest of its time,
    with the probabilities that scoring them as a batch gives."""
    root = scratch_path(spark, "registry")
    rows = training_orders(spark, sf_dir)
    spec = replace(SPEC, model=replace(LOGREG_SPEC, calibrate=False))
    names = ["o_orderkey", "o_orderpriority", "grade_a", "grade_b", "won", "lost"]
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in names])
    folder, target, state = (scratch_path(spark, n) for n in ("arrivals", "scored", "state"))
    for model_id, side, options in (("first", 1, 50), ("second", 0, 3)):
        model = replace(spec.model, params=(("max_iter", options),))
        train(rows, replace(spec, model=model), registry=root, model_id=model_id)
        write_delimited(text.where(F.col("o_orderkey") % 2 == side), folder, mode="append")
        run_files_with_model(spark, folder, names, root, target, state).awaitTermination()
    scored = spark.read.parquet(f"{target}/scored").select("o_orderkey", "model_id", "prob_evasao")
    batch = [
        score(load_model(m, root), text).select("o_orderkey", F.lit(m).alias("model_id"), F.col("prob_evasao").alias("_p"))
        for m in ("first", "second")
    ]
    both = scored.join(batch[0].unionByName(batch[1]), ["o_orderkey", "model_id"], "left")
    same = F.coalesce(F.abs(F.col("prob_evasao") - F.col("_p")) < 1e-12, F.lit(False))
    return both.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "model_id", same.alias("same"))


@query(
    "holdout_quality",
    f"""WITH {_USED_SQL}, y AS (SELECT avg(target_evasao) AS r FROM used WHERE year = 1999)
SELECT round(r, 6) AS base_rate, round(r * (1e0 - r), 6) AS brier_base, TRUE AS sound FROM y""",
)
def holdout_quality(spark, sf_dir):
    spec = replace(SPEC, model=replace(LOGREG_SPEC, calibrate=False))
    rows = training_rows(training_orders(spark, sf_dir), spec)
    _, held, _ = validate_holdout(rows, spec)
    auc = roc_auc(held, "prob_evasao", "target_evasao").select("roc_auc")
    quality = brier(held, "prob_evasao", "target_evasao")
    quality = quality.withColumn("roc_auc", auc.scalar())
    return quality.select(
        r6("base_rate").alias("base_rate"), r6("brier_base").alias("brier_base"),
        (_sound("roc_auc") & _sound("brier")).alias("sound"),
    )
