"""Saved models and their run records."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.operators.calibration import CalibratedModel
from earlywarn.operators.report import mean_importance

RUN_SCHEMA = (
    "model_id string, version string, timestamp string, model_type string, "
    "metrics struct<roc_auc:double,pr_auc:double,brier_score:double,brier_base_rate:double>, "
    "hyperparameters map<string,string>, best_params map<string,string>, "
    "validation_strategy string, split_config string, "
    "class_mapping struct<negative:array<string>,positive:array<string>>, "
    "n_samples bigint, n_features bigint, "
    "feature_importance array<struct<feature:string,importance:double>>, "
    "feature_map map<string,array<string>>"
)


class ModelNotFound(LookupError):
    pass


def new_model_id(now: datetime | None = None) -> str:
    return f"model_{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S')}"


def _folder(root: str, model_id: str) -> str:
    """A bare id lives below the registry root; anything with a slash is taken as a path."""
    return model_id if "/" in model_id else f"{root}/{model_id}"


def save_run(model: CalibratedModel, run: dict[str, Any], root: str) -> str:
    """Write the model, then its record: a listed run always has a complete model."""
    folder = _folder(root, run["model_id"])
    spark = SparkSession.getActiveSession()
    model.write().save(f"{folder}/model")
    record = spark.createDataFrame([(json.dumps(run),)], "value string")
    record.coalesce(1).write.text(f"{folder}/run")
    return folder


def load_model(model_id: str, root: str) -> CalibratedModel:
    try:
        return CalibratedModel.load(f"{_folder(root, model_id)}/model")
    except (Py4JJavaError, AnalysisException) as exc:
        # Only a missing path means that there is no such model; everything else is reported as it is.
        if "does not exist" not in str(exc) and "PATH_NOT_FOUND" not in str(exc):
            raise
        raise ModelNotFound(f"no model {model_id!r} under {root}") from exc


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every saved run, newest first; an empty table when the registry holds none."""
    try:
        runs = spark.read.schema(RUN_SCHEMA).json(f"{root}/*/run")
    except AnalysisException:
        runs = spark.createDataFrame([], RUN_SCHEMA)
    return runs.orderBy(F.desc("timestamp"), "model_id")


def importance_of(spark: SparkSession, model_id: str, root: str) -> DataFrame:
    """Stored importances of a run, or rebuilt from the model when the record has none."""
    stored = (
        list_runs(spark, root).where(F.col("model_id") == model_id)
        .select(F.inline("feature_importance"))
    )
    if not stored.isEmpty():
        return stored.orderBy(F.abs("importance").desc(), "feature")
    return mean_importance(load_model(model_id, root).fold_importances(spark))
