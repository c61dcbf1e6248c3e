"""Batch scoring: raw rows in, risk table out."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession

from earlywarn.operators.calibration import CalibratedModel
from earlywarn.operators.report import with_risk
from earlywarn.operators.schema import display_order
from earlywarn.plans.etl import records_for_scoring
from earlywarn.presets import DEFAULT_RISK_THRESHOLD, SCORING_PRESET, RecordPreset
from earlywarn.sources.files import check_contract, read_delimited, write_records
from earlywarn.sources.registry import load_model


def score(model: CalibratedModel, rows: DataFrame, status: str = "situacao") -> DataFrame:
    """Append the probability. The status never reaches the model: it is set aside under another
    name while the rows are scored, then given back, so nothing is matched by position."""
    if status not in rows.columns:
        return model.transform(rows)
    aside = rows.withColumnRenamed(status, "_outcome")
    return model.transform(aside).withColumnRenamed("_outcome", status)


def score_raw(
    model: CalibratedModel,
    raw: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    preset: RecordPreset = SCORING_PRESET,
    as_of: date | Column | None = None,
    threshold: float = DEFAULT_RISK_THRESHOLD,
) -> DataFrame:
    """Cleaning, scoring and risk labels in one plan."""
    clean, _ = records_for_scoring(raw, mapping, preset, as_of=as_of)
    scored = score(model, clean, preset.status)
    return display_order(with_risk(scored, model.output, threshold))


def score_file(
    spark: SparkSession,
    path: str,
    model_id: str,
    registry: str,
    target: str,
    mapping: Mapping[str, str | None] | None = None,
    preset: RecordPreset = SCORING_PRESET,
    threshold: float = DEFAULT_RISK_THRESHOLD,
) -> DataFrame:
    """The batch job: CSV files in, one JSON record with its probability per row out."""
    raw = read_delimited(spark, path)
    check_contract(raw, required=(), critical=())
    out = score_raw(load_model(model_id, registry), raw, mapping, preset, threshold=threshold)
    write_records(out, target)
    return out
