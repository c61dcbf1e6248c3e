"""The training job: checks, split, hold-out validation, final fit, run record."""

from __future__ import annotations

import json
import logging
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.operators.calibration import (
    GBT,
    ISOTONIC,
    LOGREG,
    CalibratedModel,
    ModelSpec,
    build_classifier,
    fit_ensemble,
    in_parallel,
    positive_probability,
    sized_tasks,
    with_balanced_weights,
)
from earlywarn.operators.features import FeatureEncoder, FeatureSpec
from earlywarn.operators.filters import (
    UnusableData,
    check_labels,
    in_years,
    require_both_classes,
    valid_labels,
)
from earlywarn.operators.metrics import holdout_metrics, roc_auc
from earlywarn.operators.report import mean_importance
from earlywarn.operators.schema import as_number, column_type
from earlywarn.operators.splits import (
    TRAIN,
    VALIDATION,
    YearSplit,
    automatic_split,
    hash_fraction,
    years_present,
)
from earlywarn.presets import COMPLETED_STATUSES, DROPOUT_STATUSES
from earlywarn.sources.registry import new_model_id, save_run

log = logging.getLogger(__name__)


_KINDS = {"logreg": LOGREG, "lightgbm": GBT, "gbt": GBT}


@dataclass(frozen=True)
class TrainSpec:
    label: str = "target_evasao"
    valid: str = "is_target_valid"
    year: str = "ano_ingresso"
    half: str = "semestre_ingresso"
    # Columns that identify a row; folds and hashed splits follow them.
    keys: tuple[str, ...] = ("codigo_aluno", "ano_referencia", "periodo_referencia")
    features: FeatureSpec = field(default_factory=FeatureSpec)
    model: ModelSpec = field(default_factory=ModelSpec)
    split: YearSplit | None = None
    version: str = "1.0.0"
    trials: int = 20


    @classmethod
    def from_config(cls, raw: Mapping[str, Any], **overrides: Any) -> TrainSpec:
        """Read the job's plain configuration mapping (as found in a JSON request)."""
        kind = _KINDS.get(raw.get("model_type", LOGREG))
        if kind is None:
            raise UnusableData(f"unknown model_type {raw['model_type']!r}, use one of {list(_KINDS)}")
        model = ModelSpec(
            kind=kind,
            params=tuple((raw.get("model_params") or {}).items()),
            calibrate=bool(raw.get("calibrate", True)),
            method=raw.get("calibration_method", ISOTONIC),
            folds=int(raw.get("calibration_cv", 5)),
            seed=int(raw.get("random_state", 42)),
        )
        split = raw.get("split_config")
        return cls(
            model=model,
            split=YearSplit.from_config(split) if split else None,
            version=raw.get("version", "1.0.0"),
            trials=int(raw.get("optimize_trials", 20)),
            **overrides,
        )


@dataclass
class TrainedRun:
    model: CalibratedModel
    record: dict[str, Any]
    validation: DataFrame


def _typed(df: DataFrame, spec: TrainSpec) -> DataFrame:
    """Label, flag and time columns as numbers and booleans, also when the table came from text."""
    casts = {spec.label: as_number(df, spec.label)}
    if column_type(df, spec.valid).typeName() == "string":
        casts[spec.valid] = F.lower(spec.valid).isin("true", "1", "1.0")
    casts.update({c: as_number(df, c).cast("int") for c in (spec.year, spec.half) if c in df.columns})
    return df.withColumns(casts)


def training_rows(df: DataFrame, spec: TrainSpec) -> DataFrame:
    """Rows with a usable label, limited to the years of the configured split."""
    absent = [c for c in (spec.label, spec.valid) if c not in df.columns]
    if absent:
        raise UnusableData(f"label columns are missing, run the labelling plan first: {absent}")
    rows = valid_labels(_typed(df, spec), spec.valid)
    if spec.split is not None:
        if spec.year not in df.columns:
            raise UnusableData(f"a temporal split needs the column {spec.year}")
        spec.split.validate(years_present(rows, spec.split.years, spec.year))
        rows = in_years(rows, spec.split.years, spec.year)
    return rows


def used_columns(rows: DataFrame, spec: TrainSpec) -> DataFrame:
    """Only what the job reads, so that caching it does not carry the rest of a wide table."""
    inputs = (*spec.keys, spec.year, spec.half, *spec.features.numeric, *spec.features.categorical)
    wanted = [c for c in dict.fromkeys([*inputs, spec.label]) if c in rows.columns]
    return rows.select(*wanted)


def split_column(rows: DataFrame, spec: TrainSpec) -> tuple[Column, str]:
    if spec.split is not None:
        return spec.split.column(spec.year), "configured_years"
    column, how = automatic_split(
        rows, spec.keys, spec.year, spec.half, spec.model.seed, label=spec.label
    )
    return column, f"automatic_{how}"


def _halves(rows: DataFrame, spec: TrainSpec):
    """Training side, later side, their class counts, and the strategy."""
    column, strategy = split_column(rows, spec)
    marked = rows.withColumn("_split", column)
    counts = {side: {"negative": 0, "positive": 0} for side in (TRAIN, VALIDATION)}
    for r in marked.groupBy("_split", spec.label).count().collect():
        if r["_split"] in counts:
            counts[r["_split"]]["positive" if r[spec.label] == 1 else "negative"] += r["count"]
    if not all(sum(c.values()) for c in counts.values()):
        raise UnusableData(f"a side of the split is empty: {counts}")
    require_both_classes(counts[TRAIN], "training")
    if not all(counts[VALIDATION].values()):
        log.warning("the validation rows hold a single class, ROC AUC is undefined: %s", counts)
    train, held = (marked.where(F.col("_split") == s).drop("_split") for s in (TRAIN, VALIDATION))
    return train, held, counts, strategy


def validate_holdout(
    rows: DataFrame, spec: TrainSpec
) -> tuple[dict[str, float | None], DataFrame, str]:
    """Fit on the training side, score the later side, measure."""
    train, held, counts, strategy = _halves(rows, spec)
    model = fit_ensemble(train, spec.label, spec.keys, spec.features, spec.model, counts[TRAIN])
    scored = model.transform(held)
    slim = scored.select(model.output, spec.label).persist()
    try:
        return holdout_metrics(slim, model.output, spec.label), scored, strategy
    finally:
        slim.unpersist()


def run_record(
    model: CalibratedModel,
    rows: int,
    metrics: dict[str, float | None],
    strategy: str,
    spec: TrainSpec,
    best_params: dict[str, Any] | None,
    model_id: str,
    spark,
) -> dict[str, Any]:
    ranked = mean_importance(model.fold_importances(spark)).collect()
    feature_map: dict[str, list[str]] = {}
    for member in model.members:
        for name, source in member.encoder.lineage:
            names = feature_map.setdefault(source, [])
            if name not in names:
                names.append(name)
    log.info("top features: %s", [(r["feature"], round(r["importance"], 4)) for r in ranked[:5]])
    s = spec.split
    return {
        "model_id": model_id,
        "version": spec.version,
        "timestamp": datetime.now(UTC).isoformat(),
        "model_type": spec.model.kind,
        "metrics": metrics,
        "hyperparameters": {k: str(v) for k, v in spec.model.params},
        "best_params": {k: str(v) for k, v in (best_params or {}).items()},
        "validation_strategy": strategy,
        "split_config": None if s is None else json.dumps(
            {"train_range": s.train_range, "val_years": s.val_years, "test_years": s.test_years}
        ),
        "class_mapping": {"negative": COMPLETED_STATUSES, "positive": DROPOUT_STATUSES},
        "n_samples": rows,
        "n_features": len(spec.features.numeric) + len(spec.features.categorical),
        "feature_importance": [
            {"feature": r["feature"], "importance": r["importance"]} for r in ranked
        ],
        "feature_map": feature_map,
    }


def train(
    df: DataFrame,
    spec: TrainSpec = TrainSpec(),
    registry: str | None = None,
    model_id: str | None = None,
    best_params: dict[str, Any] | None = None,
) -> TrainedRun:
    """Validate on the hold-out, refit on all rows, record, and save when a registry is given."""
    rows = used_columns(training_rows(df, spec), spec).persist()
    try:
        counts = check_labels(rows, spec.label)
        metrics, validation, strategy = validate_holdout(rows, spec)
        model = fit_ensemble(rows, spec.label, spec.keys, spec.features, spec.model, counts)
        record = run_record(
            model, counts["negative"] + counts["positive"], metrics, strategy, spec, best_params,
            model_id or new_model_id(), df.sparkSession,
        )
    finally:
        rows.unpersist()
    if registry is not None:
        save_run(model, record, registry)
    return TrainedRun(model, record, validation)


def train_from_config(
    df: DataFrame, raw: Mapping[str, Any], registry: str | None = None, **overrides: Any
) -> TrainedRun:
    """The whole job from a plain configuration; ``optimize`` asks for the search first."""
    spec = TrainSpec.from_config(raw, **overrides)
    model_id = raw.get("model_id")
    job = tune_and_train if raw.get("optimize") else train
    return job(df, spec, registry, model_id)


def draw_trials(n: int, seed: int) -> list[dict[str, Any]]:
    """Seeded random draws from the search ranges."""
    rng = random.Random(seed)
    # The search ranges and the conservative settings shared by every trial.
    return [
        {
            "num_leaves": rng.randint(16, 64),
            "learning_rate": math.exp(rng.uniform(math.log(0.01), math.log(0.2))),
            "feature_fraction": rng.uniform(0.6, 0.9),
            "min_child_samples": rng.randint(20, 100),
            "max_depth": 5,
            "subsample": 0.8,
        }
        for _ in range(n)
    ]


# Fixed value: a trial ends when this many more trees have not lowered the loss on the later side.
PATIENCE = 50


def best_prefix(losses: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Trees up to the lowest loss before the first ``patience`` trees without a lower one, and whether
    there were that many."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# A rung keeps one trial in so many, and gives those it keeps so many times the trees and rows.
HALVING = 3
# Earlier rungs use at least so many rows, if there are as many, and so many trees: with less, settings
# cannot be told apart.
RUNG_ROWS = 20_000
RUNG_TREES = 5


@dataclass(frozen=True)
class Rung:
    trials: int
    trees: int
    share: float


def rungs(trials: int, most_trees: int, rows: int) -> list[Rung]:
    """How many trials grow how many trees on what share of the training rows, cheapest first. The last
    rung has all trees and all rows."""
    steps = min(2, int(math.log(max(trials, 1), HALVING) + 1e-9))
    out = []
    for step in range(steps):
        part = HALVING ** (steps - step)
        share = min(1.0, max(1.0 / part, RUNG_ROWS / max(rows, 1)))
        out.append(Rung(-(-trials // HALVING**step), min(most_trees, max(RUNG_TREES, min(most_trees, 2 * PATIENCE) // part)), share))
    return [*out, Rung(-(-trials // HALVING**steps), most_trees, 1.0)]


def search(df: DataFrame, spec: TrainSpec) -> DataFrame:
    """Try ``spec.trials`` boosted-tree settings on one split; one row per trial, best first.

    The split and the encoders do not depend on the trial, so they are computed once and the
    assembled vectors are kept. All trials start small, with few trees on a hashed share of the training
    rows; only the best third of a rung goes on to the next, with three times of both. The few that
    reach the last rung see all rows and grow their trees in doubling budgets until ``PATIENCE`` of them
    bring no gain on the later side (all prefixes are measured in one pass), and keep the best prefix.
    ``rung`` is the last rung a trial reached and ``loss`` what it had there; ties keep the earlier draw.
    """
    rows = used_columns(training_rows(df, spec), spec).persist()
    check_labels(rows, spec.label)
    train_rows, held, sides, _ = _halves(rows, spec)
    counts = sides[TRAIN]
    encoder = FeatureEncoder(
        spec=spec.features, labelCol=spec.label, outputCol="_features"
    ).fit(train_rows)
    marked = train_rows.withColumn("_held", F.lit(False)).unionByName(
        held.withColumn("_held", F.lit(True))
    ).withColumn("_place", hash_fraction(spec.keys, spec.model.seed + 1))
    weighted = with_balanced_weights(encoder.transform(marked), spec.label, counts)
    vectors = sized_tasks(
        weighted.select("_features", "_label", "_weight", "_held", "_place"), sum(counts.values())
    ).persist()

    def grown(params: dict[str, Any], trees: int, share: float):
        options = {**params, "n_estimators": trees}
        trial = replace(spec.model, kind=GBT, params=tuple(options.items()))
        return build_classifier(trial, 0.0).fit(vectors.where(~F.col("_held") & (F.col("_place") < share)))

    def loss_of(fitted) -> float:
        scored = fitted.transform(vectors.where("_held"))
        slim = scored.select(positive_probability("_prob", [0, 1]).alias("p"), "_label")
        auc = roc_auc(slim, "p", "_label").first()["roc_auc"]
        return 0.5 if auc is None else 1.0 - auc

    def full(params: dict[str, Any], most: int) -> tuple[float, int]:
        trees = min(most, 2 * PATIENCE)
        while True:
            fitted = grown(params, trees, 1.0)
            best, ended = best_prefix(fitted.evaluateEachIteration(vectors.where("_held")))
            if ended or trees == most:
                break
            trees = min(most, 2 * trees)
        # Trees are seeded by their number, so a fit of the best size is the best prefix.
        fitted = fitted if best == trees else grown(params, best, 1.0)
        return loss_of(fitted), fitted.getNumTrees

    def attempt(params: dict[str, Any], rung: Rung, last: bool) -> tuple[float, int]:
        if last:
            return full(params, rung.trees)
        return loss_of(grown(params, rung.trees, rung.share)), rung.trees

    draws = draw_trials(spec.trials, spec.model.seed)
    ladder = rungs(spec.trials, int(spec.model.options.get("n_estimators", 1000)), sum(counts.values()))
    reached: dict[int, tuple[int, float, int]] = {}
    alive = list(range(spec.trials))
    try:
        for k, rung in enumerate(ladder):
            # The best of the rung before; sorting is stable, so ties keep the order of the draws.
            alive = sorted(alive, key=lambda i: reached[i][1] if i in reached else 0.0)[: rung.trials]
            last = k == len(ladder) - 1
            jobs = [lambda i=i: attempt(draws[i], rung, last) for i in alive]  # noqa: B023
            found = in_parallel(jobs, spec.model.parallelism)
            reached.update({i: (k, *result) for i, result in zip(alive, found, strict=True)})
    finally:
        vectors.unpersist()
        rows.unpersist()
    # The number of trees at the early stop is part of the setting, for the final fit to repeat.
    table = [
        (i, k, loss, {n: str(v) for n, v in {**draws[i], "n_estimators": trees}.items()})
        for i, (k, loss, trees) in sorted(reached.items())
    ]
    return df.sparkSession.createDataFrame(
        table, "trial int, rung int, loss double, params map<string,string>"
    ).orderBy(F.desc("rung"), "loss", "trial")


def tune_and_train(
    df: DataFrame, spec: TrainSpec, registry: str | None = None, model_id: str | None = None
) -> TrainedRun:
    """Search, then train with the best settings; other model kinds train directly."""
    if spec.model.kind != GBT:
        return train(df, spec, registry, model_id)
    best = dict(search(df, spec).first()["params"])
    merged = {**spec.model.options, **best}
    tuned = replace(spec, model=replace(spec.model, params=tuple(merged.items())))
    return train(df, tuned, registry, model_id, best_params=best)

