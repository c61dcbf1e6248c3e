"""Calibrated fold ensembles: encoder, classifier and calibrator are fitted fold by fold."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from earlywarn.functions import named
from earlywarn.operators.features import (
    FeatureEncoder,
    FeatureEncoderModel,
    FeatureSpec,
    fit_complements,
    kept,
    prepare,
    restore,
)
from earlywarn.operators.filters import check_labels, require_both_classes
from earlywarn.operators.lookups import lookup_join
from earlywarn.operators.splits import hash_fold, usable_folds
from earlywarn.session import scratch_path

LOGREG, GBT = "logreg", "gbt"
# Where the cleaned rows wait while the folds are fitted: in the executors' memory and disks, or as a
# table in the shared folder, one directory per fold, which no lost executor can take along.
CACHE, TABLE = "cache", "table"
ISOTONIC, SIGMOID = "isotonic", "sigmoid"
# Calibrators are fitted on cells of the log-odds, so many per unit, each standing at the exact mean
# score and mean log-odds of its rows. Log-odds end at +-27.7, so at most 55,263 cells are collected
# however many rows there are, and a score is never moved by more than a cell's width.
CALIBRATION_CELLS = 1000
# Iterative fits go over the rows many times; below this many rows a task is mostly overhead.
MIN_ROWS_PER_TASK = 25_000


@dataclass(frozen=True)
class ModelSpec:
    kind: str = LOGREG
    params: tuple[tuple[str, Any], ...] = ()
    calibrate: bool = True
    method: str = ISOTONIC
    folds: int = 5
    seed: int = 42
    parallelism: int = 4
    storage: str = CACHE

    @property
    def options(self) -> dict[str, Any]:
        return dict(self.params)


def in_parallel(jobs: Sequence[Callable[[], Any]], threads: int) -> list[Any]:
    """Run driver-side fits side by side; Spark shares the executors among their jobs."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        started = [pool.submit(inherit(job)) for job in jobs]
        return [s.result() for s in started]


def build_classifier(spec: ModelSpec, weight_total: float):
    """The untrained classifier. ``weight_total`` turns an inverse penalty C into Spark's regParam."""
    options = spec.options
    if spec.kind == LOGREG:
        c = float(options.get("C", 1.0))
        return LogisticRegression(
            featuresCol="_features", labelCol="_label", weightCol="_weight",
            predictionCol="_class", rawPredictionCol="_raw", probabilityCol="_prob",
            maxIter=int(options.get("max_iter", 100)), tol=float(options.get("tol", 1e-6)),
            regParam=1.0 / (c * max(weight_total, 1.0)), standardization=False,
        )
    if spec.kind == GBT:
        fraction = options.get("feature_fraction", options.get("colsample_bytree", 0.8))
        return GBTClassifier(
            featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_class",
            maxIter=int(options.get("n_estimators", 100)), maxDepth=int(options.get("max_depth", 5)),
            stepSize=float(options.get("learning_rate", 0.1)),
            subsamplingRate=float(options.get("subsample", 0.8)),
            featureSubsetStrategy=str(fraction),
            minInstancesPerNode=int(options.get("min_child_samples", 20)),
            seed=spec.seed,
        ).setRawPredictionCol("_raw").setProbabilityCol("_prob")
    raise ValueError(f"unknown model kind {spec.kind!r}")


def with_balanced_weights(df: DataFrame, label: str, counts: dict[str, int]) -> DataFrame:
    n = counts["negative"] + counts["positive"]
    positive, negative = n / (2.0 * counts["positive"]), n / (2.0 * counts["negative"])
    return df.withColumns(
        {
            "_label": F.col(label).cast("double"),
            "_weight": F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative)),
        }
    )


def positive_probability(column: str, classes: Sequence[float]) -> Column:
    """Probability of class 1, or of the last class when 1 is not among them."""
    listed = [float(c) for c in classes]
    index = listed.index(1.0) if 1.0 in listed else len(listed) - 1
    return vector_to_array(F.col(column))[index]


class Member:
    """One fitted fold: encoder, classifier and, when calibrated, its calibrator."""

    def __init__(self, encoder: FeatureEncoderModel, classifier: Any, calibrator: Any = None):
        self.encoder, self.classifier, self.calibrator = encoder, classifier, calibrator

    def score_prepared(self, prepared: DataFrame, output: str) -> DataFrame:
        """Append the probability to prepared rows, in the same pass."""
        raw = self.classifier.transform(self.encoder.assemble(prepared, "_features"))
        classes = list(range(self.classifier.numClasses))
        scored = raw.withColumn("_p", positive_probability("_prob", classes))
        columns = map(named, prepared.columns)
        return self._calibrate(scored).select(*columns, F.col("_cal").alias(output))

    def _calibrate(self, df: DataFrame) -> DataFrame:
        if self.calibrator is None:
            return df.withColumn("_cal", F.col("_p"))
        if isinstance(self.calibrator, IsotonicRegressionModel):
            return self.calibrator.transform(df)
        slope, intercept = self.calibrator
        x = sigmoid_input(F.col("_p"))
        z = F.lit(slope) * x + F.lit(intercept)
        return df.withColumn("_cal", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))

    def importances(self) -> list[tuple[str, float]]:
        names = self.encoder.feature_names
        fitted = self.classifier
        values = (
            fitted.coefficients if isinstance(fitted, LogisticRegressionModel)
            else fitted.featureImportances
        )
        return list(zip(names, [float(v) for v in values.toArray()], strict=True))


def sigmoid_input(p: Column) -> Column:
    """Log-odds, kept finite."""
    edge = F.lit(1e-12)
    clipped = F.greatest(F.least(p, F.lit(1.0) - edge), edge)
    return F.log(clipped / (F.lit(1.0) - clipped))


def _grid(scored: DataFrame, label: str) -> DataFrame:
    """Held-out scores reduced to (score, log-odds, outcome, weight): bounded, every row counted."""
    x = sigmoid_input(F.col("_p"))
    return (
        scored.groupBy(F.round(x * CALIBRATION_CELLS).alias("_cell"))
        .agg(F.avg("_p").alias("_p"), F.avg(x).alias("_x"),
             F.avg(F.col(label).cast("double")).alias("_y"),
             F.count("*").cast("double").alias("_n"))
        .where(F.col("_p").isNotNull())
    )


def fit_calibrator(scored: DataFrame, label: str, method: str):
    """Fit on held-out rows carrying the raw probability ``_p``, which are scored and reduced once."""
    if method not in (ISOTONIC, SIGMOID):
        raise ValueError(f"unknown calibration method {method!r}")
    grid = _grid(scored, label).persist()
    try:
        return _fit_on_grid(grid, method)
    finally:
        grid.unpersist()


def _fit_on_grid(grid: DataFrame, method: str):
    if method == ISOTONIC:
        return IsotonicRegression(
            featuresCol="_p", labelCol="_y", weightCol="_n", predictionCol="_cal"
        ).fit(grid)
    n = grid.agg(
        F.sum(F.col("_n") * F.col("_y")).alias("pos"), F.sum("_n").alias("all")
    ).first()
    # Targets pulled in from 0 and 1 by the class counts, each as a weighted pair of outcomes.
    high = (n["pos"] + 1.0) / (n["pos"] + 2.0)
    low = 1.0 / (n["all"] - n["pos"] + 2.0)
    target = F.col("_y") * F.lit(high) + (F.lit(1.0) - F.col("_y")) * F.lit(low)
    pairs = grid.select(
        "_x",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("_t"), (F.col("_n") * target).alias("_w")),
                F.struct(F.lit(0.0).alias("_t"), (F.col("_n") * (1.0 - target)).alias("_w")),
            )
        ),
    )
    rows = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(pairs)
    fit = LogisticRegression(
        featuresCol="_v", labelCol="_t", weightCol="_w", standardization=False, maxIter=100
    ).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def fit_member(
    prepared: DataFrame,
    label: str,
    features: FeatureSpec,
    spec: ModelSpec,
    counts: dict[str, int],
    encoder: FeatureEncoderModel | None = None,
) -> Member:
    """Encoder, unless there is one already, and classifier on prepared rows. The classifier keeps its
    own compact copy of the vectors while it iterates, so they are not cached here as well."""
    require_both_classes(counts, "training")
    encoder = encoder or FeatureEncoder(spec=features, labelCol=label).fit_prepared(prepared)
    y = prepared.withColumn("_y", kept(label))
    rows = with_balanced_weights(encoder.assemble(y, "_features"), "_y", counts)
    total = float(counts["negative"] + counts["positive"])
    rows = sized_tasks(rows.select("_features", "_label", "_weight"), total)
    return Member(encoder, build_classifier(spec, total).fit(rows))


def sized_tasks(rows: DataFrame, n: float) -> DataFrame:
    """Merge partitions too small to be worth a task in each of the many passes of a fit. Never adds
    partitions, so a large input keeps the parallelism it came with."""
    return rows.coalesce(max(1, math.ceil(n / MIN_ROWS_PER_TASK)))


def _stored(prepared: DataFrame, spec: ModelSpec, by: Sequence[str] = ()) -> DataFrame:
    if spec.storage == CACHE:
        return prepared.persist()
    spark = prepared.sparkSession
    path = scratch_path(spark, "prepared")
    prepared.write.partitionBy(*by).parquet(path)
    return spark.read.parquet(path).select(*map(named, prepared.columns))


def _folded(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    features: FeatureSpec,
    spec: ModelSpec,
    counts: dict[str, int] | None,
):
    """Prepared rows with their fold, stored, and the class counts outside each fold."""
    counts = counts or check_labels(df, label)
    require_both_classes(counts, "training")
    folds = usable_folds(spec.folds, counts)
    marked = df.withColumn("_fold", hash_fold(keys, folds, spec.seed))
    prepared = _stored(prepare(marked, features, marked.columns), spec, ["k__fold"])
    fold, y = kept("_fold"), kept(label)
    inside = prepared.groupBy(fold.alias("fold")).agg(
        F.count_if(y == 0).alias("negative"), F.count_if(y == 1).alias("positive")
    )
    outside = [dict(counts) for _ in range(folds)]
    for r in inside.collect():
        for name in ("negative", "positive"):
            outside[r["fold"]][name] -= r[name]
    return prepared, fold, outside


def fit_ensemble(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    features: FeatureSpec,
    spec: ModelSpec,
    counts: dict[str, int] | None = None,
) -> CalibratedModel:
    """Fit the configured model on ``df``; ``counts`` are its class counts when already known.

    With calibration the whole chain, encoders included, is fitted on the other folds and the
    calibrator on the held-out fold, so no statistic leaks into its own calibration. Cleaning does
    not look at other rows, so it runs once for all folds.
    """
    if not spec.calibrate:
        counts = counts or check_labels(df, label)
        prepared = _stored(prepare(df, features, [label]), spec)
        try:
            return CalibratedModel([fit_member(prepared, label, features, spec, counts)])
        finally:
            prepared.unpersist()
    wanted = dict.fromkeys([*_inputs(df, features), *keys, label])
    prepared, fold, outside = _folded(df.select(*wanted), label, keys, features, spec, counts)
    encoders = fit_complements(prepared, features, label, fold, len(outside))

    def one(k: int) -> Member:
        fitted = fit_member(prepared.where(fold != k), label, features, spec, outside[k], encoders[k])
        held = fitted.score_prepared(prepared.where(fold == k), "_p")
        held = held.select("_p", kept(label).alias("_y"))
        fitted.calibrator = fit_calibrator(held, "_y", spec.method)
        return fitted

    try:
        jobs = [lambda k=k: one(k) for k in range(len(outside))]
        return CalibratedModel(in_parallel(jobs, spec.parallelism))
    finally:
        prepared.unpersist()


def _inputs(df: DataFrame, features: FeatureSpec) -> list[str]:
    return [c for c in (*features.numeric, *features.categorical) if c in df.columns]


def out_of_fold_scores(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    features: FeatureSpec,
    spec: ModelSpec,
    output: str = "prob_evasao",
) -> DataFrame:
    """Every row scored exactly once, by a model that did not see it, in one pass over the rows."""
    prepared, fold, outside = _folded(df, label, keys, features, spec, None)
    encoders = fit_complements(prepared, features, label, fold, len(outside))

    def one(k: int) -> Member:
        return fit_member(prepared.where(fold != k), label, features, spec, outside[k], encoders[k])

    try:
        members = in_parallel([lambda k=k: one(k) for k in range(len(outside))], spec.parallelism)
    finally:
        prepared.unpersist()
    scored = score_by_member(prepared, "k__fold", members, output)
    return restore(scored, [output]).withColumnRenamed("_fold", "fold")


def score_by_member(prepared: DataFrame, member: str, members: Sequence[Member], output: str) -> DataFrame:
    """Append to each prepared row the probability of the one member that its column ``member`` numbers.

    A row is encoded by its own member alone: the other members get a vector of zeros, which costs next
    to nothing, and their answer is not used. Category encodings are looked up by member and value
    together, so a column is one join however many members there are. A row without a member, or of
    one that is not there, has no probability.
    """
    ready = prepared
    for c in sorted({c for m in members for c in m.encoder.state["target"]}):
        tables = [
            m.encoder.encoding_of(c).withColumn(member, F.lit(k))
            for k, m in enumerate(members) if c in m.encoder.state["target"]
        ]
        rows, size = (sum(m.encoder.state[s] for m in members) for s in ("encoding_rows", "encoding_bytes"))
        ready = lookup_join(
            ready, reduce(DataFrame.unionByName, tables), [member, f"x_{c}"], rows=rows, size=size
        )
    chosen = F.lit(None).cast("double")
    columns = [*prepared.columns]
    for k, m in enumerate(members):
        mine = named(member) == F.lit(k)
        own = F.array(*[c.cast("double") for c in m.encoder.encoded_columns()])
        zeros = F.array_repeat(F.lit(0.0), len(m.encoder.lineage))
        vector = array_to_vector(F.when(mine, own).otherwise(zeros))
        raw = m.classifier.transform(ready.withColumn("_features", vector))
        scored = raw.withColumn("_p", positive_probability("_prob", list(range(m.classifier.numClasses))))
        ready = m._calibrate(scored).select(*map(named, ready.columns), F.col("_cal").alias(f"_member{k}"))
        chosen = F.when(mine, F.col(f"_member{k}")).otherwise(chosen)
    return ready.select(*map(named, columns), chosen.alias(output))


class CalibratedModel(Model, MLWritable, MLReadable):
    """Mean of the calibrated probabilities of its members."""

    def __init__(self, members: Sequence[Member] = (), output: str = "prob_evasao"):
        super().__init__()
        self.members = list(members)
        self.output = output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # All members share one clean-up; each appends one column in the same pass over the rows.
        df = prepare(dataset, self.members[0].encoder.spec, dataset.columns)
        names = [f"_m{i}" for i in range(len(self.members))]
        for name, member in zip(names, self.members, strict=True):
            df = member.score_prepared(df, name)
        mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / F.lit(float(len(names)))
        return restore(df.withColumn(self.output, mean), [self.output])

    def fold_importances(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, name, source, value)
            for i, m in enumerate(self.members)
            for (name, value), (_, source) in zip(m.importances(), m.encoder.lineage, strict=True)
        ]
        return spark.createDataFrame(
            rows, "fold int, feature string, source string, importance double"
        )

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: CalibratedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        described = []
        for i, m in enumerate(self.instance.members):
            m.encoder.write().save(f"{path}/members/{i}/encoder")
            m.classifier.write().save(f"{path}/members/{i}/classifier")
            isotonic = isinstance(m.calibrator, IsotonicRegressionModel)
            if isotonic:
                m.calibrator.write().save(f"{path}/members/{i}/calibrator")
            kind = LOGREG if isinstance(m.classifier, LogisticRegressionModel) else GBT
            described.append(
                {"kind": kind, "isotonic": isotonic,
                 "sigmoid": None if isotonic else m.calibrator}
            )
        DefaultParamsWriter.saveMetadata(
            self.instance, path, spark,
            extraMetadata={"members": described, "output": self.instance.output},
        )


class _ModelReader(MLReader):
    def load(self, path: str) -> CalibratedModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        loaders = {LOGREG: LogisticRegressionModel, GBT: GBTClassificationModel}
        members = []
        for i, described in enumerate(metadata["members"]):
            base = f"{path}/members/{i}"
            calibrator = described["sigmoid"]
            if described["isotonic"]:
                calibrator = IsotonicRegressionModel.load(f"{base}/calibrator")
            members.append(
                Member(
                    FeatureEncoderModel.load(f"{base}/encoder"),
                    loaders[described["kind"]].load(f"{base}/classifier"),
                    calibrator,
                )
            )
        model = CalibratedModel(members, metadata["output"])
        model._resetUid(metadata["uid"])
        return model
