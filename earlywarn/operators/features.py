"""The feature estimator: clean, engineer, impute, scale, encode, assemble."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
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

from earlywarn.functions import clean_categories, named, present_sum, share
from earlywarn.operators.encoders import MISSING, EncoderSpec, category_counts, long_form, smoothed_mean
from earlywarn.operators.lookups import lookup_join
from earlywarn.operators.quantiles import exact_medians
from earlywarn.operators.schema import drop_technical, ensure_typed
from earlywarn.presets import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TECHNICAL_COLUMNS
from earlywarn.session import pin


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...] = tuple(NUMERIC_FEATURES)
    categorical: tuple[str, ...] = tuple(CATEGORICAL_FEATURES)
    # Total columns: name -> prefix of the columns that are added up.
    totals: tuple[tuple[str, str], ...] = (
        ("nota_enem_total", "nota_enem_"),
        ("nota_vestibular_total", "nota_vestibular_"),
    )
    # Share columns: name -> (part, rest).
    shares: tuple[tuple[str, str, str], ...] = (
        ("aprovacao_ratio", "disciplinas_aprovadas", "disciplinas_reprovadas_nota"),
    )
    technical: tuple[str, ...] = tuple(TECHNICAL_COLUMNS)
    missing_word: str = MISSING
    encoder: EncoderSpec = field(default_factory=EncoderSpec)

    @property
    def engineered(self) -> list[str]:
        return [s[0] for s in self.shares] + [t[0] for t in self.totals]

    @property
    def all_numeric(self) -> list[str]:
        return [*self.numeric, *[c for c in self.engineered if c not in self.numeric]]

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> FeatureSpec:
        return cls(
            numeric=tuple(raw["numeric"]),
            categorical=tuple(raw["categorical"]),
            totals=tuple((a, b) for a, b in raw["totals"]),
            shares=tuple((a, b, c) for a, b, c in raw["shares"]),
            technical=tuple(raw["technical"]),
            missing_word=raw["missing_word"],
            encoder=EncoderSpec(**raw["encoder"]),
        )


def engineer(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Totals (own output column excluded from its prefix) and shares."""
    new = {name: share(part, rest) for name, part, rest in spec.shares}
    for name, prefix in spec.totals:
        parts = [c for c in spec.numeric if c.startswith(prefix) and c != name]
        new[name] = present_sum(parts)
    return df.withColumns(new)


def prepare(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Raw columns -> typed, cleaned, engineered model inputs, with ``keep`` passed through.

    Model inputs get an ``x_`` prefix and passed-through columns a ``k_`` prefix, so neither disturbs
    the other and an unused column is still pruned from the scan.
    """
    passed = [f"k_{c}" for c in keep]
    base = drop_technical(df.withColumns({f"k_{c}": named(c) for c in keep}), spec.technical)
    source = clean_categories(ensure_typed(base, spec.numeric, spec.categorical), spec.categorical)
    typed = source.select(
        *[F.col(c) for c in spec.numeric],
        *[F.coalesce(F.col(c), F.lit(spec.missing_word)).alias(c) for c in spec.categorical],
        *map(named, passed),
    )
    ready = engineer(typed, spec)
    inputs = [*spec.all_numeric, *spec.categorical]
    return ready.select(*[F.col(c).alias(f"x_{c}") for c in inputs], *map(named, passed))


def kept(name: str) -> Column:
    """A passed-through column of prepared rows."""
    return named(f"k_{name}")


@dataclass(frozen=True)
class NumericStats:
    """What it takes to impute and scale one column."""

    fill: float
    mean: float
    std: float
    # A column without a single value is kept and imputed with zero.
    empty: bool = False

    def apply(self, c: Column) -> Column:
        return (F.coalesce(c, F.lit(self.fill)) - F.lit(self.mean)) / F.lit(self.std)


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> list[NumericStats]:
    """Median, then mean and population deviation after imputation; deviation 0 counts as 1."""
    if not columns:
        return []
    medians = exact_medians(df, columns)
    fills = [float(medians[c] or 0.0) for c in columns]
    aggs = []
    for i, (c, fill) in enumerate(zip(columns, fills, strict=True)):
        filled = F.coalesce(F.col(c), F.lit(fill))
        aggs += [F.avg(filled).alias(f"m{i}"), F.stddev_pop(filled).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return [
        NumericStats(fill, row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0, medians[c] is None)
        for i, (c, fill) in enumerate(zip(columns, fills, strict=True))
    ]


def _state(spec: FeatureSpec, stats: Sequence[NumericStats]) -> dict[str, Any]:
    """What an encoder knows before it has seen categories."""
    return {
        "spec": spec.to_dict(),
        "numeric": [[c, s.fill, s.mean, s.std] for c, s in zip(spec.all_numeric, stats, strict=True)],
        "empty": [c for c, s in zip(spec.all_numeric, stats, strict=True) if s.empty],
        "onehot": {},
        "target": [],
        "prior": 0.0,
        "encoding_rows": 0,
        "encoding_bytes": 0,
    }


def _value_bytes() -> Column:
    """What the encodings of a column take up at most: name, value and number of each category."""
    return F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64).alias("bytes")


@dataclass(frozen=True)
class Moments:
    """Count, mean and summed squared deviation of some values; moments of disjoint rows add up."""

    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(
            n, self.mean + gap * other.n / n, self.squares + other.squares + gap * gap * self.n * other.n / n
        )


def complement_statistics(
    df: DataFrame, columns: Sequence[str], fold: Column, folds: int
) -> list[list[NumericStats]]:
    """:func:`numeric_statistics` of the rows outside each fold, for all folds in the same passes.

    The medians of all complements are bracketed and counted side by side. Mean and deviation follow
    from one line of moments per fold: those of the other folds are merged, never subtracted, and the
    imputed values join them as so many equal values.
    """
    if not columns:
        return [[] for _ in range(folds)]
    apart = {(k, i): F.when(fold != k, F.col(c)).alias(f"c{k}_{i}") for k in range(folds) for i, c in enumerate(columns)}
    names = [f"c{k}_{i}" for k, i in apart]
    medians = exact_medians(df.select(*apart.values()), names)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    lines = {r["fold"]: r for r in df.groupBy(fold.alias("fold")).agg(*aggs).collect() if r["fold"] is not None}
    out: list[list[NumericStats]] = []
    for k in range(folds):
        others = [r for f, r in lines.items() if f != k]
        rows = sum(r["rows"] for r in others)
        own = []
        for i in range(len(columns)):
            median = medians[f"c{k}_{i}"]
            fill = float(median or 0.0)
            total = Moments()
            for r in others:
                if r[f"n{i}"]:
                    total += Moments(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"] * r[f"n{i}"])
            total += Moments(rows - total.n, fill, 0.0)
            std = math.sqrt(total.squares / total.n) if total.n else 0.0
            own.append(NumericStats(fill, total.mean, std or 1.0, median is None))
        out.append(own)
    return out


def fit_complements(
    prepared: DataFrame, spec: FeatureSpec, label: str, fold: Column, folds: int, output: str = "features"
) -> list[FeatureEncoderModel]:
    """An encoder for each fold, fitted on all other folds' rows, in passes that do not grow with the folds.

    ``prepared`` went through :func:`prepare` and kept the label and the fold. Categories are counted
    once, with their counts and label sums in each fold; those outside a fold are the total less the
    fold's own, which is exact for whole numbers.
    """
    rows = prepared.withColumn("_y", kept(label).cast("double"))
    stats = complement_statistics(rows, [f"x_{c}" for c in spec.all_numeric], fold, folds)
    states = [_state(spec, s) for s in stats]
    models = [FeatureEncoderModel(state)._set(outputCol=output) for state in states]
    if not spec.categorical:
        return models
    columns = [f"x_{c}" for c in spec.categorical]
    counted = long_form(rows, columns, [F.col("_y"), fold.alias("_f")]).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"),
        *[F.count_if(F.col("_f") == k).alias(f"n{k}") for k in range(folds)],
        *[F.coalesce(F.sum(F.when(F.col("_f") == k, F.col("_y"))), F.lit(0.0)).alias(f"y{k}") for k in range(folds)],
    )
    # Everything below, and scoring, reads this table; the rows are not needed any more.
    counted = pin(counted)
    left_n = [F.col("n") - F.col(f"n{k}") for k in range(folds)]
    left_y = [F.col("y") - F.col(f"y{k}") for k in range(folds)]
    sizes = {
        r["feature"]: r
        for r in counted.groupBy("feature").agg(
            *[F.count_if(left_n[k] > 0).alias(f"k{k}") for k in range(folds)],
            *[F.sum(left_n[k]).alias(f"n{k}") for k in range(folds)],
            *[F.sum(left_y[k]).alias(f"y{k}") for k in range(folds)],
            _value_bytes(),
        ).collect()
    }
    few = [
        (k, c) for k in range(folds) for c in columns
        if c in sizes and sizes[c][f"k{k}"] <= spec.encoder.max_onehot
    ]
    wanted = F.lit(False)
    for k, c in few:
        wanted = wanted | ((F.col("feature") == c) & (left_n[k] > 0))
    # At most max_onehot values for each fold and column come back.
    known = counted.where(wanted).select("feature", "value", *[n.alias(f"n{k}") for k, n in enumerate(left_n)])
    known = known.orderBy("feature", "value").collect()
    for k, model in enumerate(models):
        state = model.state
        many = [c for c in columns if c in sizes and (k, c) not in few]
        state["onehot"] = {c[2:]: [] for c in columns if c not in many}
        for r in known:
            if (k, r["feature"]) in few and r[f"n{k}"]:
                state["onehot"][r["feature"][2:]].append(r["value"])
        if many:
            size = sizes[many[0]]
            state["target"] = [c[2:] for c in many]
            state["prior"] = size[f"y{k}"] / size[f"n{k}"]
            state["encoding_rows"] = sum(sizes[c][f"k{k}"] for c in many)
            state["encoding_bytes"] = sum(sizes[c]["bytes"] for c in many)
            encoded = smoothed_mean(left_n[k], left_y[k] / left_n[k], F.lit(state["prior"]), spec.encoder)
            model.encodings = counted.where(F.col("feature").isin(many) & (left_n[k] > 0)).select(
                F.expr("substring(feature, 3)").alias("feature"), "value", encoded.alias("encoded")
            )
    return models


def impute_and_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = numeric_statistics(df, columns)
    return df.withColumns({c: s.apply(F.col(c)) for c, s in zip(columns, stats, strict=True)})


def restore(prepared: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The columns that :func:`prepare` kept, followed by ``extra``."""
    names = [c[2:] for c in prepared.columns if c.startswith("k_")]
    return prepared.select(*[kept(c).alias(c) for c in names], *extra)


class FeatureEncoder(Estimator):
    """Fits medians, means, deviations, vocabularies and target encodings on the rows given to it."""

    labelCol = Param(Params._dummy(), "labelCol", "binary label", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec: FeatureSpec | None = None, labelCol="label", outputCol="features"):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="features")
        self._set(labelCol=labelCol, outputCol=outputCol)
        self.spec = spec or FeatureSpec()

    def _fit(self, dataset: DataFrame) -> FeatureEncoderModel:
        label = self.getOrDefault(self.labelCol)
        rows = prepare(dataset, self.spec, [label]).persist()
        try:
            return self.fit_prepared(rows)
        finally:
            rows.unpersist()

    def fit_prepared(self, prepared: DataFrame) -> FeatureEncoderModel:
        """Fit on rows that already went through :func:`prepare` and kept the label."""
        spec = self.spec
        label = kept(self.getOrDefault(self.labelCol))
        rows = prepared.withColumn("_y", label.cast("double"))
        numeric = [f"x_{c}" for c in spec.all_numeric]
        stats = numeric_statistics(rows, numeric)
        state = _state(spec, stats)
        encodings = None
        if spec.categorical:
            encodings = self._fit_categories(rows, state)
        model = FeatureEncoderModel(state, encodings)
        return model._set(outputCol=self.getOrDefault(self.outputCol))

    def _fit_categories(self, rows: DataFrame, state: dict[str, Any]) -> DataFrame | None:
        spec = self.spec
        columns = [f"x_{c}" for c in spec.categorical]
        # The reduction is used for the cardinalities, the vocabularies and the encodings.
        stats = category_counts(rows, columns, "_y").persist()
        try:
            sizes = {
                r["feature"]: r
                for r in stats.groupBy("feature")
                .agg(F.count("*").alias("k"), F.sum("n").alias("rows"),
                     F.sum(F.col("n") * F.col("mean")).alias("y"), _value_bytes())
                .collect()
            }
            few = [c for c in columns if c in sizes and sizes[c]["k"] <= spec.encoder.max_onehot]
            many = [c for c in columns if c in sizes and sizes[c]["k"] > spec.encoder.max_onehot]
            state["onehot"] = {c[2:]: [] for c in columns if c not in many}
            # At most max_onehot values per column come back.
            for r in stats.where(F.col("feature").isin(few)).orderBy("feature", "value").collect():
                state["onehot"][r["feature"][2:]].append(r["value"])
            if not many:
                return None
            state["target"] = [c[2:] for c in many]
            state["prior"] = sizes[many[0]]["y"] / sizes[many[0]]["rows"]
            state["encoding_rows"] = sum(sizes[c]["k"] for c in many)
            state["encoding_bytes"] = sum(sizes[c]["bytes"] for c in many)
            encoded = smoothed_mean(F.col("n"), F.col("mean"), F.lit(state["prior"]), spec.encoder)
            # Scoring must not depend on the training rows any more.
            return pin(
                stats.where(F.col("feature").isin(many)).select(
                    F.expr("substring(feature, 3)").alias("feature"), "value",
                    encoded.alias("encoded"),
                )
            )
        finally:
            stats.unpersist()


class FeatureEncoderModel(Model, MLWritable, MLReadable):
    """Holds bounded statistics; category encodings, which may be many, stay a table."""

    outputCol = Param(Params._dummy(), "outputCol", "feature vector", TypeConverters.toString)

    def __init__(self, state: dict[str, Any] | None = None, encodings: DataFrame | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self.state = state or {}
        self.encodings = encodings

    @property
    def lineage(self) -> list[tuple[str, str]]:
        """(encoded column, source column) in vector order."""
        pairs = [(row[0], row[0]) for row in self.state["numeric"]]
        for source, values in self.state["onehot"].items():
            pairs += [(f"{source}_{v}", source) for v in values]
        return pairs + [(c, c) for c in self.state["target"]]

    @property
    def feature_names(self) -> list[str]:
        return [name for name, _ in self.lineage]

    @property
    def spec(self) -> FeatureSpec:
        return FeatureSpec.from_dict(self.state["spec"])

    def encode_prepared(self, prepared: DataFrame) -> DataFrame:
        """Append encoded columns ``f0 … fn`` in lineage order."""
        ready = prepared
        for c in self.state["target"]:
            ready = lookup_join(
                ready, self.encoding_of(c), [f"x_{c}"], rows=self.state["encoding_rows"],
                size=self.state.get("encoding_bytes"),
            )
        columns = map(named, prepared.columns)
        return ready.select(*columns, *[c.alias(f"f{i}") for i, c in enumerate(self.encoded_columns())])

    def encoding_of(self, column: str) -> DataFrame:
        """Value and encoding of a column that is encoded by its label mean."""
        return self.encodings.where(F.col("feature") == column).select(
            F.col("value").alias(f"x_{column}"), F.col("encoded").alias(f"t_{column}")
        )

    def encoded_columns(self) -> list[Column]:
        """Expressions over prepared rows that have the ``t_`` columns of :meth:`encoding_of`."""
        out = []
        for name, fill, mean, std in self.state["numeric"]:
            out.append(NumericStats(fill, mean, std).apply(F.col(f"x_{name}")))
        for source, values in self.state["onehot"].items():
            out += [(F.col(f"x_{source}") == F.lit(v)).cast("double") for v in values]
        for c in self.state["target"]:
            out.append(F.coalesce(F.col(f"t_{c}"), F.lit(float(self.state["prior"]))))
        return out

    def assemble(self, prepared: DataFrame, output: str) -> DataFrame:
        """Append the feature vector to prepared rows."""
        names = [f"f{i}" for i in range(len(self.lineage))]
        assembler = VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error")
        return assembler.transform(self.encode_prepared(prepared)).drop(*names)

    def encode(self, dataset: DataFrame) -> DataFrame:
        """Encoded columns ``f0 … fn`` beside the untouched input columns."""
        encoded = self.encode_prepared(prepare(dataset, self.spec, dataset.columns))
        return restore(encoded, [f"f{i}" for i in range(len(self.lineage))])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        output = self.getOrDefault(self.outputCol)
        return restore(
            self.assemble(prepare(dataset, self.spec, dataset.columns), output), [output]
        )

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, instance: FeatureEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(
            self.instance, path, spark, extraMetadata={"state": self.instance.state}
        )
        if self.instance.encodings is not None:
            self.instance.encodings.write.parquet(f"{path}/encodings")


class _EncoderReader(MLReader):
    def load(self, path: str) -> FeatureEncoderModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state = metadata["state"]
        encodings = spark.read.parquet(f"{path}/encodings") if state["target"] else None
        model = FeatureEncoderModel(state, encodings)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
