import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from earlywarn.operators.calibration import (
    GBT,
    LOGREG,
    SIGMOID,
    CalibratedModel,
    ModelSpec,
    fit_calibrator,
    fit_ensemble,
    fit_member,
    out_of_fold_scores,
    positive_probability,
    score_by_member,
)
from earlywarn.operators.encoders import EncoderSpec
from earlywarn.operators.features import (
    FeatureEncoder,
    FeatureEncoderModel,
    FeatureSpec,
    Moments,
    engineer,
    fit_complements,
    kept,
    prepare,
)
from earlywarn.operators.filters import UnusableData
from earlywarn.operators.metrics import holdout_metrics
from earlywarn.operators.splits import (
    YearSplit,
    automatic_split,
    cutoff_time,
    hash_fold,
    period_counts,
    random_split,
    usable_folds,
)
from earlywarn.plans.score import score, score_raw
from earlywarn.plans.train import (
    TrainSpec,
    best_prefix,
    draw_trials,
    rungs,
    search,
    train,
    training_rows,
    tune_and_train,
)
from earlywarn.sources.registry import ModelNotFound, importance_of, list_runs, load_model

FAST = ModelSpec(LOGREG, params=(("max_iter", 30),), folds=3)


@pytest.fixture(scope="module")
def students(spark):
    """Labelled snapshots whose outcome depends on grades, failures and town."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        year, half = 2014 + i % 7, 1 + i % 2
        town, grade, failed = rng.randrange(30), rng.random(), rng.randrange(8)
        risk = 0.75 - 0.6 * grade + 0.06 * failed + (0.15 if town < 8 else -0.1)
        rows.append(
            (f"s{i}", year, half, year, half, rng.choice(["F", "m ", "M"]), f"Town {town}", grade,
             float(8 - failed), float(failed), 560.0 if i % 3 else None, float(rng.random() < risk), i % 10 != 0,
             rng.choice(["Regular", "Formado"]))
        )
    return spark.createDataFrame(
        rows,
        "codigo_aluno string, ano_referencia int, periodo_referencia int, ano_ingresso int, "
        "semestre_ingresso int, sexo string, municipio_residencia string, coeficiente_rendimento double, "
        "disciplinas_aprovadas double, disciplinas_reprovadas_nota double, nota_enem_humanas double, "
        "target_evasao double, is_target_valid boolean, situacao string",
    ).repartition(3).cache()


SPLIT = YearSplit((2014, 2017), (2018,), (2019, 2020))


def test_year_split_rules():
    raw = {"train_range": [2014, 2018], "val_year": 2019, "test_years": [2020]}
    split = YearSplit.from_config(raw)
    assert split.years == [*range(2014, 2021)]
    split.validate(range(2014, 2021))
    for change in (
        {"val_year": None}, {"train_range": None}, {"test_years": []}, {"train_range": [2018, 2014]},
        {"train_range": [2014]},
    ):
        with pytest.raises(UnusableData):
            YearSplit.from_config({**raw, **change})
    for bad in (YearSplit((2014, 2019), (2019,), (2020,)), YearSplit((2014, 2016), (2020,), (2020,))):
        with pytest.raises(UnusableData):
            bad.validate(range(2014, 2021))
    with pytest.raises(UnusableData, match="2020"):
        split.validate(range(2014, 2020))


def test_splits_do_not_overlap(students):
    for column in (SPLIT.column(), automatic_split(students, ["codigo_aluno"])[0], random_split(["codigo_aluno"])):
        sides = students.withColumn("s", column).where("s IS NOT NULL")
        per_key = sides.groupBy("codigo_aluno").agg(F.count_distinct("s").alias("k"))
        assert per_key.where("k > 1").isEmpty()
        assert sides.select("s").distinct().count() >= 2


def test_automatic_split(spark, students):
    def cut(df):
        return cutoff_time(period_counts(df, "ano_ingresso", "semestre_ingresso")).first()

    assert tuple(cut(students)) == (14, 20201)
    column, how = automatic_split(students, ["codigo_aluno"])
    assert how == "time"
    late = students.withColumn("s", column).where("s = 'val'").agg(F.min("ano_ingresso")).first()[0]
    assert late == 2020
    few = spark.createDataFrame([(2020, 1, "a"), (2021, 1, "b"), (2022, 1, "c")], "ano_ingresso int, semestre_ingresso int, k string")
    assert cut(few)["cutoff"] == 20221
    assert automatic_split(few, ["k"])[1] == "random"  # too few rows on a side
    assert automatic_split(few.drop("ano_ingresso"), ["k"])[1] == "random"
    assert automatic_split(few.where("ano_ingresso = 2020"), ["k"])[1] == "random"


def test_random_fallback_is_stratified(students):
    column, how = automatic_split(students.drop("ano_ingresso"), ["codigo_aluno"], label="target_evasao")
    assert how == "random"
    rates = students.where("target_evasao IN (0, 1)").withColumn("s", column).groupBy("s").agg(F.avg("target_evasao")).collect()
    assert {r["s"] for r in rates} == {"train", "val"} and abs(rates[0][1] - rates[1][1]) < 0.05


def test_hash_folds_cover_and_balance(students):
    counts = students.groupBy(hash_fold(["codigo_aluno"], 5).alias("f"), "target_evasao").count().collect()
    assert {r["f"] for r in counts} == set(range(5)) and min(r["count"] for r in counts) > 40
    assert usable_folds(5, {"negative": 100, "positive": 3}) == 3


def test_encoder_keeps_empty_columns_and_missing_words(students):
    encoder = FeatureEncoder(labelCol="target_evasao").fit(students)
    state = encoder.state
    assert "nota_vestibular_total" in state["empty"] and "idade" in state["empty"]
    assert state["onehot"]["sexo"] == ["f", "m"] and state["onehot"]["curso"] == ["missing"]
    assert state["target"] == ["municipio_residencia"]
    assert encoder.feature_names[:2] == ["coeficiente_rendimento", "disciplinas_aprovadas"]
    assert dict(encoder.lineage)["sexo_m"] == "sexo"
    out = encoder.transform(students)
    assert out.columns == [*students.columns, "features"]
    assert out.first()["features"].size == len(encoder.feature_names)


def test_encoder_round_trip(spark, students, tmp_path):
    encoder = FeatureEncoder(labelCol="target_evasao", outputCol="v").fit(students)
    encoder.write().save(str(tmp_path / "encoder"))
    back = FeatureEncoderModel.load(str(tmp_path / "encoder"))
    new = students.withColumn("municipio_residencia", F.when(F.col("ano_ingresso") > 2016, F.lit("Nowhere")).otherwise(F.col("municipio_residencia")))
    a, b = encoder.transform(new), back.transform(new)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 900
    nowhere = back.encode(new).where("municipio_residencia = 'Nowhere'")
    index = back.feature_names.index("municipio_residencia")
    assert nowhere.select(f"f{index}").distinct().first()[0] == pytest.approx(back.state["prior"])


def test_large_vocabulary_without_broadcast(students, monkeypatch):
    import earlywarn.operators.lookups as lookups

    encoder = FeatureEncoder(labelCol="target_evasao").fit(students)
    usual = encoder.transform(students)
    monkeypatch.setattr(lookups, "MAX_BROADCAST_ROWS", 5)
    salted = encoder.transform(students)
    assert usual.exceptAll(salted).isEmpty() and salted.count() == 900


def test_totals_exclude_their_own_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 99.0)], "g_a double, g_b double, g_total double")
    spec = FeatureSpec(numeric=("g_a", "g_b", "g_total"), categorical=(), totals=(("g_total", "g_"),), shares=())
    assert engineer(df, spec).first()["g_total"] == 3.0


def test_no_leak_into_encodings(students):
    """Changing validation labels leaves what is fitted on the training side unchanged."""
    column = SPLIT.column()
    flipped = students.withColumn(
        "target_evasao", F.when(column == "val", 1 - F.col("target_evasao")).otherwise(F.col("target_evasao"))
    )
    states = [
        FeatureEncoder(labelCol="target_evasao").fit(d.where(column == "train")) for d in (students, flipped)
    ]
    assert states[0].state == states[1].state
    assert states[0].encodings.exceptAll(states[1].encodings).isEmpty()


@pytest.fixture(scope="module")
def registry(tmp_path_factory):
    return str(tmp_path_factory.mktemp("registry"))


@pytest.fixture(scope="module")
def run(students, registry):
    return train(students, TrainSpec(model=FAST, split=SPLIT), registry=registry, model_id="first")


def test_model_beats_the_base_rate(run, students):
    metrics = run.record["metrics"]
    assert metrics["brier_score"] < metrics["brier_base_rate"]
    assert metrics["roc_auc"] > 0.65
    assert run.validation.select("ano_ingresso").distinct().collect() == [(2018,)]
    assert run.record["validation_strategy"] == "configured_years"
    assert run.record["n_samples"] == students.where("is_target_valid").count()
    assert len(run.model.members) == 3
    top = run.record["feature_importance"]
    assert abs(top[0]["importance"]) >= abs(top[-1]["importance"])
    assert run.record["feature_map"]["sexo"] == ["sexo_f", "sexo_m"]


def test_registry(spark, run, registry):
    row = list_runs(spark, registry).first()
    assert row["model_id"] == "first" and row["metrics"]["roc_auc"] == pytest.approx(run.record["metrics"]["roc_auc"])
    assert importance_of(spark, "first", registry).count() == len(run.record["feature_importance"])
    assert list_runs(spark, registry + "/nothing").isEmpty()
    with pytest.raises(ModelNotFound):
        load_model("absent", registry)


def test_importance_is_rebuilt_from_the_model(spark, run, registry):
    from earlywarn.sources.registry import save_run

    bare = {**run.record, "model_id": "bare", "feature_importance": []}
    save_run(run.model, bare, registry)
    rebuilt = importance_of(spark, "bare", registry).collect()
    assert [r["feature"] for r in rebuilt] == [f["feature"] for f in run.record["feature_importance"]]


def test_saved_model_scores_the_same_and_status_never_leaks(run, registry, students):
    back = load_model("first", registry)
    a = run.model.transform(students)
    b = score(back, students.drop("situacao"))
    c = score(back, students.withColumn("situacao", F.lit("Desistente")))
    assert c.columns[-1] == "prob_evasao" and "situacao" in c.columns
    pairs = (
        a.select("codigo_aluno", F.col("prob_evasao").alias("a"))
        .join(b.select("codigo_aluno", F.col("prob_evasao").alias("b")), "codigo_aluno")
        .join(c.select("codigo_aluno", F.col("prob_evasao").alias("c")), "codigo_aluno")
    )
    assert pairs.count() == 900
    assert pairs.where("abs(a - b) > 1e-12 OR abs(b - c) > 1e-12 OR a NOT BETWEEN 0 AND 1").isEmpty()


def test_raw_rows_to_risk_table(spark, run):
    raw = spark.createDataFrame([("9", "0,2", "Regular", "Town 1")], "codigo string, CR string, status string, municipio string")
    out = score_raw(run.model, raw, {"codigo_aluno": "codigo", "coeficiente_rendimento": "CR", "situacao": "status", "municipio_residencia": "municipio"})
    assert out.columns[:5] == ["codigo_aluno", "risk_label", "risk_pct", "prob_evasao", "situacao"]
    row = out.first()
    assert row["situacao"] == "Regular" and row["risk_label"] in ("Baixo", "Médio", "Alto")


@pytest.mark.parametrize(
    "spec",
    [
        replace(FAST, method=SIGMOID),
        replace(FAST, calibrate=False, storage="table"),
        replace(FAST, storage="table"),
        ModelSpec(GBT, params=(("n_estimators", 5), ("max_depth", 3)), folds=2),
    ],
    ids=["sigmoid", "plain", "from a table", "boosted"],
)
def test_other_models_round_trip(spark, students, tmp_path, spec):
    features = FeatureSpec(
        numeric=("coeficiente_rendimento", "disciplinas_reprovadas_nota"), categorical=("sexo",),
        totals=(), shares=(), encoder=EncoderSpec(),
    )
    model = fit_ensemble(students, "target_evasao", ["codigo_aluno"], features, spec)
    scored = model.transform(students)
    assert holdout_metrics(scored, "prob_evasao", "target_evasao")["roc_auc"] > 0.6
    model.write().save(str(tmp_path / "m"))
    back = CalibratedModel.load(str(tmp_path / "m")).transform(students)
    cols = ["codigo_aluno", F.round("prob_evasao", 9)]
    assert scored.select(*cols).exceptAll(back.select(*cols)).isEmpty()
    assert {n for n, _ in model.members[0].importances()} >= {"coeficiente_rendimento", "sexo_f"}


def test_out_of_fold_scores_every_row_once(students):
    features = FeatureSpec(numeric=("coeficiente_rendimento",), categorical=(), totals=(), shares=())
    oof = out_of_fold_scores(students, "target_evasao", ["codigo_aluno"], features, FAST)
    assert oof.count() == 900 and oof.select("codigo_aluno").distinct().count() == 900
    assert oof.where("fold <> floor(fold) OR prob_evasao IS NULL").isEmpty()
    assert oof.select("fold").distinct().count() == 3


def test_search_and_refit(students):
    spec = TrainSpec(
        model=ModelSpec(GBT, params=(("n_estimators", 4),), folds=2), split=SPLIT, trials=2,
        features=FeatureSpec(numeric=("coeficiente_rendimento",), categorical=(), totals=(), shares=()),
    )
    run = tune_and_train(students, spec)
    assert set(run.record["best_params"]) >= {"num_leaves", "learning_rate", "min_child_samples"}
    assert draw_trials(3, 1) == draw_trials(3, 1) != draw_trials(3, 2)
    for d in draw_trials(50, 0):
        assert 16 <= d["num_leaves"] <= 64 and 0.01 <= d["learning_rate"] <= 0.2
        assert 0.6 <= d["feature_fraction"] <= 0.9 and 20 <= d["min_child_samples"] <= 100


def test_guards(spark, students):
    spec = TrainSpec(model=FAST)
    with pytest.raises(UnusableData, match="labelling"):
        training_rows(students.drop("target_evasao"), spec)
    with pytest.raises(UnusableData, match="ano_ingresso"):
        training_rows(students.drop("ano_ingresso"), replace(spec, split=SPLIT))
    with pytest.raises(UnusableData, match="no rows"):
        train(students.withColumn("is_target_valid", F.lit(False)), spec)
    with pytest.raises(UnusableData, match="other than 0 or 1"):
        train(students.withColumn("target_evasao", F.lit(2.0)), spec)
    with pytest.raises(UnusableData, match="single class"):
        train(students.withColumn("target_evasao", F.lit(0.0)), spec)


def test_positive_class_lookup(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([0.3, 0.7]),)], ["p"])
    assert df.select(positive_probability("p", [0, 1])).first()[0] == 0.7
    assert df.select(positive_probability("p", [1, 0])).first()[0] == 0.3
    assert df.select(positive_probability("p", [0, 2])).first()[0] == 0.7


def test_arriving_files_are_scored_like_a_batch(spark, run, tmp_path):
    from earlywarn.streaming.arrivals import arriving_files, run_with_statistics

    folder = str(tmp_path / "in")
    rows = [(str(i), f"0,{i}", "Regular", f"Town {i}") for i in range(10, 60)]
    names = "codigo string, CR string, situacao string, municipio string"
    raw = spark.createDataFrame(rows, names)
    raw.repartition(3).write.option("header", True).csv(folder)
    mapping = {"codigo_aluno": "codigo", "coeficiente_rendimento": "CR", "municipio_residencia": "municipio"}

    def transform(df):
        return score_raw(run.model, df, mapping).select("codigo_aluno", "prob_evasao", "risk_label")

    target, stats, state = (str(tmp_path / n) for n in ("out", "stats", "state"))
    stream = arriving_files(spark, folder, raw.columns, files_per_batch=2)
    run_with_statistics(stream, transform, target, stats, state).awaitTermination()
    got = spark.read.parquet(target).drop("batch")
    assert got.count() == 50 and got.exceptAll(transform(raw)).isEmpty()
    risk = spark.read.parquet(stats).where("kind = 'risk'")
    assert risk.agg(F.sum("n")).first()[0] == 50 and risk.select("batch").distinct().count() == 2


def test_logistic_regression_matches_the_penalised_optimum(spark):
    """C * sum(w * logloss) + |b|^2 / 2, intercept free, balanced weights: solved by Newton steps."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0] - 1)))).astype(float)
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    a = np.hstack([x, np.ones((400, 1))])
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    beta, c = np.zeros(4), 0.7
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = c * a.T @ (w * (p - y)) + penalty @ beta
        hess = c * (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        beta -= np.linalg.solve(hess, grad)
    from pyspark.ml.linalg import Vectors

    from earlywarn.operators.calibration import build_classifier, with_balanced_weights

    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x.tolist(), y)], ["_features", "t"])
    counts = {"negative": int(400 - y.sum()), "positive": int(y.sum())}
    spec = ModelSpec(params=(("C", c), ("max_iter", 200), ("tol", 1e-10)))
    fitted = build_classifier(spec, 400.0).fit(with_balanced_weights(df, "t", counts))
    assert np.allclose([*fitted.coefficients.toArray(), fitted.intercept], beta, atol=1e-4)


def test_configuration_mapping(students):
    from earlywarn.plans.train import train_from_config

    raw = {
        "model_type": "lightgbm", "model_params": {"n_estimators": 7}, "calibration_cv": 3,
        "calibration_method": "sigmoid", "random_state": 1, "version": "2.0.0", "optimize_trials": 4,
        "split_config": {"train_range": [2014, 2017], "val_year": 2018, "test_year": 2019},
    }
    spec = TrainSpec.from_config(raw)
    assert (spec.model.kind, spec.model.folds, spec.model.seed, spec.trials) == (GBT, 3, 1, 4)
    assert spec.split == YearSplit((2014, 2017), (2018,), (2019,)) and spec.version == "2.0.0"
    assert TrainSpec.from_config({}) == TrainSpec()
    with pytest.raises(UnusableData):
        TrainSpec.from_config({"model_type": "svm"})
    # A table read back from CSV is all text.
    text = students.select(*[F.col(c).cast("string").alias(c) for c in students.columns])
    features = FeatureSpec(numeric=("coeficiente_rendimento",), categorical=(), totals=(), shares=())
    run = train_from_config(text, {"calibrate": False, "version": "3"}, features=features)
    assert run.record["version"] == "3" and run.record["metrics"]["roc_auc"] > 0.6


def test_score_file(spark, run, registry, tmp_path):
    from earlywarn.plans.score import score_file

    with open(tmp_path / "new.csv", "w") as f:
        f.write("codigo;CR;municipio\n1;0,9;Town 3\n2;0,1;Town 20\n")
    mapping = {"codigo_aluno": "codigo", "coeficiente_rendimento": "CR", "municipio_residencia": "municipio"}
    target = str(tmp_path / "scored")
    score_file(spark, str(tmp_path / "new.csv"), "first", registry, target, mapping)
    got = {r["codigo_aluno"]: r for r in spark.read.json(target).collect()}
    assert set(got) == {"1", "2"} and got["1"]["prob_evasao"] < got["2"]["prob_evasao"]


def test_canonical_schema():
    from earlywarn.presets import SCORING_FIELDS, canonical_schema

    schema = canonical_schema(SCORING_FIELDS)
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}
    assert schema.names == SCORING_FIELDS and all(f.nullable for f in schema.fields)
    assert (kinds["idade"], kinds["data_nascimento"], kinds["sexo"]) == ("long", "date", "string")
    assert kinds["nota_enem_redacao"] == "double"


def test_patience_keeps_the_best_prefix():
    falling = [1.0 / (i + 1) for i in range(60)]
    assert best_prefix(falling) == (60, False)
    assert best_prefix([*falling, *[0.5] * 50]) == (60, True)
    assert best_prefix([*falling, *[0.5] * 49, 0.001]) == (110, False)
    assert best_prefix([3.0, 2.0, 2.5, 2.5], patience=2) == (2, True)


def test_slow_learning_rates_keep_more_than_one_tree(students):
    spec = TrainSpec(
        model=ModelSpec(GBT, params=(("n_estimators", 20),)), split=SPLIT, trials=3,
        features=FeatureSpec(numeric=("coeficiente_rendimento",), categorical=(), totals=(), shares=()),
    )
    rows = search(students, spec).collect()
    slow = min(rows, key=lambda r: float(r["params"]["learning_rate"]))
    assert int(slow["params"]["n_estimators"]) > 1


@pytest.mark.parametrize("max_onehot", [20, 2])
def test_complements_equal_single_fits(students, max_onehot):
    spec = FeatureSpec(encoder=EncoderSpec(max_onehot=max_onehot))
    marked = students.withColumn("_fold", hash_fold(["codigo_aluno"], 3))
    prepared = prepare(marked, spec, marked.columns).persist()
    for k, model in enumerate(fit_complements(prepared, spec, "target_evasao", kept("_fold"), 3)):
        alone = FeatureEncoder(spec=spec, labelCol="target_evasao").fit_prepared(prepared.where(kept("_fold") != k))
        for (name, *mine), (other, *theirs) in zip(model.state["numeric"], alone.state["numeric"], strict=True):
            assert name == other and mine == pytest.approx(theirs, rel=1e-9, abs=1e-12)
        for part in ("empty", "onehot", "target", "encoding_rows", "spec"):
            assert model.state[part] == alone.state[part]
        assert model.state["prior"] == pytest.approx(alone.state["prior"], rel=1e-12)
        if alone.encodings is not None:
            mine, theirs = (
                {(r.feature, r.value): r.encoded for r in m.encodings.collect()} for m in (model, alone)
            )
            assert mine == pytest.approx(theirs, rel=1e-9)
    prepared.unpersist()


def test_statistics_of_all_folds_read_as_often_as_those_of_two(spark, students):
    def reads(folds):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        marked = students.withColumn("_fold", hash_fold(["codigo_aluno"], folds))
        prepared = prepare(marked, FeatureSpec(), marked.columns)
        fit_complements(prepared.mapInArrow(count, prepared.schema), FeatureSpec(), "target_evasao", kept("_fold"), folds)
        return seen.value

    assert reads(6) == reads(2) <= 5 * 900


def test_moments_merge_like_their_rows():
    rng = random.Random(5)
    parts = [[rng.gauss(1e6, 1) for _ in range(n)] for n in (40, 1, 0, 300)]
    total = Moments()
    for part in parts:
        if part:
            mean = sum(part) / len(part)
            total += Moments(len(part), mean, sum((x - mean) ** 2 for x in part))
    values = [x for part in parts for x in part]
    mean = sum(values) / len(values)
    assert total.n == len(values) and total.mean == pytest.approx(mean)
    assert total.squares == pytest.approx(sum((x - mean) ** 2 for x in values), rel=1e-6)
    assert Moments() + Moments() == Moments()


@pytest.mark.parametrize("spec", [FAST, ModelSpec(GBT, params=(("n_estimators", 4), ("max_depth", 2)), folds=2)])
def test_out_of_fold_is_one_scan_by_each_rows_own_member(spark, students, tmp_path, spec):
    path = str(tmp_path / "students")
    students.write.parquet(path)
    rows = spark.read.parquet(path)
    features = FeatureSpec(encoder=EncoderSpec(max_onehot=5))
    marked = rows.withColumn("_fold", hash_fold(["codigo_aluno"], spec.folds))
    prepared = prepare(marked, features, marked.columns)
    encoders = fit_complements(prepared, features, "target_evasao", kept("_fold"), spec.folds)
    counts = {"negative": 450, "positive": 450}
    members = [
        fit_member(prepared.where(kept("_fold") != k), "target_evasao", features, spec, counts, encoders[k])
        for k in range(spec.folds)
    ]
    routed = score_by_member(prepared, "k__fold", members, "p")
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    mine = {r.k_codigo_aluno: r.p for r in routed.select("k_codigo_aluno", "p").collect()}
    apart = {}
    for k, m in enumerate(members):
        own = m.score_prepared(prepared.where(kept("_fold") == k), "p")
        apart |= {r.k_codigo_aluno: r.p for r in own.select("k_codigo_aluno", "p").collect()}
    assert len(mine) == 900 and mine == pytest.approx(apart, rel=1e-12)


def test_rungs_grow_as_trials_drop():
    assert [(r.trials, r.trees, r.share) for r in rungs(20, 1000, 10_000_000)] == [
        (20, 11, pytest.approx(1 / 9)), (7, 33, pytest.approx(1 / 3)), (3, 1000, 1.0)
    ]
    assert [(r.trials, r.trees, r.share) for r in rungs(3, 6, 500)] == [(3, 5, 1.0), (1, 6, 1.0)]
    assert [r.trials for r in rungs(1, 10, 500)] == [1]


def test_halving_finds_as_good_a_trial_with_fewer_trees(students, monkeypatch):
    from earlywarn.plans import train as plans

    grown = []
    original = plans.build_classifier

    def counting(spec, total):
        grown.append(spec.options["n_estimators"])
        return original(spec, total)

    monkeypatch.setattr(plans, "build_classifier", counting)
    spec = TrainSpec(keys=("codigo_aluno",), model=ModelSpec(GBT, params=(("n_estimators", 27),)), trials=9, split=SPLIT)
    found = search(students, spec).collect()
    halved, grown[:] = sum(grown), []
    assert sorted(r.trial for r in found) == list(range(9))
    assert [r.rung for r in found] == [2] + [1] * 2 + [0] * 6
    assert search(students, spec).collect() == found
    grown.clear()
    monkeypatch.setattr(plans, "HALVING", 10)  # every trial at once
    whole = search(students, spec).collect()
    assert {r.rung for r in whole} == {0} and halved < 0.5 * sum(grown)
    assert found[0].loss <= whole[0].loss + 0.03


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_held_out_rows_are_scored_once_for_a_calibrator(spark, method):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(0, 2_000, 1, 4).select(
        ((F.col("id") * 37 % 2_000 + 0.5) / 2_000).alias("_p"), (F.col("id") * 11 % 2_000 < F.col("id")).cast("double").alias("_y")
    )
    scored = rows.mapInPandas(noted, rows.schema)
    fit_calibrator(scored, "_y", method)
    assert seen.value == 2_000
