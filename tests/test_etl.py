from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.operators.schema import (
    AmbiguousMapping,
    display_order,
    drop_technical,
    dropped_columns,
    ensure_typed,
    model_input,
    plan_renames,
    split_quarantine,
    typed_records,
)
from earlywarn.plans.etl import records_for_scoring, records_for_training
from earlywarn.presets import FEATURE_COLUMNS, SCORING_FIELDS, TECHNICAL_COLUMNS, TRAINING_FIELDS

AS_OF = date(2024, 6, 1)
MAPPING = {
    "codigo_aluno": "Matrícula", "nome_aluno": "Nome", "situacao": "Situação atual",
    "modalidade_ingresso": "Forma de ingresso", "data_nascimento": "Nascimento",
    "coeficiente_rendimento": "C.R.", "nota_enem_humanas": "ENEM H", "turno": None,
}
RAW = [
    ("1", " Ana ", "Regular", "SiSU", "01/06/2000", "0,5", "560,7", "10"),
    ("2", "Bia", "Desistente", "Vestibular", "2001-06-01", "x", "600", None),
    ("3", "Caio", None, "Enem e vestibular", "31/02/1999", "2.000,00", None, "20"),
    ("4", "Davi", "Formado", "Transferência", None, "1", None, "21,5"),
]
COLUMNS = ["Matrícula", "Nome", "Situação atual", "Forma de ingresso", "Nascimento", "C.R.", "ENEM H", "idade"]


@pytest.fixture(scope="module")
def raw(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*COLUMNS, "Cor. ou raça"]])
    return spark.createDataFrame([(*r, "z") for r in RAW], schema)


def test_field_lists():
    assert len(SCORING_FIELDS) == 35 and len(TRAINING_FIELDS) == 36 and len(FEATURE_COLUMNS) == 30


def test_scoring_records(spark, raw):
    clean, dropped = records_for_scoring(raw, MAPPING, as_of=AS_OF)
    assert clean.columns == ["codigo_aluno", "nome_aluno", *FEATURE_COLUMNS, "situacao"]
    assert dropped.columns == ["Cor. ou raça"]
    a, b, c, d = clean.orderBy("codigo_aluno").collect()
    assert (a["nome_aluno"], a["coeficiente_rendimento"], a["nota_enem_humanas"]) == ("ANA", 0.5, 560.7)
    assert a["idade"] == 10.0 and b["idade"] == (AS_OF - date(2001, 6, 1)).days // 365
    assert (c["idade"], d["idade"]) == (20.0, None)  # the given age is read before commas are handled
    assert a["nota_vestibular_fisica"] is None and a["nota_enem_redacao"] == 0.0
    assert b["nota_enem_humanas"] is None and b["nota_vestibular_fisica"] == 0.0
    assert c["nota_enem_humanas"] is None and c["nota_vestibular_fisica"] is None
    assert d["nota_enem_humanas"] == 0.0 and d["nota_vestibular_fisica"] == 0.0
    assert c["coeficiente_rendimento"] is None and b["situacao"] == "Desistente"


def test_kept_and_dropped_cover_the_source(spark, raw):
    clean, dropped = records_for_scoring(raw, MAPPING, as_of=AS_OF)
    kept = {c for c in raw.columns if c not in dropped.columns}
    assert kept | set(dropped.columns) == set(raw.columns)


def test_cleaning_its_own_output_changes_nothing_but_masks(spark, raw):
    once, _ = records_for_scoring(raw, MAPPING, as_of=AS_OF)
    twice, _ = records_for_scoring(once, {}, as_of=AS_OF)
    assert twice.columns == once.columns
    assert once.exceptAll(twice).isEmpty()


def test_grouped_numbers_option(spark, raw):
    clean, _ = records_for_scoring(raw, MAPPING, as_of=AS_OF, thousands=".")
    assert clean.where("codigo_aluno = '3'").first()["coeficiente_rendimento"] == 2000.0


def test_no_shuffle_in_cleaning(raw):
    clean, _ = records_for_scoring(raw, MAPPING, as_of=AS_OF)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_training_records_are_labelled(spark):
    rows = [("a", "2020", "1", "Regular", "9"), ("a", "2020", "2", "Trancado", "8")]
    raw = spark.createDataFrame(
        rows, "matricula string, ano_referencia string, periodo_referencia string, situacao string, CR string"
    )
    df, dropped = records_for_training(raw, {"codigo_aluno": "matricula"}, as_of=AS_OF)
    assert df.columns[:30] == FEATURE_COLUMNS and df.columns[-1] == "situacao"
    got = df.orderBy("periodo_referencia").select("target_evasao", "is_target_valid").collect()
    assert [tuple(r) for r in got] == [(1.0, True), (0.0, False)]
    # In training everything that was not renamed is reported, even columns that are kept.
    assert dropped.columns == ["CR", "ano_referencia", "periodo_referencia", "situacao"]


def test_training_without_history_is_not_labelled(spark):
    raw = spark.createDataFrame([("x", "Regular")], "sexo string, situacao string")
    df, _ = records_for_training(raw, {}, as_of=AS_OF)
    assert "target_evasao" not in df.columns


def test_rename_rules():
    fields = ["a", "b"]
    assert plan_renames(["x", "y"], {"a": "x", "b": None}, fields) == {"x": "a"}
    assert plan_renames(["x", "y"], {"x": "a"}, fields) == {"x": "a"}
    assert plan_renames(["x"], {"a": "x", "b": "x"}, fields) == {"x": "b"}
    with pytest.raises(AmbiguousMapping):
        plan_renames(["a", "x"], {"a": "x"}, fields)


def test_dropped_modes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x int, b int, z int")
    assert dropped_columns(df, {"a": "x"}, ["a", "b"]).columns == ["z"]
    assert dropped_columns(df, {"a": "x"}, ["a", "b"], renamed_only=True).columns == ["b", "z"]
    assert dropped_columns(df.select("b"), {}, ["b"]).columns == []


def test_typed_inputs(spark):
    df = spark.createDataFrame([("1.5", float("nan"), 3)], "a string, b double, c int")
    row = ensure_typed(df, ["a", "b", "missing"], ["c", "absent"]).first()
    assert (row["a"], row["b"], row["missing"], row["c"], row["absent"]) == (1.5, None, None, "3", None)


def test_model_input_and_display(spark):
    df = spark.createDataFrame([(1, "s", 2, 0.5)], "z int, situacao string, a int, prob_evasao double")
    assert model_input(df, ["a", "b"], "situacao").columns == ["a", "b", "situacao"]
    assert display_order(df).columns == ["prob_evasao", "situacao", "z", "a"]
    assert drop_technical(df, TECHNICAL_COLUMNS).columns == ["z", "a", "prob_evasao"]


def test_records_with_errors_are_quarantined(spark):
    schema = T.StructType(
        [T.StructField("born", T.DateType()), T.StructField("n", T.IntegerType()), T.StructField("situacao", T.StringType())]
    )
    rows = [("2000-05-01", "3", "x"), ("01/05/2000", "3.5", "x"), ("", None, "x"), ("May", "4", None)]
    raw = spark.createDataFrame([(*r, "extra") for r in rows], "born string, n string, situacao string, more string")
    good, bad = split_quarantine(typed_records(raw, schema, ["born"], ["situacao"]))
    assert good.columns == ["born", "n", "situacao"] and good.count() == 2
    reasons = sorted(r["_error"] for r in bad.collect())
    assert reasons == ["born: not a date; situacao: required", "n: not a number of its type"]


def test_typed_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_totalprice") > 1).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_decided_rows_only(spark):
    rows = [("a", "2020", "1", "Regular"), ("a", "2020", "2", " TRANCADO")]
    raw = spark.createDataFrame(rows, "codigo_aluno string, ano_referencia string, periodo_referencia string, situacao string")
    df, _ = records_for_training(raw, {}, decided_only=True, as_of=F.lit(AS_OF))
    assert [r["situacao"] for r in df.collect()] == [" TRANCADO"]
