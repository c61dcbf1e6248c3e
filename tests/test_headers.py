from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earlywarn.operators.headers import MatchSpec, _bag, header_dictionary, mapping_of, match_headers, training_match

# One header for each rule: aliases, the special rule and its second choice, hints, misspellings, guards.
FORMAT_1 = [
    "SEXO", "situacao", "Matrícula", "cidade (município)", "município sisu", "coeficiente_rendimento", "nota enem linguagen",
    "bairro", "telefone",
]
FORMAT_2 = ["Município SiSU", "IRA", "totais semestres cursados", "codigo aluno", "  Sexo "]


def catalogue(spark):
    rows = [(f, i, h) for f, hs in (("one", FORMAT_1), ("two", FORMAT_2)) for i, h in enumerate(hs)]
    return spark.createDataFrame(rows, "file string, position int, header string")


def test_student_headers(spark):
    out = match_headers(catalogue(spark)).cache()
    assert out.count() == 2 * 35
    one, two = mapping_of(out, "one"), mapping_of(out, "two")
    assert one["sexo"] == "SEXO" and two["sexo"] == "  Sexo " and one["situacao"] == "situacao"
    assert one["codigo_aluno"] == "Matrícula" and two["codigo_aluno"] == "codigo aluno"
    assert one["nota_enem_linguagem"] == "nota enem linguagen"
    # Special rule: the municipality header that does not mention the admission system, if there is one.
    assert one["municipio_residencia"] == "cidade (município)" and two["municipio_residencia"] == "Município SiSU"
    assert one["coeficiente_rendimento"] == "coeficiente_rendimento" and two["coeficiente_rendimento"] == "IRA"
    assert two["total_semestres_cursados"] == "totais semestres cursados"
    # The family guard keeps exam grades apart, and what fits nothing serves nothing.
    assert one["nota_vestibular_matematica"] is None and two["nota_enem_humanas"] is None
    assert not {"bairro", "telefone"} & set(one.values())
    stages = {(r["file"], r["field"]): r["matched_by"] for r in out.collect()}
    assert stages["one", "sexo"] == "alias" and stages["two", "codigo_aluno"] == "fuzzy"
    assert stages["one", "municipio_residencia"] == "special"


def test_first_position_wins_and_headers_are_shared(spark):
    spec = MatchSpec(fields=("a_b", "a_c"), aliases={"it's": "a_b"}, hints={"a_c": ["it"]}, special={})
    rows = [("f", 2, "It's"), ("f", 1, "IT'S "), ("g", 0, None), ("g", 1, "zzz")]
    df = spark.createDataFrame(rows, "file string, position int, header string")
    got = {(r["file"], r["field"]): r["header"] for r in match_headers(df, spec).collect()}
    assert got == {("f", "a_b"): "IT'S ", ("f", "a_c"): "IT'S ", ("g", "a_b"): None, ("g", "a_c"): None}


def test_distances_are_taken_once_per_distinct_header(spark):
    headers = catalogue(spark).where("file = 'one'").drop("file")
    many = headers.crossJoin(spark.range(0, 200).select(F.col("id").cast("string").alias("file")))
    assert header_dictionary(many).count() == len(FORMAT_1)
    plan = match_headers(many)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("Exchange hashpartitioning") == 1


@settings(max_examples=60, deadline=None)
@given(st.text("abcz_19é ", max_size=12), st.sampled_from(["ab_c", "zzz", "a1_b9", "c"]))
def test_letters_never_rule_out_what_an_edit_distance_allows(text, name):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    mine, theirs = _bag(text), _bag(name)
    bound = max(abs(len(text) - len(name)), (mine & ~theirs).bit_count(), (theirs & ~mine).bit_count())
    assert bound <= distance(text, name)


def test_training_extracts_match_ids_by_name_only(spark):
    rows = [("t", i, h) for i, h in enumerate(["Matrícula", "Código aluno", "Ano referência", "Periodo referencia"])]
    df = spark.createDataFrame(rows, "file string, position int, header string")
    got = mapping_of(match_headers(df, training_match()), "t")
    assert len(got) == 36
    assert got["codigo_aluno"] == "Código aluno" and got["ano_referencia"] == "Ano referência"
    assert got["periodo_referencia"] == "Periodo referencia"
