import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from earlywarn import functions as fn
from earlywarn.functions.text import clean_categories, fold_accents


def values(spark, items, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build("v")).collect()]


def test_numbers(spark):
    texts = ["0,", "0,3709", "12.5", "2.000,00", "1d", "1f", "inf", "nan", " 7 ", "", None, "Sim", "-3,5e1"]
    want = [0.0, 0.3709, 12.5, None, None, None, None, None, 7.0, None, None, None, -35.0]
    assert values(spark, texts, fn.parse_decimal_comma) == want


def test_grouped_numbers_and_words(spark):
    assert values(spark, ["2.000,00", "166,67", "1.234.567,8", "12", "x"], fn.parse_grouped_decimal) == [
        2000.0, 166.67, 1234567.8, 12.0, None,
    ]
    assert values(spark, ["Sim", " NÃO ", "1", "talvez"], fn.parse_yes_no) == [1.0, 0.0, 1.0, None]


def test_dates(spark):
    texts = ["05/03/2000", "2000-03-05", "5-3-2000", "31/02/2000", "x", None]
    want = [date(2000, 3, 5)] * 3 + [None, None, None]
    assert values(spark, texts, fn.parse_day_first) == want
    ages = values(spark, texts, lambda c: fn.age_in_years(fn.parse_day_first(c), date(2020, 3, 4)))
    assert ages[0] == (date(2020, 3, 4) - date(2000, 3, 5)).days // 365
    assert ages[3] is None


def test_strip_matches_python(spark):
    texts = ["\t a b ", "　x ", "\x1cy\x85", "plain", " "]
    assert values(spark, texts, fn.strip_all) == [t.strip() for t in texts]


def test_accent_fold_matches_python(spark):
    def python(s):
        return unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode("ascii")

    texts = ["Ação", "ÉÈÊË", "ﬁm ½ ™", "Ĳssel", "naïve œuvre æ", "ß ñ ø", "日本", "plain", "Ǆ ǅ", "kK"]
    # The two title- and upper-case digraphs fold through their lower case.
    assert values(spark, texts, fold_accents) == [python(t) for t in texts]
    texts = ["ＡＢＣ", "São…", "㎏", "⒜ ¼", "𝐀𝟗", "Ｆﬃ"]
    assert values(spark, texts, fold_accents) == [python(t) for t in texts]
    every = ["a" + chr(c) + "b" for c in [*range(0x80, 0x3400), *range(0xF900, 0x10000)]
             if not 0xD800 <= c < 0xE000 and chr(c) != "İ"]
    assert values(spark, every, fold_accents) == [python(t) for t in every]


def test_placeholders_and_categories(spark):
    df = spark.createDataFrame([(" NA ",), ("n/a",), ("-",), ("",), (" Não ",), (None,)], "v string")
    assert [r[0] for r in clean_categories(df, ["v"]).collect()] == [None] * 4 + ["nao", None]


def test_scan_tokens_keep_what_the_reader_keeps(spark):
    assert values(spark, ["NA", "null", "", "-", "na", "None"], fn.null_tokens) == [
        None, None, None, "-", "na", None,
    ]


def test_present_sum_and_share(spark):
    df = spark.createDataFrame(
        [(1.0, None, 2.0), (None, None, None), (0.0, 0.0, None)], "a double, b double, c double"
    )
    assert [r[0] for r in df.select(fn.present_sum(["a", "b", "c"])).collect()] == [3.0, None, 0.0]
    assert [r[0] for r in df.select(fn.share("a", "c")).collect()] == [1 / 3, None, None]
    assert df.select(fn.present_sum([])).first()[0] is None


def test_status_and_routes(spark):
    words = ["Formado", " CONCLUÍDO ", "desistente", "Trancado", "Evadido", "Regular", None]
    assert values(spark, words, fn.status_to_binary) == [0, 0, 1, 1, 1, None, None]
    routes = ["SiSU - x", "Enem", "Vestibular", None]
    assert values(spark, routes, lambda c: fn.match_route(c, "enem|sisu")) == [True, True, False, False]


def test_time_keys(spark):
    df = spark.createDataFrame([(2020, 1), (2020, 2), (2021, 1), (2021, None)], "y int, h int")
    assert [r[0] for r in df.select(fn.half_year_index("y", "h")).collect()] == [4040, 4041, 4042, None]
    assert [r[0] for r in df.select(fn.time_index("y", "h")).collect()] == [20201, 20202, 20211, 20211]


@pytest.mark.parametrize("p,label", [(0.3299, "Baixo"), (0.33, "Médio"), (0.3999, "Médio"), (0.4, "Alto"), (None, "Alto")])
def test_risk_label(spark, p, label):
    assert values(spark, [p], fn.risk_label, "double") == [label]


def test_risk_numbers(spark):
    # Halves go to the even neighbour.
    assert values(spark, [0.00125, 0.5, None], fn.risk_percent, "double") == [0.12, 50.0, None]
    assert values(spark, [0.49, 0.5, None], fn.class_at, "double") == [0, 1, None]
    assert values(spark, [0.2, 0.5, 0.66], fn.risk_level, "double") == ["Baixo", "Médio", "Alto"]
    low = values(spark, [0.1, 0.2, 0.5], lambda c: fn.risk_label(c, threshold=0.15), "double")
    assert low == ["Baixo", "Baixo", "Alto"]


def test_no_python_workers_in_cleaning(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("v"))
    plan = clean_categories(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_record_dates(spark):
    texts = ["2000-05-01", "1/5/2000", "01-05-2000", "2000-5-1", "20000501", "1/5/00", "32/1/2000", "", None]
    first = date(2000, 5, 1)
    assert values(spark, texts, lambda c: fn.parse_record_date(c)[0]) == [first] * 4 + [None] * 5
    bad = values(spark, texts, lambda c: fn.parse_record_date(c)[1])
    assert bad == [False] * 4 + [True] * 3 + [False, False]
