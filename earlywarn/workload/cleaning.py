"""Parsing, cleaning, projections, header matching, files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.functions import (
    age_in_years,
    blank_placeholders,
    clean_categories,
    first_present,
    fold_accents,
    parse_day_first,
    parse_decimal_comma,
    parse_grouped_decimal,
    parse_number,
    parse_yes_no,
    present_sum,
    share,
    upper_trimmed,
)
from earlywarn.operators.headers import MatchSpec, match_headers
from earlywarn.operators.labels import LabelSpec
from earlywarn.operators.schema import (
    display_order,
    drop_technical,
    dropped_columns,
    model_input,
    typed_records,
)
from earlywarn.plans.etl import fill_and_mask_grades, records_for_scoring, records_for_training
from earlywarn.presets import RecordPreset, RouteRule, short_record_schema
from earlywarn.session import scratch_path
from earlywarn.sources.files import (
    DROP,
    header_catalogue,
    contract_report,
    malformed_rows,
    read_delimited,
    unreadable_files,
    write_clean_and_dropped,
    write_delimited,
    write_records,
)
from earlywarn.workload.registry import (
    LABELLED_ORDERS_SQL,
    order_history,
    query,
    r6,
    table,
)


@query(
    "comma_decimal",
    "SELECT o_orderkey, round(o_totalprice, 6) AS price FROM orders",
)
def comma_decimal(spark, sf_dir):
    text = F.concat(F.lit(" "), F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r6(parse_decimal_comma(text)).alias("price")
    )


@query(
    "bad_numbers",
    """SELECT event_id, CASE event_type WHEN 'view' THEN value WHEN 'click' THEN -value END AS parsed
FROM events""",
)
def bad_numbers(spark, sf_dir):
    # Forms that must not become numbers: a type suffix, infinity, plain words.
    shown = F.col("value").cast("string")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("+"), shown, F.lit("\t")))
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), shown))
        .when(F.col("event_type") == "error", F.concat(shown, F.lit("d")))
        .when(F.col("event_type") == "signup", F.lit("inf"))
        .otherwise(F.lit("n/a"))
    )
    return table(spark, sf_dir, "events").select("event_id", parse_number(text).alias("parsed"))


@query(
    "grouped_decimal",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem",
)
def grouped_decimal(spark, sf_dir):
    text = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", parse_grouped_decimal(text).alias("price")
    )


@query(
    "yes_no_words",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 0e0
       ELSE round(o_totalprice, 6) END AS flag FROM orders""",
)
def yes_no_words(spark, sf_dir):
    text = (
        F.when(F.col("o_orderstatus") == "F", F.lit(" SIM"))
        .when(F.col("o_orderstatus") == "O", F.lit("Não"))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(parse_yes_no(text)).alias("flag"))


@query(
    "dayfirst_age",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey % 90 AS DOUBLE)
  ELSE CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365e0) AS DOUBLE) END AS age
FROM orders""",
)
def dayfirst_age(spark, sf_dir):
    shape = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    given = F.when(
        F.col("o_orderstatus") == "P", (F.col("o_custkey") % 90).cast("string")
    ).otherwise(F.lit("unknown"))
    age = first_present(parse_number(given), age_in_years(parse_day_first(shape), date(2002, 1, 1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"))


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "accent_clean",
    f"""WITH s AS (SELECT doc_id, source, {_STRIPPED} AS t FROM documents)
SELECT doc_id, upper(source) AS source,
  CASE WHEN lower(t) IN ('na', 'n/a', '-', '') THEN NULL
       ELSE regexp_replace(strip_accents(lower(t)), '[^\\x00-\\x7F]', '', 'g') END AS cleaned
FROM s""",
)
def accent_clean(spark, sf_dir):
    docs = clean_categories(table(spark, sf_dir, "documents"), ["text"])
    source = upper_trimmed(F.concat(F.lit("  "), "source", F.lit("\t")))
    return docs.select("doc_id", source.alias("source"), F.col("text").alias("cleaned"))


@query(
    "accent_wide",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'abc ' WHEN 1 THEN 'sao... ' WHEN 2 THEN '5kg 1' ELSE 'ffi (a)TM ' END
  || CASE WHEN p_partkey % 4 = 2 THEN '4 ' ELSE '' END || lower(p_name) AS folded FROM part""",
)
def accent_wide(spark, sf_dir):
    """Full-width letters, the ellipsis, unit signs, fractions and ligatures fold to all their letters."""
    shown = F.array(*map(F.lit, ("ＡＢＣ ", "São… ", "5㎏ ¼ ", "ﬃ ⒜™ ")))
    part = table(spark, sf_dir, "part")
    text = F.concat(F.get(shown, (F.col("p_partkey") % 4).cast("int")), "p_name").alias("text")
    folded = F.translate(fold_accents("text"), "/", "")
    return part.select("p_partkey", text).select("p_partkey", folded.alias("folded"))


@query(
    "lenient_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def lenient_dates(spark, sf_dir):
    """Dates with a time of day, slashes, dots and two-digit years."""
    formats = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy/M/d", "d/M/yy", "d.M.yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    kind, text = F.col("o_orderkey") % len(formats), F.lit(None)
    for i, fmt in enumerate(formats):
        text = F.when(kind == i, F.date_format("o_orderdate", fmt)).otherwise(text)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", parse_day_first("text").alias("day"))


@query(
    "placeholders",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'keep' END AS word FROM events""",
)
def placeholders(spark, sf_dir):
    text = (
        F.when(F.col("event_type") == "view", F.lit(" NA "))
        .when(F.col("event_type") == "click", F.lit("n/A"))
        .when(F.col("event_type") == "error", F.lit("\t-"))
        .when(F.col("event_type") == "signup", F.lit(" keep"))
        .otherwise(F.lit("  "))
    )
    return table(spark, sf_dir, "events").select("event_id", blank_placeholders(text).alias("word"))


_MASK = RecordPreset(
    fields=(), features=(), status="", decimals=(), uppers=(), grade_prefix="g_", route="p_type",
    route_rules=(RouteRule("promo|economy", ("g_price",)), RouteRule("medium|promo", ("g_size",))),
)


@query(
    "route_mask",
    """SELECT p_partkey,
  CASE WHEN p_type IS NOT NULL AND regexp_matches(lower(p_type), 'promo|economy') THEN NULL
       ELSE coalesce(p_retailprice, 0e0) END AS g_price,
  CASE WHEN p_type IS NOT NULL AND regexp_matches(lower(p_type), 'medium|promo') THEN NULL
       ELSE coalesce(CAST(nullif(p_size, 10) AS DOUBLE), 0e0) END AS g_size
FROM (SELECT p_partkey, nullif(p_type, 'LARGE') AS p_type, p_retailprice, p_size FROM part)""",
)
def route_mask(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("LARGE")).alias("p_type"),
        F.col("p_retailprice").alias("g_price"),
        F.nullif("p_size", F.lit(10)).cast("double").alias("g_size"),
    )
    return fill_and_mask_grades(df, _MASK).drop("p_type")


@query(
    "null_aware_sum",
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 25 THEN l_quantity END AS a,
                      nullif(l_discount, 0) AS b, nullif(l_tax, 0) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN coalesce(a, b, c) IS NOT NULL
       THEN round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) END AS total FROM n""",
)
def null_aware_sum(spark, sf_dir):
    parts = [
        F.when(F.col("l_quantity") >= 25, F.col("l_quantity")),
        F.when(F.col("l_discount") != 0, F.col("l_discount")),
        F.when(F.col("l_tax") != 0, F.col("l_tax")),
    ]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(present_sum(parts)).alias("total")
    )


@query(
    "approval_ratio",
    """WITH n AS (SELECT o_custkey, count_if(o_orderstatus = 'O') AS ok, count_if(o_orderstatus = 'F') AS bad
           FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(ok / CAST(nullif(ok + bad, 0) AS DOUBLE), 6) AS ratio FROM n""",
)
def approval_ratio(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("ok"),
        F.count_if(F.col("o_orderstatus") == "F").alias("bad"),
    )
    return counts.select("o_custkey", r6(share("ok", "bad")).alias("ratio"))


# Source header -> how it is named in the raw extract rendered from the orders table.
MAPPING = {
    "codigo_aluno": "Matrícula",
    "situacao": "Situação atual",
    "modalidade_ingresso": "Forma de ingresso",
    "Campus": "campus",
    "data_nascimento": "Data de nascimento",
    "coeficiente_rendimento": "Coeficiente de rendimento absoluto",
    "nota_enem_humanas": "Nota ENEM Humanas",
    "nota_vestibular_biologia": "Nota Vestibular Biologia",
    "ano_ingresso": "Ano de ingresso",
    "tipo_cota": None,
}


def raw_extract(spark, sf_dir):
    """Orders rendered as a loosely formatted extract: every column is text."""
    price = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Matrícula"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" Desistente "))
        .when(F.col("o_orderstatus") == "P", F.lit("Formado")).otherwise(F.lit("Regular"))
        .alias("Situação atual"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("SiSU - Sistema Unificado"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(" vestibular"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Enem e Vestibular"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("Transferência"))
        .alias("Forma de ingresso"),
        F.lower("o_orderpriority").alias("Campus"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data de nascimento"),
        price.alias("Coeficiente de rendimento absoluto"),
        F.when(F.col("o_orderstatus") != "O", price).alias("Nota ENEM Humanas"),
        price.alias("Nota Vestibular Biologia"),
        F.year("o_orderdate").cast("string").alias("Ano de ingresso"),
        F.lit("x").alias("Sede"),
        F.col("o_custkey").cast("string").alias("Cor ou raça"),
        F.col("o_custkey").cast("string").alias("cliente"),
    )


@query(
    "etl_chain",
    """SELECT CAST(o_orderkey AS VARCHAR) AS codigo_aluno,
  CASE o_orderstatus WHEN 'F' THEN ' Desistente ' WHEN 'P' THEN 'Formado' ELSE 'Regular' END AS situacao,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SISU - SISTEMA UNIFICADO' WHEN '2-HIGH' THEN 'VESTIBULAR'
    WHEN '3-MEDIUM' THEN 'ENEM E VESTIBULAR' WHEN '5-LOW' THEN 'TRANSFERÊNCIA' END AS modalidade_ingresso,
  upper(o_orderpriority) AS campus,
  CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365e0) AS DOUBLE) AS idade,
  round(o_totalprice, 6) AS coeficiente_rendimento,
  CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN NULL
       WHEN o_orderstatus = 'O' THEN 0e0 ELSE round(o_totalprice, 6) END AS nota_enem_humanas,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN NULL
       ELSE round(o_totalprice, 6) END AS nota_vestibular_biologia,
  CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN NULL ELSE 0e0 END AS nota_enem_redacao,
  CAST(year(o_orderdate) AS DOUBLE) AS ano_ingresso, CAST(NULL AS VARCHAR) AS tipo_cota,
  CAST(NULL AS DOUBLE) AS calouro
FROM orders""",
)
def etl_chain(spark, sf_dir):
    clean, _ = records_for_scoring(raw_extract(spark, sf_dir), MAPPING, as_of=date(2002, 1, 1))
    rounded = ("coeficiente_rendimento", "nota_enem_humanas", "nota_vestibular_biologia")
    return clean.withColumns({c: r6(c) for c in rounded}).select(
        "codigo_aluno", "situacao", "modalidade_ingresso", "campus", "idade", *rounded,
        "nota_enem_redacao", "ano_ingresso", "tipo_cota", "calouro",
    )


@query(
    "etl_training",
    f"""WITH {LABELLED_ORDERS_SQL}
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(year AS BIGINT) AS ano_referencia,
       CAST(half AS BIGINT) AS periodo_referencia, round(o_totalprice, 6) AS coeficiente_rendimento,
       target_evasao, is_target_valid, st AS situacao FROM labelled""",
)
def etl_training(spark, sf_dir):
    raw = order_history(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("codigo"),
        F.col("year").cast("string").alias("ano_referencia"),
        F.col("half").cast("string").alias("periodo_referencia"),
        F.lower("o_orderstatus").alias("situacao"),
        F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")).alias("CR"),
        F.col("o_orderkey").alias("periodo"),
    )
    spec = LabelSpec(events=("f",), terminals=("f", "p"), tie=("periodo",))
    mapping = {"codigo_aluno": "codigo", "coeficiente_rendimento": "CR"}
    df, _ = records_for_training(raw, mapping, label=spec)
    return df.select(
        F.col("periodo").alias("o_orderkey"),
        F.col("ano_referencia").cast("bigint").alias("ano_referencia"),
        F.col("periodo_referencia").cast("bigint").alias("periodo_referencia"),
        r6("coeficiente_rendimento").alias("coeficiente_rendimento"),
        "target_evasao", "is_target_valid", "situacao",
    )


_CUSTOMER_MAP = {"nome": "c_name", "codigo": "c_custkey", "saldo": None}
_CUSTOMER_FIELDS = ("nome", "codigo", "c_mktsegment")


@query("dropped_audit", "SELECT c_acctbal, c_nationkey FROM customer")
def dropped_audit(spark, sf_dir):
    return dropped_columns(table(spark, sf_dir, "customer"), _CUSTOMER_MAP, _CUSTOMER_FIELDS)


@query("dropped_audit_renamed", "SELECT c_acctbal, c_mktsegment, c_nationkey FROM customer")
def dropped_audit_renamed(spark, sf_dir):
    return dropped_columns(
        table(spark, sf_dir, "customer"), _CUSTOMER_MAP, _CUSTOMER_FIELDS, renamed_only=True
    )


@query(
    "model_input",
    """SELECT c_mktsegment, CAST(NULL AS VARCHAR) AS absent, c_acctbal, c_name AS situacao FROM customer""",
)
def ordered_input(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumnRenamed("c_name", "situacao")
    return model_input(df, ["c_mktsegment", "absent", "c_acctbal"], "situacao")


@query("display_order", "SELECT c_custkey AS codigo_aluno, c_name AS situacao, c_acctbal FROM customer")
def shown_first(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_acctbal", F.col("c_name").alias("situacao"), F.col("c_custkey").alias("codigo_aluno"),
        F.lit(None).alias("is_target_valid"),
    )
    return display_order(drop_technical(df, ["is_target_valid", "target_evasao"]))


@query(
    "record_dates",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL
         ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS born,
  CAST(event_id AS BIGINT) AS age,
  CASE WHEN event_type = 'error' THEN 'born: not a date' END AS problem FROM events""",
)
def record_dates(spark, sf_dir):
    text = (
        F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "click", F.date_format("ts", "dd/MM/yyyy"))
        .when(F.col("event_type") == "purchase", F.date_format("ts", "dd-MM-yyyy"))
        .when(F.col("event_type") == "error", F.lit("someday"))
        .otherwise(F.lit(""))
    )
    raw = table(spark, sf_dir, "events").select(
        "event_id", text.alias("born"), F.col("event_id").cast("string").alias("age"), "props"
    )
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("born", T.DateType()),
         T.StructField("age", T.LongType())]
    )
    df = typed_records(raw, schema, dates=["born"], required=["age"], error="problem")
    return df.withColumn("born", F.col("born").cast("string"))


_MATCH = MatchSpec(
    fields=("ring_size", "bolt_code", "widget_red", "gizmo", "cold_gear", "nothing"),
    aliases={"small ring": "ring_size", "old ring": "ring_size", "hot rod": None, "red gizmo": "bolt_code"},
    hints={"bolt_code": ("bolt", "cold", "new")},
    families=("widget",),
    special={"gizmo": ("gizmo", "old")},
    threshold=60.0,
)

_FUZZY_SQL = """greatest(
  100e0 * (1e0 - levenshtein(replace(f, '_', ' '), n) / CAST(greatest(length(f), length(n)) AS DOUBLE)),
  100e0 * (1e0 - levenshtein(array_to_string(list_sort(string_split(replace(f, '_', ' '), ' ')), ' '),
                             array_to_string(list_sort(string_split(n, ' ')), ' '))
           / CAST(greatest(length(f), length(n)) AS DOUBLE)))"""


@query(
    "mapping_suggest",
    f"""WITH cat AS (
  SELECT DISTINCT l_suppkey AS file, l_partkey AS position, upper(p_name) AS header, p_name AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
fields(f) AS (VALUES ('ring_size'), ('bolt_code'), ('widget_red'), ('gizmo'), ('cold_gear'), ('nothing')),
distinct_names AS (SELECT DISTINCT n FROM cat),
scored AS (
  SELECT n, f, CASE WHEN n IN ('small ring', 'old ring') AND f = 'ring_size' THEN TRUE
                    WHEN n = 'red gizmo' AND f = 'bolt_code' THEN TRUE ELSE FALSE END AS is_alias,
         f = 'gizmo' AND contains(n, 'gizmo') AS is_special,
         CASE WHEN f = 'bolt_code' THEN CAST(contains(n, 'bolt') AS INT) + CAST(contains(n, 'cold') AS INT)
              + CAST(contains(n, 'new') AS INT) ELSE 0 END AS hints,
         NOT contains(f, 'widget') OR contains(n, 'widget') AS allowed,
         {_FUZZY_SQL} AS fuzzy
  FROM distinct_names, fields),
staged AS (
  SELECT n, f, CASE WHEN is_alias THEN 4 WHEN NOT allowed THEN NULL WHEN is_special THEN 3
                    WHEN hints > 0 THEN 2 WHEN fuzzy >= 60 THEN 1 END AS stage,
         CASE WHEN is_alias THEN 0 WHEN is_special THEN CASE WHEN contains(n, 'old') THEN 0 ELSE 1 END
              WHEN hints > 0 THEN hints ELSE fuzzy END AS grade
  FROM scored),
ranked AS (
  SELECT file, f, header, stage, grade,
         row_number() OVER (PARTITION BY file, f ORDER BY stage DESC, grade DESC, position) AS k
  FROM cat JOIN staged USING (n) WHERE stage IS NOT NULL)
SELECT c.file, fields.f AS field, r.header,
  CASE r.stage WHEN 4 THEN 'alias' WHEN 3 THEN 'special' WHEN 2 THEN 'hint' WHEN 1 THEN 'fuzzy' END AS matched_by,
  round(CAST(r.grade AS DOUBLE), 6) AS grade
FROM (SELECT DISTINCT file FROM cat) c CROSS JOIN fields
LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON r.file = c.file AND r.f = fields.f""",
)
def mapping_suggest(spark, sf_dir):
    # One header catalogue per supplier: the names of the parts it ships, accents added.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    shipped = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    catalogue = shipped.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("position"),
        F.translate(F.upper("p_name"), "OI", "ÓÎ").alias("header"),
    )
    df = match_headers(catalogue, _MATCH)
    return df.select(
        "file", "field", F.translate("header", "ÓÎ", "OI").alias("header"), "matched_by",
        r6("grade").alias("grade"),
    )


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "customers")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("N/A")).otherwise(F.col("c_mktsegment"))
    balance = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    out = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", balance.alias("c_acctbal"), segment.alias("segment")
    )
    write_delimited(out, path, sep=";")
    back = read_delimited(spark, path)
    return back.select(
        F.col("c_custkey").try_cast("bigint").alias("c_custkey"), "c_name",
        parse_decimal_comma("c_acctbal").alias("c_acctbal"), "segment",
    )


@query("csv_pruned_scan", "SELECT c_acctbal, c_custkey FROM customer WHERE c_acctbal > 5000")
def csv_pruned_scan(spark, sf_dir):
    path = scratch_path(spark, "customers-pruned")
    write_delimited(table(spark, sf_dir, "customer"), path)
    df = read_delimited(spark, path, columns=["c_custkey", "c_acctbal"])
    return df.select(
        F.col("c_custkey").try_cast("bigint").alias("c_custkey"),
        parse_number("c_acctbal").alias("c_acctbal"),
    ).where("c_acctbal > 5000")


@query(
    "clean_and_dropped",
    """SELECT 'clean' AS kind, CAST(o_orderkey AS VARCHAR) AS first, CAST(year(o_orderdate) AS VARCHAR) || '.0' AS second
FROM orders UNION ALL SELECT 'dropped', CAST(o_custkey AS VARCHAR), 'x' FROM orders""",
)
def clean_and_dropped(spark, sf_dir):
    clean, dropped = records_for_scoring(raw_extract(spark, sf_dir), MAPPING, as_of=date(2002, 1, 1))
    kept, left = write_clean_and_dropped(clean, dropped, scratch_path(spark, "cleaned"))
    a = read_delimited(spark, kept, ",").selectExpr(
        "'clean' AS kind", "codigo_aluno AS first", "ano_ingresso AS second"
    )
    b = read_delimited(spark, left, ",").selectExpr(
        "'dropped' AS kind", "cliente AS first", "Sede AS second"
    )
    return a.unionByName(b)


@query(
    "short_records",
    """SELECT o_orderkey AS id_aluno, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END
  AS data_nascimento, CAST(year(o_orderdate) AS BIGINT) AS ano_letivo, lower(o_orderpriority) AS serie,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS situacao,
  CASE WHEN o_orderstatus = 'O' THEN 'situacao: required' WHEN o_orderstatus = 'P' THEN 'data_nascimento: not a date' END AS problem
FROM orders""",
)
def short_records(spark, sf_dir):
    shown = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd-MM-yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "MMM d"))
    )
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id_aluno"), shown.alias("data_nascimento"),
        F.year("o_orderdate").cast("string").alias("ano_letivo"),
        F.lower("o_orderpriority").alias("serie"),
        F.nullif("o_orderstatus", F.lit("O")).alias("situacao"), F.lit("-").alias("unknown"),
    )
    df = typed_records(raw, short_record_schema(), ["data_nascimento"], ["situacao"], "problem")
    return df.select(
        "id_aluno", F.col("data_nascimento").cast("string").alias("data_nascimento"), "ano_letivo",
        "serie", "situacao", "problem",
    )


@query(
    "header_scan",
    """SELECT * FROM (VALUES ('orders', 0, 'o_orderkey'), ('orders', 1, 'o_custkey'),
  ('orders', 2, 'o_orderstatus'), ('orders', 3, 'o_totalprice'), ('orders', 4, 'o_orderdate'),
  ('orders', 5, 'o_orderpriority'), ('customer', 0, 'c_custkey'), ('customer', 1, 'c_name'),
  ('customer', 2, 'c_nationkey'), ('customer', 3, 'c_acctbal'), ('customer', 4, 'c_mktsegment'),
  ('region', 0, 'r_regionkey'), ('region', 1, 'r_name'), ('broken', -1, 'unreadable'))
  AS t(name, position, header)""",
)
def header_scan(spark, sf_dir):
    root = scratch_path(spark, "landing")
    for name, sep in (("orders", ","), ("customer", ";"), ("region", "|")):
        write_delimited(table(spark, sf_dir, name), f"{root}/{name}", sep=sep)
    latin = table(spark, sf_dir, "region").select(F.lit("ação,é").alias("value")).limit(1)
    latin.coalesce(1).write.option("encoding", "ISO-8859-1").csv(f"{root}/broken", encoding="ISO-8859-1")
    name = F.element_at(F.split("file", "/"), -2).alias("name")
    found = header_catalogue(spark, f"{root}/*").select(name, "position", "header").distinct()
    bad = unreadable_files(spark, f"{root}/*").select(
        name, F.lit(-1).alias("position"), F.lit("unreadable").alias("header")
    )
    return found.unionByName(bad)


@query(
    "contract_report",
    """WITH f AS (SELECT o_orderkey % 4 AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT 'half' AS name, 'critical column missing' AS rule, 'o_orderstatus' AS "column", n AS rows FROM f WHERE k = 1
UNION ALL SELECT 'half', 'column missing', 'o_totalprice', n FROM f WHERE k = 1
UNION ALL SELECT 'plain', 'not a .csv file', '', n FROM f WHERE k = 2
UNION ALL SELECT 'twice', 'not a .csv file', '', n FROM f WHERE k = 3
UNION ALL SELECT 'twice', 'column repeated', 'o_custkey', n FROM f WHERE k = 3
UNION ALL SELECT 'empty', 'no rows', '', 0 WHERE (SELECT count(*) FROM orders) > 0""",
)
def contract_report_(spark, sf_dir):
    """A landing zone of five folders, four of which break their contract in one way or another."""
    root = scratch_path(spark, "landing")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = table(spark, sf_dir, "orders").select(*names, (F.col("o_orderkey") % 4).alias("k"))

    def part(k):
        return orders.where(F.col("k") == k).select(*names).repartition(2, "o_orderkey")

    write_delimited(part(0), f"{root}/whole")
    write_delimited(part(1).select(*names[:2]), f"{root}/half", sep=";")
    write_delimited(part(0).limit(0).coalesce(1), f"{root}/empty")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    for k, folder, head in ((2, "plain", names), (3, "twice", [*names, "o_custkey"])):
        cells = F.concat_ws(",", *[F.col(c).cast("string") for c in head])
        line = F.concat(F.when(first, F.lit(",".join(head) + "\n")).otherwise(F.lit("")), cells)
        part(k).select(line.alias("value")).write.text(f"{root}/{folder}")
    found = contract_report(spark, f"{root}/*", required=names, critical=names[:3])
    name = F.element_at(F.split("file", "/"), -2).alias("name")
    return found.groupBy(name, "rule", "column").agg(F.sum("rows").alias("rows"))


@query(
    "malformed_rows",
    """SELECT o_orderkey, o_orderpriority, 'kept' AS kind FROM orders WHERE o_orderkey % 7 > 1
UNION ALL SELECT o_orderkey, NULL, 'malformed' FROM orders WHERE o_orderkey % 7 <= 1""",
)
def broken_and_kept(spark, sf_dir):
    """Every row with a cell too many or too few is reported, and none of them is read."""
    path = scratch_path(spark, "broken")
    cells = [F.col("o_orderkey").cast("string"), F.lit("x"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""q"""'))]
    line = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(",", *cells, F.lit("more")))
        .when(F.col("o_orderkey") % 7 == 1, F.concat_ws(",", *cells[:2])).otherwise(F.concat_ws(",", *cells))
    )
    # Each task writes a file of its own, whose first line is the header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.when(first, F.lit("key,filler,priority\n")).otherwise(F.lit(""))
    lines = table(spark, sf_dir, "orders").repartition(4, "o_orderkey").select(line.alias("line"))
    lines.select(F.concat(head, "line").alias("value")).write.text(path)
    good = read_delimited(spark, path, bad_rows=DROP).select(
        F.col("key").try_cast("bigint").alias("o_orderkey"),
        F.replace("priority", F.lit(', "q"'), F.lit("")).alias("o_orderpriority"), F.lit("kept").alias("kind"),
    )
    bad = malformed_rows(spark, path).select(
        F.substring_index("record", ",", 1).try_cast("bigint").alias("o_orderkey"),
        F.lit(None).cast("string").alias("o_orderpriority"), F.lit("malformed").alias("kind"),
    )
    return good.unionByName(bad)


@query("json_records", "SELECT event_id, event_type, value, nullif(event_type, 'view') AS kind FROM events")
def json_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.nullif("event_type", F.lit("view")).alias("kind")
    )
    write_records(events, path)
    return spark.read.schema("event_id bigint, event_type string, value double, kind string").json(path)
