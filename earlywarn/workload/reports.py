"""Risk tables, filters, key figures, importance roll-ups, arriving files."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.functions import parse_number
from earlywarn.operators.encoders import long_form
from earlywarn.operators.filters import active_above, active_only, filter_scored
from earlywarn.operators.report import (
    key_figures,
    label_counts,
    mean_importance,
    roll_up_sources,
    top_importance,
    top_scored,
    with_risk,
)
from earlywarn.operators.splits import hash_fold
from earlywarn.session import scratch_path
from earlywarn.sources.files import preview, read_delimited, write_delimited
from earlywarn.streaming.arrivals import (
    arriving_files,
    run_files_to_table,
    run_to_table,
    run_with_statistics,
)
from earlywarn.workload.registry import query, r6, table

_SCORED = """scored AS (SELECT o_orderkey AS codigo_aluno,
  CASE o_orderstatus WHEN 'O' THEN 'Regular' WHEN 'F' THEN 'Desistente' ELSE 'Formado' END AS situacao,
  o_orderpriority AS curso, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE year(o_orderdate) END AS y,
  CASE WHEN o_totalprice >= 10000 THEN round(o_totalprice / 500000, 4) END AS p FROM orders),
risk AS (SELECT *, round_even(p * 100, 2) AS risk_pct,
  CASE WHEN p IS NULL THEN 'Alto' WHEN p < 0.33 THEN 'Baixo' WHEN p < 0.4 THEN 'Médio' ELSE 'Alto' END AS risk_label
  FROM scored)"""


def scored(spark, sf_dir):
    """Orders dressed as a scored risk table: some scores and some years are missing."""
    status = (
        F.when(F.col("o_orderstatus") == "O", F.lit("Regular"))
        .when(F.col("o_orderstatus") == "F", F.lit("Desistente")).otherwise(F.lit("Formado"))
    )
    price = F.col("o_totalprice")
    year = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("?")).otherwise(
        F.year("o_orderdate").cast("string")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("codigo_aluno"), status.alias("situacao"),
        F.col("o_orderpriority").alias("curso"), year.alias("ano_ingresso"),
        F.when(price >= 10000, F.round(price / 500000, 4)).alias("prob_evasao"),
    )


@query("risk_labels", f"WITH {_SCORED} SELECT codigo_aluno, p AS prob_evasao, risk_pct, risk_label FROM risk")
def risk_labels(spark, sf_dir):
    return with_risk(scored(spark, sf_dir)).select(
        "codigo_aluno", "prob_evasao", "risk_pct", "risk_label"
    )


@query("risk_counts", f"WITH {_SCORED} SELECT risk_label, count(*) AS n FROM risk GROUP BY 1")
def risk_counts(spark, sf_dir):
    return label_counts(with_risk(scored(spark, sf_dir)))


@query(
    "risk_key_figures",
    f"""WITH {_SCORED},
k AS (SELECT count(*) AS total, count_if(risk_label = 'Baixo') AS low, count_if(risk_label = 'Médio') AS medium,
  count_if(risk_label = 'Alto') AS high, count_if(situacao = 'Regular') AS active,
  avg(p) AS mean_score, median(p) AS median_score FROM risk)
SELECT CAST(total AS BIGINT) AS total, CAST(low AS BIGINT) AS low, CAST(medium AS BIGINT) AS medium,
  CAST(high AS BIGINT) AS high, CAST(active AS BIGINT) AS active,
  round(low * 100e0 / total, 6) AS low_pct, round(medium * 100e0 / total, 6) AS medium_pct,
  round(high * 100e0 / total, 6) AS high_pct, round(active * 100e0 / total, 6) AS active_pct,
  round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score FROM k""",
)
def risk_key_figures(spark, sf_dir):
    df = key_figures(scored(spark, sf_dir))
    counts = ["total", "low", "medium", "high", "active"]
    return df.select(*counts, *[r6(c).alias(c) for c in df.columns if c not in counts])


@query(
    "risk_filter",
    f"""WITH {_SCORED} SELECT codigo_aluno, CAST(y AS DOUBLE) AS ano_ingresso FROM risk
WHERE situacao IN ('Regular', 'Formado') AND curso IN ('1-URGENT', '3-MEDIUM', '5-LOW')
  AND p BETWEEN 0.25 AND 0.75 AND y BETWEEN 1996 AND 1999""",
)
def risk_filter(spark, sf_dir):
    df = filter_scored(
        scored(spark, sf_dir), statuses=["Regular", "Formado"],
        courses=["1-URGENT", "3-MEDIUM", "5-LOW"], risk=(0.25, 0.75), years=(1996, 1999),
    )
    return df.select("codigo_aluno", "ano_ingresso")


@query(
    "filtered_export",
    f"""WITH {_SCORED} SELECT CAST(codigo_aluno AS VARCHAR) AS codigo_aluno, risk_label FROM risk
WHERE situacao = 'Regular' AND p BETWEEN 0.5 AND 1 AND y BETWEEN 2000 AND 2030""",
)
def filtered_export(spark, sf_dir):
    path = scratch_path(spark, "export")
    chosen = filter_scored(scored(spark, sf_dir), statuses=["Regular"], risk=(0.5, 1.0))
    write_delimited(with_risk(chosen), path)
    return read_delimited(spark, path, ",").select("codigo_aluno", "risk_label")


@query(
    "preview_rows",
    f"WITH {_SCORED} SELECT codigo_aluno, risk_label FROM risk ORDER BY codigo_aluno LIMIT 20",
)
def preview_rows(spark, sf_dir):
    return preview(with_risk(scored(spark, sf_dir)).orderBy("codigo_aluno")).select(
        "codigo_aluno", "risk_label"
    )


@query(
    "risk_filter_defaults",
    f"WITH {_SCORED} SELECT codigo_aluno FROM risk WHERE p BETWEEN 0 AND 1 AND y BETWEEN 2000 AND 2030",
)
def risk_filter_defaults(spark, sf_dir):
    return filter_scored(scored(spark, sf_dir)).select("codigo_aluno")


@query("risk_active", f"WITH {_SCORED} SELECT codigo_aluno FROM risk WHERE situacao = 'Regular'")
def risk_active(spark, sf_dir):
    return active_only(scored(spark, sf_dir)).select("codigo_aluno")


@query("risk_active_high", f"WITH {_SCORED} SELECT codigo_aluno FROM risk WHERE situacao = 'Regular' AND p > 0.4")
def risk_active_high(spark, sf_dir):
    return active_above(scored(spark, sf_dir)).select("codigo_aluno")


@query(
    "risk_top10",
    f"""WITH {_SCORED} SELECT codigo_aluno, p AS prob_evasao FROM risk
ORDER BY p DESC NULLS LAST, codigo_aluno LIMIT 10""",
)
def risk_top10(spark, sf_dir):
    return top_scored(scored(spark, sf_dir), ["codigo_aluno"]).select("codigo_aluno", "prob_evasao")


# Per fold and feature, an importance: difference of the feature's mean between the two classes.
_LONG = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_discount, l_tax,
  l_quantity / 50e0 AS q,
  CAST(floor(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|42'), 1, 8)
    AS BIGINT) / 4294967296e0 * 3) AS BIGINT) AS fold FROM lineitem),
long AS (
  SELECT fold, l_orderkey, l_linenumber, l_partkey, l_linestatus, 'discount' AS feature, 'rebate' AS source, l_discount AS v FROM x
  UNION ALL SELECT fold, l_orderkey, l_linenumber, l_partkey, l_linestatus, 'tax', 'rebate', l_tax FROM x
  UNION ALL SELECT fold, l_orderkey, l_linenumber, l_partkey, l_linestatus, 'quantity', 'amount', q FROM x)"""


def contributions(spark, sf_dir):
    """Line items as a long table of (row, encoded column, value), with the fold of each row."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus",
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_quantity") / F.lit(50.0)).alias("quantity"),
        hash_fold(["l_orderkey", "l_linenumber"], 3).cast("bigint").alias("fold"),
    )
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "fold"]
    long = long_form(items, ["discount", "tax", "quantity"], keep)
    return long.withColumn("v", F.col("value").try_cast("double")).drop("value")


def lineage(spark):
    return spark.createDataFrame(
        [("discount", "rebate"), ("tax", "rebate"), ("quantity", "amount")],
        "feature string, source string",
    )


_FOLD_IMPORTANCE = f"""{_LONG},
f AS (SELECT fold, feature, avg(CASE WHEN l_linestatus = 'F' THEN v END) - avg(CASE WHEN l_linestatus = 'O' THEN v END)
        AS importance FROM long GROUP BY ALL)"""


def fold_importances(spark, sf_dir):
    gap = F.avg(F.when(F.col("l_linestatus") == "F", F.col("v"))) - F.avg(
        F.when(F.col("l_linestatus") == "O", F.col("v"))
    )
    return contributions(spark, sf_dir).groupBy("fold", "feature").agg(gap.alias("importance"))


@query(
    "importance_mean",
    f"WITH {_FOLD_IMPORTANCE} SELECT feature, round(avg(importance), 6) AS importance FROM f GROUP BY 1",
)
def importance_mean(spark, sf_dir):
    df = mean_importance(fold_importances(spark, sf_dir))
    return df.select("feature", r6("importance").alias("importance"))


@query(
    "importance_top",
    f"""WITH {_FOLD_IMPORTANCE}, m AS (SELECT feature, avg(importance) AS importance FROM f GROUP BY 1)
SELECT feature, round(importance, 6) AS importance FROM m ORDER BY importance DESC, feature LIMIT 2""",
)
def importance_top(spark, sf_dir):
    df = top_importance(mean_importance(fold_importances(spark, sf_dir)), 2, signed=True)
    return df.select("feature", r6("importance").alias("importance"))


@query(
    "importance_rollup",
    f"""WITH {_FOLD_IMPORTANCE}, m AS (SELECT feature, avg(importance) AS importance FROM f GROUP BY 1)
SELECT source, round(sum(importance), 6) AS importance FROM m JOIN (SELECT DISTINCT feature, source FROM long) USING (feature)
GROUP BY 1""",
)
def importance_rollup(spark, sf_dir):
    means = mean_importance(fold_importances(spark, sf_dir))
    df = roll_up_sources(means, lineage(spark), value="importance")
    return df.select("source", r6("importance").alias("importance"))


@query(
    "contribution_rollup",
    """WITH s AS (SELECT l_orderkey AS o, sum(l_discount + l_tax) AS rebate, sum(l_quantity / 50e0) AS amount
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS row_id, 'rebate' AS source, round(coalesce(rebate, 0), 6) AS contribution
FROM orders LEFT JOIN s ON o = o_orderkey
UNION ALL SELECT o_orderkey, 'amount', round(coalesce(amount, 0), 6) FROM orders LEFT JOIN s ON o = o_orderkey
UNION ALL SELECT o_orderkey, 'unused', 0e0 FROM orders""",
)
def contribution_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    values = contributions(spark, sf_dir).select(
        F.col("l_orderkey").alias("row_id"), "feature", F.col("v").alias("contribution")
    )
    sources = lineage(spark).unionByName(
        spark.createDataFrame([("other", "unused")], "feature string, source string")
    )
    df = roll_up_sources(values, sources, "row_id", rows)
    return df.select("row_id", "source", r6("contribution").alias("contribution"))


def _stream_input(spark, sf_dir):
    folder = scratch_path(spark, "arrivals")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("situacao"), F.col("value").cast("string").alias("value")
    )
    write_delimited(events, folder)
    return arriving_files(spark, folder, ["event_id", "situacao", "value"], files_per_batch=2)


def _dress(df):
    p = F.least(parse_number("value") / F.lit(100.0), F.lit(1.0))
    return with_risk(df.withColumn("prob_evasao", p))


_EVENT_RISK = """e AS (SELECT event_id, least(value / 100e0, 1e0) AS p FROM events),
r AS (SELECT event_id, p, CASE WHEN p < 0.33 THEN 'Baixo' WHEN p < 0.4 THEN 'Médio' ELSE 'Alto' END AS risk_label FROM e)"""


@query(
    "score_stream",
    f"""WITH {_EVENT_RISK} SELECT event_id, round(p, 6) AS prob_evasao, risk_label,
  event_type || ', "' || props || '"' AS note FROM r JOIN events USING (event_id)""",
)
def score_stream(spark, sf_dir):
    """Arriving files with two orders of columns, two separators, quotes and separators in the text."""
    folder, target, state = (scratch_path(spark, n) for n in ("arrivals", "scored", "state"))
    note = F.concat("event_type", F.lit(', "'), "props", F.lit('"')).alias("note")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("situacao"), note, F.col("value").cast("string").alias("value")
    )
    write_delimited(events.where("event_id % 2 = 0"), folder)
    turned = events.where("event_id % 2 = 1").select("note", "value", "situacao", "event_id")
    write_delimited(turned, folder, sep=";", mode="append")
    names = ["event_id", "situacao", "note", "value"]
    run_files_to_table(spark, folder, names, _dress, target, state).awaitTermination()
    return spark.read.parquet(target).select(
        F.col("event_id").try_cast("bigint").alias("event_id"),
        r6("prob_evasao").alias("prob_evasao"), "risk_label", "note",
    )


@query("stream_to_table", f"WITH {_EVENT_RISK} SELECT event_id, round(p, 6) AS prob_evasao, risk_label FROM r")
def stream_to_table(spark, sf_dir):
    target, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    run_to_table(_stream_input(spark, sf_dir), _dress, target, state).awaitTermination()
    return spark.read.parquet(target).select(
        F.col("event_id").try_cast("bigint").alias("event_id"),
        r6("prob_evasao").alias("prob_evasao"), "risk_label",
    )


@query(
    "stream_statistics",
    f"""WITH {_EVENT_RISK} SELECT 'risk' AS kind, risk_label AS name, count(*) AS n FROM r GROUP BY 2
UNION ALL SELECT 'missing', unnest(['event_id', 'situacao', 'value', 'prob_evasao', 'risk_pct', 'risk_label']), 0""",
)
def stream_statistics(spark, sf_dir):
    target, stats, state = (scratch_path(spark, n) for n in ("scored", "stats", "state"))
    run_with_statistics(_stream_input(spark, sf_dir), _dress, target, stats, state).awaitTermination()
    return spark.read.parquet(stats).groupBy("kind", "name").agg(F.sum("n").alias("n"))
