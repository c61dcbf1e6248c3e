"""Labels, splits and folds."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from earlywarn.functions import status_to_binary
from earlywarn.operators.filters import in_years, terminal_only, valid_labels
from earlywarn.operators.labels import LabelSpec, label_future_events, label_time_range
from earlywarn.operators.profile import label_stats
from earlywarn.operators.splits import (
    YearSplit,
    automatic_split,
    cutoff_time,
    distinct_sorted,
    hash_fold,
    period_counts,
    quota_split,
    random_split,
)
from earlywarn.session import scratch_path
from earlywarn.sources.files import write_training_table
from earlywarn.workload.registry import LABELLED_ORDERS_SQL, order_history, query, r6, table

ORDER_LABEL = LabelSpec(
    entity="o_custkey", year="year", half="half", status="o_orderstatus", tie=("o_orderkey",),
    events=("f",), terminals=("f", "p"),
)
YEARS = YearSplit((1995, 1998), (1999,), (2000,))


def labelled_orders(spark, sf_dir):
    return label_future_events(order_history(spark, sf_dir), ORDER_LABEL)


@query(
    "label_orders",
    f"""WITH {LABELLED_ORDERS_SQL}
SELECT o_orderkey, o_custkey, CAST(t AS BIGINT) AS t, target_evasao, is_target_valid FROM labelled""",
)
def label_orders(spark, sf_dir):
    df = labelled_orders(spark, sf_dir)
    t = (F.col("year") * 2 + F.col("half") - 1).cast("bigint").alias("t")
    return df.select("o_orderkey", "o_custkey", t, "target_evasao", "is_target_valid")


@query(
    "label_observed_future",
    f"""WITH {LABELLED_ORDERS_SQL}
SELECT o_orderkey, target_evasao, is_target_valid AND t1 IS NOT NULL AS is_target_valid
FROM labelled""",
)
def label_observed_future(spark, sf_dir):
    spec = replace(ORDER_LABEL, require_observed_future=True)
    df = label_future_events(order_history(spark, sf_dir), spec)
    return df.select("o_orderkey", "target_evasao", "is_target_valid")


@query(
    "label_time_range",
    """WITH h AS (
  SELECT *, year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS t,
         lower(trim(o_orderstatus)) AS st FROM orders),
s AS (SELECT o_custkey, t, max(CASE WHEN st = 'f' THEN 1 ELSE 0 END) AS e FROM h GROUP BY ALL),
v AS (SELECT o_custkey, t, coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY t
        RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS hit FROM s)
SELECT o_orderkey, CAST(hit AS DOUBLE) AS target_evasao, st NOT IN ('f', 'p') AS is_target_valid
FROM h JOIN v USING (o_custkey, t)""",
)
def label_time_range_(spark, sf_dir):
    df = label_time_range(order_history(spark, sf_dir), ORDER_LABEL)
    return df.select("o_orderkey", "target_evasao", "is_target_valid")


@query(
    "label_hot_entities",
    """WITH h AS (
  SELECT *, year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS t,
         o_orderkey % 1000 < 3 AS e FROM orders),
s AS (SELECT o_orderpriority, t, max(CASE WHEN e THEN 1 ELSE 0 END) AS e FROM h GROUP BY ALL),
v AS (SELECT o_orderpriority, t, coalesce(max(e) OVER (PARTITION BY o_orderpriority ORDER BY t
        RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) AS hit FROM s)
SELECT o_orderkey, CAST(hit AS DOUBLE) AS target_evasao, NOT e AS is_target_valid
FROM h JOIN v USING (o_orderpriority, t)""",
)
def label_hot_entities(spark, sf_dir):
    """Five entities hold all rows, so every history is cut into ranges; events are rare."""
    status = F.when(F.col("o_orderkey") % 1000 < 3, "f").otherwise("o")
    history = order_history(spark, sf_dir).withColumn("status", status)
    spec = LabelSpec(
        entity="o_orderpriority", year="year", half="half", status="status", tie=("o_orderkey",),
        events=("f",), terminals=("f",), horizon=1, max_group_rows=1000,
    )
    return label_time_range(history, spec).select("o_orderkey", "target_evasao", "is_target_valid")


EVENT_LABEL = LabelSpec(
    entity="user_id", time="day", status="event_type", tie=("ts", "event_id"),
    events=("error",), terminals=("error",), horizon=3,
)


@query(
    "label_events",
    """WITH d AS (
  SELECT event_id, user_id, ts, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day
  FROM events),
a AS (SELECT *, lead(event_type, 1) OVER w AS e1, lead(event_type, 2) OVER w AS e2,
             lead(event_type, 3) OVER w AS e3, lead(day, 1) OVER w AS d1,
             lead(day, 2) OVER w AS d2, lead(day, 3) OVER w AS d3
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day, ts, event_id))
SELECT event_id, user_id, CAST(day AS BIGINT) AS day,
       CASE WHEN coalesce(e1 = 'error' AND d1 - day <= 3, FALSE)
              OR coalesce(e2 = 'error' AND d2 - day <= 3, FALSE)
              OR coalesce(e3 = 'error' AND d3 - day <= 3, FALSE)
            THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target_evasao
FROM a WHERE event_type <> 'error'""",
)
def label_events(spark, sf_dir):
    start = F.lit(date(2024, 1, 1))
    days = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), start))
    df = valid_labels(label_future_events(days, EVENT_LABEL))
    return df.select("event_id", "user_id", F.col("day").cast("bigint").alias("day"), "target_evasao")


@query(
    "status_to_binary",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(0 AS BIGINT)
       WHEN 'F' THEN CAST(1 AS BIGINT) END AS outcome FROM orders""",
)
def status_outcome(spark, sf_dir):
    # The codes are rendered as the words a record would carry, stray case, accents and space included.
    word = (
        F.when(F.col("o_orderstatus") == "O", F.lit("  Concluído"))
        .when(F.col("o_orderstatus") == "F", F.lit("EVADIDO \t"))
        .otherwise(F.lit("Regular"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", status_to_binary(word).cast("bigint").alias("outcome")
    )


@query("terminal_only", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def terminal_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return terminal_only(df, "o_orderstatus", ("f", "p")).select("o_orderkey", "o_custkey")


@query(
    "valid_year_filter",
    f"""WITH {LABELLED_ORDERS_SQL}
SELECT o_orderkey, target_evasao,
       CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END
         AS split
FROM labelled WHERE is_target_valid AND year BETWEEN 1995 AND 2000""",
)
def valid_year_filter(spark, sf_dir):
    rows = in_years(valid_labels(labelled_orders(spark, sf_dir)), YEARS.years, "year")
    return rows.select("o_orderkey", "target_evasao", YEARS.column("year").alias("split"))


@query(
    "training_table",
    f"""WITH {LABELLED_ORDERS_SQL}
SELECT o_orderkey, target_evasao, is_target_valid, CAST(year AS BIGINT) AS year
FROM labelled WHERE year IN (1999, 2000)""",
)
def training_table(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    write_training_table(labelled_orders(spark, sf_dir), path, "year")
    rows = in_years(spark.read.parquet(path), [*YEARS.val_years, *YEARS.test_years], "year")
    year = F.col("year").cast("bigint").alias("year")
    return rows.select("o_orderkey", "target_evasao", "is_target_valid", year)


@query(
    "available_years",
    "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year FROM orders",
)
def years_present(spark, sf_dir):
    years = order_history(spark, sf_dir).select(F.col("year").cast("bigint").alias("year"))
    return distinct_sorted(years, "year")


_PERIODS_SQL = """
p AS (SELECT DISTINCT year(o_orderdate) * 10 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS t
      FROM orders),
r AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS k, count(*) OVER () AS n FROM p),
c AS (SELECT CAST(n AS BIGINT) AS periods, CAST(t AS BIGINT) AS cutoff FROM r
      WHERE k = CASE WHEN n >= 4 THEN 2 ELSE 1 END)"""


@query("auto_cutoff", f"WITH {_PERIODS_SQL} SELECT periods, cutoff FROM c")
def auto_cutoff(spark, sf_dir):
    return cutoff_time(period_counts(order_history(spark, sf_dir), "year", "half"))


@query(
    "auto_split",
    f"""WITH {_PERIODS_SQL}
SELECT o_orderkey, CASE WHEN year(o_orderdate) * 10 + CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END
         >= (SELECT cutoff FROM c) THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def auto_split(spark, sf_dir):
    df = order_history(spark, sf_dir)
    column, _ = automatic_split(df, ["o_orderkey"], "year", "half")
    return df.select("o_orderkey", column.alias("split"))


HASH_SQL = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296e0"


@query(
    "stratified_split",
    """WITH r AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n,
    row_number() OVER (PARTITION BY toxic ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 13)) AS k
  FROM documents JOIN labels USING (doc_id))
SELECT doc_id, toxic, CASE WHEN k <= round(n / 5e0) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "toxic", quota_split(docs, ["doc_id"], "toxic").alias("split"))


@query(
    "hashed_split",
    f"""SELECT doc_id, toxic, CASE WHEN {HASH_SQL} < 0.2e0 THEN 'val' ELSE 'train' END AS split
FROM documents JOIN labels USING (doc_id)""",
)
def hashed_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "toxic", random_split(["doc_id"]).alias("split"))


@query(
    "stratified_folds",
    f"""SELECT doc_id, toxic, CAST(floor({HASH_SQL} * 5) AS BIGINT) AS fold
FROM documents JOIN labels USING (doc_id)""",
)
def stratified_folds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    fold = hash_fold(["doc_id"], 5).cast("bigint").alias("fold")
    return docs.select("doc_id", "toxic", fold)


@query(
    "label_stats",
    f"""WITH {LABELLED_ORDERS_SQL},
n AS (SELECT count(*) AS rows, count_if(is_target_valid) AS valid,
             count_if(is_target_valid AND target_evasao = 1) AS positive FROM labelled)
SELECT CAST(rows AS BIGINT) AS rows, CAST(valid AS BIGINT) AS valid,
       CAST(positive AS BIGINT) AS positive,
       round(valid / CAST(nullif(rows, 0) AS DOUBLE), 6) AS valid_share,
       round(positive / CAST(nullif(valid, 0) AS DOUBLE), 6) AS positive_share FROM n""",
)
def labelled_statistics(spark, sf_dir):
    df = label_stats(labelled_orders(spark, sf_dir))
    return df.select(
        "rows", "valid", "positive",
        r6("valid_share").alias("valid_share"), r6("positive_share").alias("positive_share"),
    )
