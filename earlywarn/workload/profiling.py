"""Profiles, counts, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators.profile import (
    category_drift,
    column_profile,
    distinct_counts,
    distribution_drift,
    high_missing,
    missing_fractions,
    numeric_drift,
    shape,
    value_counts,
)
from earlywarn.workload.registry import query, r6, table


@query("table_shape", "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns FROM orders")
def table_shape(spark, sf_dir):
    return shape(table(spark, sf_dir, "orders"))


_HOLES = """holes AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"""


def holed_orders(spark, sf_dir):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(~urgent, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice"),
    )


_MISSING = """m AS (
  SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS "column",
         rows, unnest([a, b, c, d]) AS missing
  FROM (SELECT count(*) AS rows, count(*) - count(o_orderkey) AS a, count(*) - count(o_orderstatus) AS b,
               count(*) - count(o_orderpriority) AS c, count(*) - count(o_totalprice) AS d FROM holes))"""


@query(
    "missing_fraction",
    f"""WITH {_HOLES}, {_MISSING}
SELECT "column", rows, missing, round(missing / CAST(rows AS DOUBLE), 6) AS fraction FROM m""",
)
def missing_fraction(spark, sf_dir):
    df = missing_fractions(holed_orders(spark, sf_dir))
    return df.withColumn("fraction", r6("fraction"))


@query(
    "high_missing",
    f"""WITH {_HOLES}, {_MISSING}
SELECT "column", round(missing / CAST(rows AS DOUBLE), 6) AS fraction FROM m
WHERE missing / CAST(rows AS DOUBLE) > 0.3 ORDER BY fraction DESC, "column" """,
)
def mostly_missing(spark, sf_dir):
    df = high_missing(holed_orders(spark, sf_dir))
    return df.select("column", r6("fraction").alias("fraction"))


@query(
    "value_counts",
    f"WITH {_HOLES} SELECT o_orderstatus AS value, count(*) AS n FROM holes GROUP BY 1",
)
def status_counts(spark, sf_dir):
    return value_counts(holed_orders(spark, sf_dir), "o_orderstatus")


def _profile_sql(source: str, columns: list[str], kinds: dict[str, str]) -> str:
    advice = {
        "int": "convert to a number; impute with the median",
        "float": "parse the decimal comma; impute with the median",
        "categorical_string": "one-hot when there are few values, target encoding when many",
    }
    blocks = []
    for c in columns:
        kind = kinds[c]
        blocks.append(
            f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_share,
  count(DISTINCT {c}) AS distinct_values, '{kind}' AS inferred_type,
  (SELECT string_agg(v || ': ' || n, ' | ' ORDER BY n DESC, v) FROM (
     SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL
     GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values,
  '{advice[kind]}' AS recommendation FROM {source}"""
        )
    return " UNION ALL ".join(blocks)


_PART_KINDS = {
    "p_name": "categorical_string", "p_brand": "categorical_string", "p_type": "categorical_string",
    "p_size": "int", "p_retailprice": "float",
}


def _shown(df):
    return df.withColumn("null_share", r6("null_share"))


@query("column_profile_part", _profile_sql("part", list(_PART_KINDS), _PART_KINDS))
def column_profile_part(spark, sf_dir):
    return _shown(column_profile(table(spark, sf_dir, "part"), list(_PART_KINDS)))


_ORDER_KINDS = {
    "o_custkey": "int", "o_orderstatus": "categorical_string",
    "o_orderpriority": "categorical_string",
}


@query(
    "column_profile_orders",
    f"WITH {_HOLES}, src AS (SELECT holes.*, o_custkey FROM holes JOIN orders USING (o_orderkey)) "
    + _profile_sql("src", list(_ORDER_KINDS), _ORDER_KINDS),
)
def column_profile_orders(spark, sf_dir):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    df = table(spark, sf_dir, "orders").select(
        "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(~urgent, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return _shown(column_profile(df))


@query(
    "distinct_split",
    """WITH d AS (SELECT 'source' AS "column", count(DISTINCT source) AS values_seen FROM documents
  UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents
  UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM part)
SELECT "column", values_seen, values_seen <= 20 AS few FROM d""",
)
def distinct_split(spark, sf_dir):
    # Twenty sources sit exactly on the one-hot limit.
    found = distinct_counts(table(spark, sf_dir, "documents"), ["source", "lang"])
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"))
    found.update(distinct_counts(brands, ["brand"]))
    rows = [(c, int(n), few) for c, (n, few) in found.items()]
    return spark.createDataFrame(rows, "column string, values_seen bigint, few boolean")


_HALVES = """a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'),
b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')"""


def _halves(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


def _shares_sql(source: str, name: str) -> str:
    return f"""SELECT 'event_type' AS "column", v IS NULL AS missing, coalesce(v, '') AS value,
  count(*) / CAST((SELECT count(*) FROM {source}) AS DOUBLE) AS {name}
FROM (SELECT nullif(event_type, 'view') AS v FROM {source}) GROUP BY ALL"""


@query(
    "category_drift",
    f"""WITH {_HALVES}, x AS ({_shares_sql('a', 'share_before')}), y AS ({_shares_sql('b', 'share_after')}),
j AS (SELECT "column", missing, value, coalesce(share_before, 0) AS p, coalesce(share_after, 0) AS q
      FROM x FULL JOIN y USING ("column", missing, value))
SELECT "column", missing, value, round(p, 6) AS share_before, round(q, 6) AS share_after,
       round(q - p, 6) AS change,
       round((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6)), 6) AS psi
FROM j""",
)
def drift_of_categories(spark, sf_dir):
    before, after = (
        h.select(F.nullif("event_type", F.lit("view")).alias("event_type"))
        for h in _halves(spark, sf_dir)
    )
    df = category_drift(before, after, ["event_type"])
    return df.withColumns({c: r6(c) for c in ("share_before", "share_after", "change", "psi")})


def _moments_sql(source: str, suffix: str) -> str:
    def one(name: str, x: str) -> str:
        return f"""SELECT '{name}' AS "column", avg({x}) AS mean_{suffix}, median({x}) AS median_{suffix}, stddev_pop({x}) AS std_{suffix},
  avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END) AS missing_{suffix} FROM {source}"""

    value = "CASE WHEN value >= 5 THEN value END"
    error = "CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END"
    return one("value", value) + " UNION ALL " + one("is_error", error)


@query(
    "numeric_drift",
    f"""WITH {_HALVES}, x AS ({_moments_sql('a', 'before')}), y AS ({_moments_sql('b', 'after')})
SELECT "column", round(mean_before, 6) AS mean_before, round(median_before, 6) AS median_before,
  round(median_after, 6) AS median_after, round(std_before, 6) AS std_before,
  round(missing_before, 6) AS missing_before, round(mean_after, 6) AS mean_after,
  round(std_after, 6) AS std_after, round(missing_after, 6) AS missing_after,
  round((mean_after - mean_before) / nullif(std_before, 0), 6) AS shift
FROM x JOIN y USING ("column")""",
)
def drift_of_numbers(spark, sf_dir):
    before, after = (
        h.select(
            F.when(F.col("value") >= 5, F.col("value")).alias("value"),
            (F.col("event_type") == "error").cast("int").alias("is_error"),
        )
        for h in _halves(spark, sf_dir)
    )
    df = numeric_drift(before, after, ["value"], label="is_error")
    return df.select("column", *[r6(c).alias(c) for c in df.columns if c != "column"])


@query(
    "distribution_drift",
    f"""WITH {_HALVES}, r AS (
  SELECT TRUE AS old, CASE WHEN value >= 5 THEN value END AS value, user_id % 97 * 1e0 AS user FROM a
  UNION ALL SELECT FALSE, CASE WHEN value >= 4 THEN value * 1.1 END, user_id % 101 * 1e0 FROM b),
l AS (SELECT old, unnest(['value', 'user']) AS "column", unnest([value, user]) AS x FROM r),
e AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM l WHERE old GROUP BY 1),
h AS (SELECT "column", old, CASE WHEN x IS NULL THEN -1 WHEN x < lo THEN 0 WHEN x > hi THEN 11
        ELSE least(floor((x - lo) / (hi - lo) * 10e0), 9) + 1 END AS bin FROM l JOIN e USING ("column")),
c AS (SELECT "column", bin, CAST(count_if(old) AS DOUBLE) AS nb, CAST(count_if(NOT old) AS DOUBLE) AS na FROM h GROUP BY ALL),
s AS (SELECT *, nb / sum(nb) OVER k AS p, na / sum(na) OVER k AS q,
        sum(CASE WHEN bin >= 0 THEN nb ELSE 0 END) OVER u / sum(CASE WHEN bin >= 0 THEN nb ELSE 0 END) OVER k AS cb,
        sum(CASE WHEN bin >= 0 THEN na ELSE 0 END) OVER u / sum(CASE WHEN bin >= 0 THEN na ELSE 0 END) OVER k AS ca
      FROM c WINDOW k AS (PARTITION BY "column"), u AS (PARTITION BY "column" ORDER BY bin ROWS UNBOUNDED PRECEDING))
SELECT "column", round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi,
  round(max(abs(ca - cb)), 6) AS largest_gap, round(sum(CASE WHEN bin IN (0, 11) THEN q ELSE 0 END), 6) AS beyond,
  round(sum(CASE WHEN bin = -1 THEN p ELSE 0 END), 6) AS missing_before,
  round(sum(CASE WHEN bin = -1 THEN q ELSE 0 END), 6) AS missing_after FROM s GROUP BY 1""",
)
def drift_of_distributions(spark, sf_dir):
    value, user = F.col("value"), F.col("user_id")
    before, after = _halves(spark, sf_dir)
    before = before.select(F.when(value >= 5, value).alias("value"), (user % 97).alias("user"))
    after = after.select(F.when(value >= 4, value * 1.1).alias("value"), (user % 101).alias("user"))
    df = distribution_drift(before, after, ["value", "user"])
    return df.select("column", *[r6(c).alias(c) for c in df.columns if c != "column"])
