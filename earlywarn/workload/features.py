"""Feature statistics and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from earlywarn.operators.encoders import (
    EncoderSpec,
    category_counts,
    encode_by_target,
    one_hot_frame,
    target_encodings,
    vocabulary,
)
from earlywarn.operators.features import FeatureEncoder, FeatureSpec, impute_and_scale
from earlywarn.operators.filters import valid_labels
from earlywarn.operators.metrics import class_weights
from earlywarn.operators.quantiles import exact_medians
from earlywarn.workload.labels import labelled_orders
from earlywarn.workload.registry import LABELLED_ORDERS_SQL, query, r6, table

_SCALE_SQL = """n AS (SELECT p_partkey, CAST(nullif(p_size, 10) AS DOUBLE) AS a,
  CASE WHEN p_retailprice > 950 THEN p_retailprice END AS b FROM part),
m AS (SELECT coalesce(median(a), 0) AS ma, coalesce(median(b), 0) AS mb FROM n),
f AS (SELECT p_partkey, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM n, m),
s AS (SELECT avg(a) AS aa, nullif(stddev_pop(a), 0) AS sa, avg(b) AS ab, nullif(stddev_pop(b), 0) AS sb FROM f)"""


@query(
    "impute_scale",
    f"""WITH {_SCALE_SQL}
SELECT p_partkey, round((a - aa) / coalesce(sa, 1), 6) AS size, round((b - ab) / coalesce(sb, 1), 6) AS price
FROM f, s""",
)
def impute_scale(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(10)).cast("double").alias("size"),
        F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("price"),
    )
    out = impute_and_scale(df, ["size", "price"])
    return out.select("p_partkey", r6("size").alias("size"), r6("price").alias("price"))


@query(
    "medians",
    """SELECT median(l_quantity) AS quantity, median(l_extendedprice) AS price,
  median(nullif(l_discount, 0)) AS discount FROM lineitem""",
)
def medians(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )
    found = exact_medians(df, df.columns)
    return df.limit(1).select(*[F.lit(v).cast("double").alias(c) for c, v in found.items()])


_DOCS = "docs AS (SELECT doc_id, source, lang, n_chars, toxic FROM documents JOIN labels USING (doc_id))"


def labelled_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


_TARGET_SQL = f"""{_DOCS},
p AS (SELECT avg(CAST(toxic AS DOUBLE)) AS prior FROM docs),
g AS (SELECT source, count(*) AS n, avg(CAST(toxic AS DOUBLE)) AS mean FROM docs GROUP BY source),
w AS (SELECT *, 1e0 / (1e0 + exp(-(n - 20e0) / 10e0)) AS w FROM g, p),
e AS (SELECT source, n, mean, prior, prior * (1e0 - w) + mean * w AS encoded FROM w)"""


# The same over a table in which one source is missing: missing is a value of its own.
_MISSING_SQL = _TARGET_SQL.replace(
    "g AS (SELECT source,", "g AS (SELECT coalesce(nullif(source, 'src3'), 'missing') AS source,"
).replace("GROUP BY source", "GROUP BY ALL")


@query(
    "target_encode",
    f"WITH {_TARGET_SQL} SELECT source AS value, n, round(mean, 6) AS mean, round(encoded, 6) AS encoded FROM e",
)
def target_encode(spark, sf_dir):
    df = target_encodings(labelled_docs(spark, sf_dir), ["source"], "toxic")
    return df.select("value", "n", r6("mean").alias("mean"), r6("encoded").alias("encoded"))


@query(
    "target_encode_rows",
    f"""WITH {_MISSING_SQL}
SELECT d.doc_id, round(coalesce(e.encoded, (SELECT prior FROM p)), 6) AS encoded
FROM (SELECT doc_id, coalesce(nullif(source, 'src3'), 'missing') AS source FROM documents) d LEFT JOIN e USING (source)""",
)
def target_encode_rows(spark, sf_dir):
    every = table(spark, sf_dir, "documents").select(
        "doc_id", F.nullif("source", F.lit("src3")).alias("source")
    )
    fitted_on = labelled_docs(spark, sf_dir).withColumn("source", F.nullif("source", F.lit("src3")))
    df = encode_by_target(every, fitted_on, "source", "toxic")
    return df.select("doc_id", r6("source_encoded").alias("encoded"))


@query(
    "category_counts",
    """SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type""",
)
def counts_per_category(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("vocabulary", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name ORDER BY value")
def known_values(spark, sf_dir):
    return vocabulary(table(spark, sf_dir, "part"), ["p_name"]).select("value", "n")


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' THEN 1e0 ELSE 0e0 END AS c_mktsegment_{s}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot_segment(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return one_hot_frame(df, "c_mktsegment").drop("c_mktsegment")


_TYPES = ("economy", "large", "medium", "promo", "small", "standard")


@query(
    "adaptive_encode",
    """WITH x AS (SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS type,
             CASE WHEN p_size > 25 THEN 1e0 ELSE 0e0 END AS y FROM part),
p AS (SELECT avg(y) AS prior FROM x),
g AS (SELECT brand, count(*) AS n, avg(y) AS mean FROM x GROUP BY brand),
e AS (SELECT brand, prior * (1e0 - 1e0 / (1e0 + exp(-(n - 20e0) / 10e0)))
             + mean / (1e0 + exp(-(n - 20e0) / 10e0)) AS encoded FROM g, p)
SELECT p_partkey, round(encoded, 6) AS p_brand, """
    + ", ".join(f"CASE WHEN type = '{t}' THEN 1e0 ELSE 0e0 END AS p_type_{t}" for t in _TYPES)
    + " FROM x JOIN e USING (brand)",
)
def adaptive_encode(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", (F.col("p_size") > 25).cast("int").alias("y")
    )
    spec = FeatureSpec(numeric=(), categorical=("p_brand", "p_type"), totals=(), shares=(), technical=("y",))
    model = FeatureEncoder(spec=spec, labelCol="y").fit(df)
    out = model.encode(df)
    named = [r6(f"f{i}").alias(n) for i, n in enumerate(model.feature_names)]
    return out.select("p_partkey", *named)


ORDER_FEATURES = FeatureSpec(
    numeric=("grade_a", "grade_b", "won", "lost"),
    categorical=("o_orderpriority",),
    totals=(("grade_total", "grade_"),),
    shares=(("won_share", "won", "lost"),),
    technical=("o_orderkey", "target_evasao", "is_target_valid", "o_orderstatus"),
    encoder=EncoderSpec(),
)


def order_inputs(df):
    """Numeric and categorical model inputs with holes, from labelled orders."""
    price = F.col("o_totalprice")
    return df.withColumns(
        {
            "grade_a": F.when(price >= 100000, price),
            "grade_b": F.when(price <= 300000, price / F.lit(2.0)),
            "won": F.pmod(F.col("o_custkey"), F.lit(7)).cast("double"),
            "lost": F.pmod(F.col("o_custkey"), F.lit(3)).cast("double"),
        }
    )


_NUMS = ("grade_a", "grade_b", "won", "lost", "won_share", "grade_total")
_PRIORITIES = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")


@query(
    "feature_matrix",
    f"""WITH {LABELLED_ORDERS_SQL},
i AS (SELECT o_orderkey, lower(o_orderpriority) AS pr,
        CASE WHEN o_totalprice >= 100000 THEN o_totalprice END AS grade_a,
        CASE WHEN o_totalprice <= 300000 THEN o_totalprice / 2e0 END AS grade_b,
        CAST(o_custkey % 7 AS DOUBLE) AS won, CAST(o_custkey % 3 AS DOUBLE) AS lost
      FROM labelled WHERE is_target_valid),
x AS (SELECT *, won / nullif(won + lost, 0) AS won_share,
        CASE WHEN coalesce(grade_a, grade_b) IS NOT NULL
             THEN coalesce(grade_a, 0) + coalesce(grade_b, 0) END AS grade_total FROM i),
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _NUMS)} FROM x),
f AS (SELECT o_orderkey, pr, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _NUMS)} FROM x, m),
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _NUMS)} FROM f)
SELECT o_orderkey, {", ".join(f"round(({c} - a_{c}) / s_{c}, 5) AS {c}" for c in _NUMS)},
  {", ".join(f'''CASE WHEN pr = '{p}' THEN 1e0 ELSE 0e0 END AS "o_orderpriority_{p}"''' for p in _PRIORITIES)}
FROM f, s""",
)
def feature_matrix(spark, sf_dir):
    df = order_inputs(valid_labels(labelled_orders(spark, sf_dir)))
    model = FeatureEncoder(spec=ORDER_FEATURES, labelCol="target_evasao").fit(df)
    out = model.encode(df)
    named = [F.round(f"f{i}", 5).alias(n) for i, n in enumerate(model.feature_names)]
    return out.select("o_orderkey", *named)


@query(
    "class_weights",
    """SELECT CAST(toxic AS BIGINT) AS label, count(*) AS n,
  round((SELECT count(*) FROM labels) / (2e0 * count(*)), 6) AS weight FROM labels GROUP BY toxic""",
)
def balanced_weights(spark, sf_dir):
    df = class_weights(table(spark, sf_dir, "labels"), "toxic")
    return df.select(F.col("label").cast("bigint").alias("label"), "n", r6("weight").alias("weight"))
