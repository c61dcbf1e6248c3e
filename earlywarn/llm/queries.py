"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm.alignment import align_tokens
from earlywarn.llm.exact_dedup import exact_groups
from earlywarn.llm.language_model import score_texts
from earlywarn.llm.licenses import scan_licenses
from earlywarn.llm.line_quality import fit_lines, score_quality
from earlywarn.llm.mixing import mix_plan
from earlywarn.llm.ngram_join import similar_groups
from earlywarn.llm.packing import pack_documents
from earlywarn.llm.passages import repeated_passages
from earlywarn.llm.personal import find_personal
from earlywarn.llm.rules import fit_rules, judge
from earlywarn.llm.token_store import read_tokens, write_tokens
from earlywarn.llm.whitening import whiten
from earlywarn.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_quality")
def op1_line_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bucket = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 5
    model = fit_lines(docs, table(spark, sf_dir, "labels"), use=bucket("id") != 0)
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id", (bucket("doc_id") == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines",
    )


@query("op2_passages")
def op2_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM d WINDOW best AS (PARTITION BY plain ORDER BY chars DESC, doc_id)
""")
def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op4_language_model")
def op4_language_model(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


@query("op5_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
             ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
           FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
          WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id
FROM documents AS d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
""")
def op5_ngram_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"))


@query("op6_mixing", r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight,
             CAST([-0.5, 0.0, 0.5][rank % 3 + 1] AS DOUBLE) AS slope,
             CAST(source_size * 3 AS DOUBLE) AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, rank) AS place,
             sum(lim) OVER before AS lims, sum(weight) OVER before AS used,
             sum(weight) OVER () AS all_weights, sum(source_size) OVER () AS total
      FROM w WINDOW before AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - coalesce(lims, 0)) / (all_weights - coalesce(used, 0)) AS level FROM o),
-- the level is that of the first source, in this order, that stays below its limit
t AS (SELECT source, source_size, slope,
             least(lim, weight * coalesce((SELECT level FROM l AS f WHERE f.lim > f.weight * f.level
                                           ORDER BY place LIMIT 1), lim / weight)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(size, demand - start)) AS n0,
             greatest(0, least(size, demand - start - source_size)) AS n1,
             greatest(0, least(size, demand - start - 2 * source_size)) AS n2 FROM p)
SELECT doc_id, size, source_size, target, n0 + n1 + n2 AS taken,
       CASE WHEN n0 > 0 THEN 2.0::DOUBLE * (start / demand)
         / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope)
            + 4.0::DOUBLE * slope * (start / demand))) END AS first_position
FROM c
""")
def op6_mixing(spark, sf_dir):
    plan = mix_plan(table(spark, sf_dir, "documents"))
    first = F.when(F.size("positions") > 0, F.col("positions")[0])
    out = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


@query("op9_licenses")
def op9_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


@query("op10_personal")
def op10_personal(spark, sf_dir):
    found = find_personal(table(spark, sf_dir, "documents"))
    kinds = ("email", "ip", "card", "phone")
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    of = lambda *wanted: F.filter("spans", lambda s: s["kind"].isin(*wanted))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(named(of(*kinds)), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    verdicts = judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "rule",
    )


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op11_token_store")
def op11_token_store(spark, sf_dir):
    path = scratch_path(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))
