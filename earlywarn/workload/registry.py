"""Name -> query function, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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


def r6(c: Column | str) -> Column:
    """Six decimals, so that sums in another order still compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a per-customer history of half-years."""
    half = F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)
    return table(spark, sf_dir, "orders").withColumns(
        {"year": F.year("o_orderdate"), "half": half}
    )


# SQL twin of order_history with the two-step look-ahead label.
LABELLED_ORDERS_SQL = """
hist AS (
  SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half,
         lower(trim(o_orderstatus)) AS st
  FROM orders),
timed AS (SELECT *, year * 2 + (half - 1) AS t FROM hist),
ahead AS (
  SELECT *, lead(st, 1) OVER w AS s1, lead(st, 2) OVER w AS s2,
         lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM timed WINDOW w AS (PARTITION BY o_custkey ORDER BY year, half, o_orderkey)),
labelled AS (
  SELECT *, CASE WHEN coalesce(s1 = 'f' AND t1 - t <= 2, FALSE)
                   OR coalesce(s2 = 'f' AND t2 - t <= 2, FALSE)
                 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target_evasao,
         st NOT IN ('f', 'p') AS is_target_valid
  FROM ahead)
"""
