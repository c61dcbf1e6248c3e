"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import kind, rows_of

QUERIES, ORACLES = contract.QUERIES, contract.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert {d[0]: kind(str(d[1])) for d in cur.description} == {c: kind(t) for c, t in df.dtypes}
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_scores_are_complete(spark, sf_dir):
    rows = QUERIES["score_batch"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert rows.where("NOT sound OR NOT labelled").isEmpty()
