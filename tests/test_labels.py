from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from earlywarn.operators.labels import LabelSpec, label_future_events, label_time_range
from earlywarn.operators.ordered import with_followers, with_next_event

SCHEMA = "n int, codigo_aluno string, ano_referencia int, periodo_referencia int, situacao string"
SPEC = LabelSpec(tie=("n",))

CASES = {
    "next semester": ([("A", 2020, 1, "Regular"), ("A", 2020, 2, "Desistente")], [1.0, 0.0], [True, False]),
    "within horizon": (
        [("B", 2020, 1, "Regular"), ("B", 2020, 2, "Regular"), ("B", 2021, 1, "Trancado")],
        [1.0, 1.0, 0.0], [True, True, False],
    ),
    "graduation": (
        [("C", 2020, 1, "Regular"), ("C", 2020, 2, "Regular"), ("C", 2021, 1, "Formado")],
        [0.0, 0.0, 0.0], [True, True, False],
    ),
    "isolation": ([("A", 2020, 1, "Regular"), ("B", 2020, 1, "Desistente")], [0.0, 0.0], [True, False]),
    "gap": ([("D", 2020, 1, "Regular"), ("D", 2022, 1, "Desistente")], [0.0, 0.0], [True, False]),
    "horizon edge": ([("E", 2020, 1, "Regular"), ("E", 2021, 1, "Desistente")], [1.0, 0.0], [True, False]),
    "row limit": (
        [("F", 2020, 1, "Regular")] * 3 + [("F", 2020, 2, "Desistente")],
        [0.0, 1.0, 1.0, 0.0], [True, True, True, False],
    ),
    "null status": ([("G", 2020, 1, None), ("G", 2020, 2, "Desistente")], [1.0, 0.0], [True, False]),
    "null id": ([(None, 2020, 1, "Regular"), (None, 2020, 2, "Desistente")], [0.0, 0.0], [True, False]),
    "case and spaces": (
        [("H", 2020, 1, "Regular"), ("H", 2020, 2, " DESISTENTE\t")], [1.0, 0.0], [True, False]
    ),
    "missing year sorts last": (
        [("I", 2020, 1, "Regular"), ("I", None, 1, "Desistente")], [0.0, 0.0], [True, False]
    ),
}


def history(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("limit", [None, 5_000_000, 1])
def test_golden_cases(spark, name, limit):
    rows, labels, valid = CASES[name]
    out = label_future_events(history(spark, rows), replace(SPEC, max_group_rows=limit))
    got = out.orderBy("n").collect()
    assert [r["target_evasao"] for r in got] == labels
    assert [r["is_target_valid"] for r in got] == valid


def test_observed_future(spark):
    rows = [("A", 2020, 1, "Regular"), ("A", 2020, 2, "Regular")]
    out = label_future_events(history(spark, rows), replace(SPEC, require_observed_future=True))
    assert [r["is_target_valid"] for r in out.orderBy("n").collect()] == [True, False]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="situacao"):
        label_future_events(history(spark, [("A", 2020, 1, "x")]).drop("situacao"), SPEC)


def test_time_range_ignores_row_limit(spark):
    rows, _, _ = CASES["row limit"]
    out = label_time_range(history(spark, rows), SPEC).orderBy("n").collect()
    assert [r["target_evasao"] for r in out] == [1.0, 1.0, 1.0, 0.0]


def test_one_key_holding_everything_is_split_exactly(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.lit(-1)).alias("k"),
        F.col("o_orderkey").alias("tie"), F.month("o_orderdate").alias("t"), "o_orderstatus",
    )
    args = (["k"], ["t", "tie"], ["o_orderstatus", "t"], 3)
    plain = with_followers(orders, *args, max_group_rows=None)
    for limit in (40, 7, 2):
        split = with_followers(orders, *args, max_group_rows=limit)
        assert split.columns == plain.columns
        assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()


def test_one_shuffle_for_all_leads(spark):
    df = label_future_events(history(spark, CASES["gap"][0]), replace(SPEC, max_group_rows=None))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 1


@pytest.mark.parametrize("horizon", [1, 2, 4])
def test_random_histories_against_brute_force(spark, horizon):
    import random

    rng = random.Random(horizon)
    statuses = ["Regular", "Desistente", " trancado", "Formado", None, "Transferido"]
    rows = [
        (rng.choice(["a", "b", "c", "d", None]), rng.randrange(2015, 2019), rng.choice([1, 2]), rng.choice(statuses))
        for _ in range(250)
    ]
    table = [(i, *r) for i, r in enumerate(rows)]
    want = {}
    for i, key, year, half, status in table:
        own = sorted(r for r in ((y, h, n, s) for n, k, y, h, s in table if key is not None and k == key))
        later = [r for r in own if r[:3] > (year, half, i)][:horizon]
        hit = any(
            s is not None and s.strip().lower() in ("desistente", "trancado")
            and (y * 2 + h) - (year * 2 + half) <= horizon
            for y, h, _, s in later
        )
        terminal = status is not None and status.strip().lower() in ("desistente", "trancado", "formado")
        want[i] = (float(hit), not terminal)
    for limit in (None, 10):
        out = label_future_events(history(spark, rows), replace(SPEC, horizon=horizon, max_group_rows=limit))
        assert {r["n"]: (r["target_evasao"], r["is_target_valid"]) for r in out.collect()} == want


def test_default_order_is_stable(spark):
    rows = [("A", 2020, 1, s) for s in ("Regular", "Desistente", "Formado", "Regular")]
    df = history(spark, rows)
    a = label_future_events(df, LabelSpec()).collect()
    b = label_future_events(df.repartition(3, "n"), LabelSpec(max_group_rows=1)).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    assert a[0].__fields__ == [*df.columns, "target_evasao", "is_target_valid"]


@pytest.mark.parametrize("horizon", [1, 3])
def test_time_range_against_brute_force(spark, horizon):
    import random

    rng = random.Random(horizon)
    statuses = ["Regular", "Regular", "Regular", "Desistente", None, "Formado"]
    # One entity holds a third of the rows, and one moment of it a third of those, partly in equal rows.
    rows = [
        (rng.choice(["a", "b", "c", "d", None, *["hot"] * 3]), rng.choice([None, *range(2012, 2020)]), rng.choice([1, 2]),
         rng.choice(statuses)) for _ in range(300)
    ]
    rows += [("hot", 2015, 2, s) for s in ["Desistente"] * 25 + ["Regular"] * 30]
    table = [(i, *r) for i, r in enumerate(rows)]
    at = {i: None if y is None else 2 * y + h for i, _, y, h, _ in table}
    want = {
        i: float(k is not None and at[i] is not None and any(
            k == k2 and s2 == "Desistente" and at[j] is not None and 0 < at[j] - at[i] <= horizon
            for j, k2, _, _, s2 in table
        )) for i, k, _, _, _ in table
    }
    for limit in (None, 150, 40, 10, 3):
        spec = replace(SPEC, horizon=horizon, max_group_rows=limit)
        out = label_time_range(history(spark, rows).repartition(5), spec)
        assert {r["n"]: r["target_evasao"] for r in out.collect()} == want


def test_equal_rows_of_one_entity_spread_over_ranges(spark):
    df = spark.range(0, 900).select(
        F.lit("hot").alias("k"), F.lit(1).cast("bigint").alias("t"), F.lit(True).alias("e"), F.lit(0).alias("tie")
    ).unionByName(spark.sql("SELECT 'hot' AS k, 2L AS t, true AS e, 0 AS tie"))
    out = with_next_event(df, "k", "t", "e", "next", ["tie"], max_group_rows=100)
    assert out.where("t = 1").select("next").distinct().collect() == [(2,)]
    assert out.where("t = 2").collect()[0]["next"] is None
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0]
    assert tasks < 450


def test_time_range_reads_a_history_once_and_joins_nothing_back(spark):
    df = label_time_range(history(spark, CASES["gap"][0]), replace(SPEC, max_group_rows=None))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1 and "Join" not in plan


def test_short_ranges_do_not_multiply_tasks(spark):
    # 20,000 rows of one entity in ranges of ten: four thousand tasks if each had its own.
    df = spark.range(0, 20_000, 1, 3).select(
        F.lit("hot").alias("k"), (F.col("id") % 2_500).alias("t"), (F.col("id") % 997 == 0).alias("e"), F.col("id").alias("tie")
    )
    context = spark.sparkContext
    plain = with_next_event(df, "k", "t", "e", "next", ["tie"], max_group_rows=None)
    leads = with_followers(df, ["k"], ["t", "tie"], ["e"], 2, max_group_rows=None)
    context.setJobGroup("short-ranges", "ranges of ten rows")
    cut = with_next_event(df, "k", "t", "e", "next", ["tie"], max_group_rows=10)
    cut_leads = with_followers(df, ["k"], ["t", "tie"], ["e"], 2, max_group_rows=10)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("short-ranges") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s is not None) <= 16
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()
    assert cut_leads.exceptAll(leads).isEmpty() and leads.exceptAll(cut_leads).isEmpty()
