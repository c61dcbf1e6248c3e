import math
import random
import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from earlywarn.operators.encoders import EncoderSpec, encode_by_target, one_hot_frame, target_encodings
from earlywarn.operators.metrics import (
    holdout_metrics,
    roc_auc,
    score_histogram,
    top_decile_lift,
)
from earlywarn.operators.profile import column_profile, distinct_counts, label_stats, missing_fractions
from earlywarn.operators.quantiles import exact_medians
from earlywarn.operators.quantiles import exact_ranks
from earlywarn.operators.ranking import running_totals, score_steps
from earlywarn.operators.splits import hash_place, quota_split
from earlywarn.operators.report import key_figures, roll_up_sources, top_importance, top_scored


def test_exact_medians(spark):
    rng = random.Random(5)
    columns = {
        "uniform": [rng.random() for _ in range(4001)],
        "even": [float(i) for i in range(4000)],
        "hot": [0.0 if rng.random() < 0.6 else rng.random() for _ in range(4001)],
        "two": [float(rng.random() < 0.5) for _ in range(4000)],
        "split": [1.0] * 2000 + [2.0] * 2000,
        "holes": [None if i % 3 else float(i) for i in range(3999)],
        "none": [None] * 10,
        "one": [7.0],
    }
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5).cache()
    want = {
        c: statistics.median(known) if (known := [x for x in v if x is not None]) else None
        for c, v in columns.items()
    }
    for limit in (100_000, 500, 20, 1):
        assert exact_medians(df, list(columns), final_values=limit) == want


def test_running_totals_need_no_single_partition(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("s"), F.lit(1).alias("v"))
    out = running_totals(df, "s", ["v"], ranges=7)
    assert out.where("v_upto <> s OR v_all <> 1000").isEmpty()
    one = running_totals(df.limit(0), "s", ["v"], ranges=7)
    assert one.count() == 0


def scored(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(600)]
    return spark.createDataFrame(rows, "p double, y int"), rows


def test_metrics_against_brute_force(spark):
    df, rows = scored(spark)
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = holdout_metrics(df, "p", "y")
    assert got["roc_auc"] == pytest.approx(auc)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert got["roc_auc"] == pytest.approx(evaluator.evaluate(df))
    assert got["brier_score"] == pytest.approx(sum((p - y) ** 2 for p, y in rows) / len(rows))
    base = len(pos) / len(rows)
    assert got["brier_base_rate"] == pytest.approx(base * (1 - base))
    best = sorted(rows, reverse=True)
    cut = best[59][0]
    above = [y for p, y in rows if p > cut]
    at = [y for p, y in rows if p == cut]
    rate = (sum(above) + sum(at) * (60 - len(above)) / len(at)) / 60
    assert top_decile_lift(df, "p", "y").first()["lift"] == pytest.approx(rate / base)


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, y int")
    assert roc_auc(df, "p", "y").first()["roc_auc"] is None
    got = holdout_metrics(df, "p", "y")
    assert got["roc_auc"] is None and got["brier_score"] == pytest.approx(0.1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.999,), (0.5,)], "p double")
    got = {r["bucket"]: r["n"] for r in score_histogram(df, "p").collect()}
    assert got == {1: 1, 30: 2, 16: 1}


def test_target_encoding_formula_and_bounds(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 0)] * 5 + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "c string, y int")
    got = {r["value"]: r for r in target_encodings(df, ["c"], "y").collect()}
    prior = 33 / 48
    from math import exp

    w = 1 / (1 + exp(-(40 - 20) / 10))
    assert got["a"]["encoded"] == pytest.approx(prior * (1 - w) + 0.75 * w)
    assert all(0 <= r["encoded"] <= 1 for r in got.values())
    other = spark.createDataFrame([("zzz",)], "c string")
    assert encode_by_target(other, df, "c", "y").first()["c_encoded"] == pytest.approx(prior)


def test_one_hot_limit(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = one_hot_frame(df, "c").orderBy("c").collect()
    assert [(r["c_a"], r["c_b"]) for r in out] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    with pytest.raises(ValueError):
        one_hot_frame(df, "c", EncoderSpec(max_onehot=1))


def test_profile_types(spark):
    rows = [("Sim", "1", "0,5", "x", None), ("Não", "2", "2.000,00", "y", None), ("Sim", None, "0,", "x", None)]
    df = spark.createDataFrame(rows, "`a.b` string, i string, f string, t string, e string")
    got = {r["column"]: r for r in column_profile(df).collect()}
    kinds = {c: r["inferred_type"] for c, r in got.items()}
    assert kinds == {"a.b": "boolean_like", "i": "int", "f": "float", "t": "categorical_string", "e": "empty"}
    assert got["t"]["top_values"] == "x: 2 | y: 1" and got["i"]["nulls"] == 1
    assert {r["column"]: r["missing"] for r in missing_fractions(df).collect()}["e"] == 3


def test_distinct_counts_are_exact_at_the_limit(spark):
    df = spark.range(1000).select(
        (F.col("id") % 20).cast("string").alias("a"), (F.col("id") % 21).cast("string").alias("b"),
        F.col("id").cast("string").alias("c"),
    )
    got = distinct_counts(df, ["a", "b", "c"])
    assert got["a"] == (20, True) and got["b"] == (21, False) and got["c"][1] is False


def test_empty_input_has_no_shares(spark):
    df = spark.createDataFrame([], "target_evasao double, is_target_valid boolean")
    row = label_stats(df).first()
    assert row["rows"] == 0 and row["valid_share"] is None
    scores = spark.createDataFrame([], "prob_evasao double, situacao string")
    assert key_figures(scores).first()["high_pct"] is None


def test_top_lists(spark):
    df = spark.createDataFrame([("a", -3.0), ("b", 2.0), ("c", 1.0)], "feature string, importance double")
    assert [r["feature"] for r in top_importance(df, 2).collect()] == ["a", "b"]
    assert [r["feature"] for r in top_importance(df, 2, signed=True).collect()] == ["b", "c"]
    scores = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5)], "k int, prob_evasao double")
    assert [r["k"] for r in top_scored(scores, ["k"], 3).collect()] == [1, 3, 2]


def test_roll_up_keeps_silent_sources(spark):
    parts = spark.createDataFrame([(1, "c_x", 0.5), (1, "c_y", -0.2), (2, "n", 1.0)], "r int, feature string, contribution double")
    lineage = spark.createDataFrame([("c_x", "c"), ("c_y", "c"), ("n", "n"), ("u", "u")], "feature string, source string")
    rows = spark.createDataFrame([(1,), (2,)], "r int")
    got = {(r["r"], r["source"]): round(r["contribution"], 6) for r in roll_up_sources(parts, lineage, "r", rows).collect()}
    assert got == {(1, "c"): 0.3, (1, "n"): 0.0, (1, "u"): 0.0, (2, "c"): 0.0, (2, "n"): 1.0, (2, "u"): 0.0}


def test_missing_scores_do_not_count(spark):
    df = spark.createDataFrame(
        [(0.2, 0), (0.8, 1), (None, 1), (float("nan"), 0), (0.9, None)], "p double, y int"
    )
    row = roc_auc(df, "p", "y").first()
    assert (row["roc_auc"], row["positives"], row["negatives"]) == (1.0, 1, 1)


@pytest.mark.parametrize("final_values", [5, 300, 20_000])
def test_exact_ranks(spark, final_values):
    df = spark.range(0, 3000).select(
        ((F.col("id") * 7919) % 2999).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.lit(4.0)).alias("b"),
        F.lit(None).cast("double").alias("c"),
    )
    found = exact_ranks(df, ["a", "b", "c"], 0.2, lambda n: (n // 5, n // 5 + 1), final_values)
    values = sorted(r.a for r in df.select("a").collect())
    assert found == {"a": [values[600], values[601]], "b": [4.0, 4.0], "c": []}


def test_quota_split_keeps_to_every_class(spark):
    df = spark.range(0, 50_000).select(
        F.col("id"), F.when(F.col("id") % 11 == 0, 1).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(0).alias("y")
    )
    split = quota_split(df, ["id"], "y")
    out = df.withColumn("s", split)
    counts = {(r.y, r.s): r["count"] for r in out.groupBy("y", "s").count().collect()}
    for y in (0, 1):
        n = counts[y, "train"] + counts[y, "val"]
        assert counts[y, "val"] == math.floor(0.2 * n + 0.5)
    assert (None, "val") not in counts
    # The class's first rows in hashed order, and the plan holds no sort, window or shuffle.
    edge = out.withColumn("h", hash_place(["id"])).where("y = 1").groupBy("s").agg(F.min("h"), F.max("h")).collect()
    sides = {r.s: r for r in edge}
    assert sides["val"][2] < sides["train"][1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Sort", "Window", "Exchange"))
    again = df.repartition(7).withColumn("s", split).exceptAll(out)
    assert again.isEmpty()


def test_quota_split_without_rows_or_with_one_class(spark):
    df = spark.range(0, 40).select("id", F.lit(1).alias("y"))
    assert df.withColumn("s", quota_split(df, ["id"], "y")).where("s = 'val'").count() == 8
    none = df.limit(0)
    assert none.withColumn("s", quota_split(none, ["id"], "y")).count() == 0
    few = df.limit(2)
    assert few.withColumn("s", quota_split(few, ["id"], "y")).where("s = 'val'").count() == 0


def test_scores_are_read_once_for_all_rank_measures(spark, tmp_path):
    path = str(tmp_path / "scores")
    spark.range(0, 500).select((F.col("id") % 97 / 97.0).alias("p"), (F.col("id") % 5 == 0).cast("int").alias("y")).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scores = spark.read.parquet(path).mapInArrow(count, "p double, y int")
    steps = score_steps(scores, "p", "y")
    assert steps.agg(F.sum("pos"), F.max("neg_all")).first()[:] == (100, 400)
    assert seen.value == 500 and "parquet" not in steps._jdf.queryExecution().executedPlan().toString()


def test_distribution_drift_of_odd_columns(spark):
    from earlywarn.operators.profile import distribution_drift

    before = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, None, 5.0), (float("nan"), None, 5.0)], "a double, b double, c double")
    after = spark.createDataFrame([(0.0, 3.0, 5.0), (9.0, None, 6.0), (2.0, None, 5.0)], "a double, b double, c double")
    got = {r["column"]: r for r in distribution_drift(before, after, ["a", "b", "c"]).collect()}
    assert got["a"].beyond == pytest.approx(2 / 3) and (got["a"].missing_before, got["a"].missing_after) == (0.5, 0.0)
    assert got["a"].largest_gap == pytest.approx(1 / 3) or got["a"].largest_gap == pytest.approx(1 / 2)
    assert got["b"].beyond == pytest.approx(1 / 3) and got["b"].missing_before == 1.0
    assert got["c"].beyond == pytest.approx(1 / 3) and got["c"].largest_gap == pytest.approx(1 / 3)
    same = {r["column"]: r for r in distribution_drift(before, before, ["a", "b", "c"]).collect()}
    assert all(r.psi == 0.0 and r.largest_gap == 0.0 and r.beyond == 0.0 for r in same.values())
    none = distribution_drift(before, before.limit(0), ["a"]).first()
    assert none.psi > 0 and none.missing_after == 0.0
    plan = distribution_drift(before, after, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and "Join" not in plan


@pytest.fixture
def crowded(spark):
    """A third of the rows under one key, a third without a key, the rest under keys of their own."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    return spark.range(0, 9000).select("id", k.cast("bigint").alias("k"))


def test_hot_keys_are_found_and_only_they_are_copied(spark, crowded, monkeypatch):
    from earlywarn.operators import lookups

    hashes = dict(crowded.select("k", F.xxhash64("k")).distinct().collect())
    assert set(lookups.hot_keys(crowded, ["k"])) == {hashes[7], hashes[None]}
    table = spark.range(0, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert lookups.hot_keys(table.select("k"), ["k"]) == [] == lookups.hot_keys(table.limit(0), ["k"])
    want = crowded.join(table, "k", "left").select("id", "k", "v")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    copied = []
    original = lookups.F.explode
    monkeypatch.setattr(lookups.F, "explode", lambda c: copied.append(c) or original(c))
    for rows in (None, 6000):
        monkeypatch.setattr(lookups, "MAX_BROADCAST_BYTES", 1000)  # few rows, too many bytes
        got = lookups.lookup_join(crowded, table.mapInArrow(count, table.schema), ["k"], rows=rows).select("id", "k", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 9000
    assert len(copied) == 2
    copies = table.withColumn("_s", F.xxhash64("k").isin(lookups.hot_keys(crowded, ["k"])))
    assert copies.where("_s").count() == 1  # 15 more rows, not 15 times the table
    plain = lookups.lookup_join(crowded, table, ["k"], salts=1).select("id", "k", "v")
    assert plain.exceptAll(want).isEmpty()


def test_a_table_of_long_values_is_not_broadcast(spark):
    from earlywarn.operators import lookups

    long = spark.range(0, 20).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 5_000_000).alias("v"))
    assert lookups.table_bytes(long) > lookups.MAX_BROADCAST_BYTES
    joined = lookups.lookup_join(spark.range(0, 5).toDF("k"), long, ["k"], rows=20, salts=1)
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString()


def test_sketches_are_as_few_as_cores_can_make(spark):
    df = spark.range(0, 3_000, 1, 48).select((F.col("id") * 7919 % 3_000).cast("double").alias("x"))
    context = spark.sparkContext
    context.setJobGroup("sketches", "many small partitions")
    found = exact_medians(df, ["x"], final_values=100)
    tracker = context.statusTracker()
    first = min(tracker.getJobIdsForGroup("sketches"))
    tasks = [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(first).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"x": 1499.5} and max(tasks) <= 2 * context.defaultParallelism
