"""Whitening against numpy and exact whole numbers."""

import math

import numpy as np
import pytest

from earlywarn.llm.queries import QUERIES
from earlywarn.llm.whitening import WhitenSpec, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x int, index int, component int, n int, deviation string"


def expected(rows, components=32):
    """By the definition: whole numbers, the covariance of all rows, its eigenvectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array([[a / n for a in row] for row in exact])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * len(values) * np.finfo(float).eps).sum()))
    return [sum(a * a for a in row) for row in exact], centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(got, ids, rows, components=32):
    deviation, whitened, explained = expected(rows, components)
    k = whitened.shape[1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == len(rows) * k
    table = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.allclose(table, whitened * signs, atol=1e-8)
    for i, d in zip(ids, deviation):
        for c in range(k):
            r = by[i, c + 1]
            assert r.n == len(rows) and r.deviation == (d if d < 2**63 else None)
            assert math.isclose(r.explained, explained[c], rel_tol=1e-8)
    errors = {r.identity_error for r in got}
    covariance = np.cov(table.T, bias=True).reshape(k, k)
    assert len(errors) == 1 and errors.pop() <= 1e-8 and np.abs(covariance - np.eye(k)).max() < 1e-8


def test_query_equals_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(QUERIES["op12_whitening"](spark, sf_dir).collect(), [r.vec_id for r in good], [r.embedding for r in good])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "d") for i, v in rows], SCHEMA).repartition(3)


def test_messy_rows_are_dropped_and_blocks_do_not_matter(spark):
    draw = np.random.RandomState(3)
    good = [(i, draw.normal(size=5).astype("float32").tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (104, [1.0, 2.0]), (105, [])]
    for block_rows in (7, 4096):
        got = whiten(table(spark, good + bad), WhitenSpec(block_rows=block_rows, components=3)).collect()
        check(got, [i for i, _ in good], [v for _, v in good], components=3)


def test_repeated_and_unnamed_rows_keep_their_own(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, 2.0]), (None, [1.0, -3.0]), (None, [2.0, 2.5])]
    got = whiten(table(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted([str(i) for i, _ in rows] * 2)
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-9


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    got = whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    for some in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, [])]):
        assert whiten(table(spark, some)).collect() == []


def test_deviations_stay_exact_beyond_64_bits(spark):
    rows = [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [3.0, 5.0]), (3, [4.0, -2.0])]
    got = {r.vec_id: r.deviation for r in whiten(table(spark, rows)).collect()}
    exact = expected([np.float32(v).tolist() for _, v in rows])[0]
    assert all(got[i] == (exact[i] if exact[i] < 2**63 else None) for i in got) and got[0] is None


def test_too_many_dimensions_are_refused(spark):
    with pytest.raises(ValueError):
        whiten(table(spark, [(1, [1.0, 2.0, 3.0])]), WhitenSpec(max_dimensions=2))
