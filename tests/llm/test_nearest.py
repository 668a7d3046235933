import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.nearest import axes, hadamard, nearest


def brute(ids, x, asks, k):
    out = {}
    for i in asks:
        s = x @ x[ids.index(i)]
        best = sorted((-(float(np.dot(x[ids.index(i)], x[j]))), v) for j, v in enumerate(ids) if v != i)
        out[i] = [v for _, v in best[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 24)) + rng.standard_normal((6, 24))[rng.integers(0, 6, 600)] * 2
    x[50:90] = x[50]
    return list(range(600)), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.linalg.norm(hadamard(x), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert axes(x, 0).shape == (5, 32)


def test_recall_and_order(spark, vectors):
    ids, x = vectors
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x)]
    rows += [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [None] + [1.0] * 23, 0), (1003, [float("nan")] * 24, 0), (1004, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    got = nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    want = brute(ids, x, ids[::20], 20)
    assert sorted(by) == sorted(want)
    assert all([r.rank for r in v] == list(range(1, 21)) for v in by.values())
    assert all(r.score == pytest.approx(float(np.dot(x[r.query_id], x[r.vec_id])), abs=1e-12) for r in got)
    assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for v in by.values() for a, b in zip(v, v[1:]))
    assert np.mean([len({r.vec_id for r in by[i]} & set(want[i])) / 20 for i in want]) >= 0.9


def test_all_candidates_if_few(spark):
    rows = [(i, [float(i + 1), 1.0, 0.5]) for i in range(5)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert len(got) == 20 and {r.rank for r in got} == {1, 2, 3, 4}


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in random.Random(0).sample(range(100), 40)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=3).collect()
    ids = sorted(i for i, _ in rows)
    assert all([x.vec_id for x in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in ids if i != q][:3] for q in ids)


def test_repeated_rows_of_equal_vectors_are_one_candidate(spark):
    rows = [(i, [1.0, 0.0]) for i in range(8)] * 5 + [(100 + i, [0.6, 0.8]) for i in range(8)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 7, k=4).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, 1.0) for i in range(4)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df, F.lit(True)).collect() == []


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_recall_by_functions(spark, vectors, functions):
    ids, x = vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    report = {}
    got = nearest(df, F.col("vec_id") % 20 == 0, functions=functions, report=report).collect()
    want = brute(ids, x, ids[::20], 20)
    found = {i: {r.vec_id for r in got if r.query_id == i} for i in want}
    assert np.mean([len(found[i] & set(want[i])) / 20 for i in want]) >= 0.9
    assert report["recall"] >= 0.95 and 0 < report["products"]


def test_less_work_as_vectors_grow(spark):
    rng = np.random.default_rng(2)
    shares, recalls = [], []
    for n in (5_000, 40_000):
        x = rng.standard_normal((n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": range(n), "embedding": list(x)}), "vec_id long, embedding array<float>").repartition(8)
        report = {}
        got = nearest(df, F.col("vec_id") % 200 == 0, report=report).toPandas()
        y = x.astype(np.float64)
        s = y[::200] @ y.T
        s[np.arange(len(s)), np.arange(0, n, 200)] = -9
        true = np.argsort(-s, axis=1)[:, :20]
        own = got.groupby("query_id").vec_id.apply(set)
        recalls.append(np.mean([len(own[i * 200] & set(t.tolist())) / 20 for i, t in enumerate(true)]))
        shares.append(report["products"])
    assert min(recalls) >= 0.9 and shares[1] < 0.75 * shares[0], (recalls, shares)


def test_other_columns_take_no_part(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 1, 2, 3) for i in range(30)], "vec_id long, embedding array<double>, id int, x int, `a.b` int")
    assert nearest(df, F.col("vec_id") % 20 == 0, k=3).count() == 6
