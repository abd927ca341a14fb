import numpy as np
import pytest
from pyspark.sql import functions as F

from quadspark.llm import ann


def frame(spark, v, extra=()):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"uid": F.lit(1), "raw": F.lit("x"), "score": F.lit(2.0), "_h": F.lit(3)})


def exact(ids, v, queries, k):
    out = {}
    for q in queries:
        s = v[ids == q][0] @ v.T
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df, step, k, **options):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % step == 0, k=k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_few_vectors_are_searched_exactly_with_ties_and_bad_rows(spark):
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (60, 5)).astype(np.float32)
    v[v.sum(1) == 0, 0] = 1
    v[30:50] = v[0]  # a hot vector
    bad = [(100, None), (200, []), (300, [0.0] * 5), (400, [1.0, None, 1.0, 1.0, 1.0]), (500, [float("nan")] * 5), (600, [float("inf")] + [1.0] * 4), (700, [1.0] * 3), (None, [1.0] * 5)]
    df = frame(spark, v, bad)
    assert found(df, 10, 7) == exact(np.arange(60), v.astype(float), range(0, 60, 10), 7)
    few = found(df, 10, 100)
    assert all(len(x) == 59 for x in few.values())


def test_empty_tables(spark):
    df = frame(spark, np.ones((1, 3)))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 2 == 0).count() == 0
    assert found(df, 1, 5) == {}
    assert ann.nearest(frame(spark, np.zeros((4, 3))), F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_small_blocks(spark, monkeypatch, scaled):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(2)
    v = r.normal(size=(5000, 24))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * (r.uniform(0.5, 2, (5000, 1)) if scaled else 1)).astype(np.float32)
    got, want = found(frame(spark, v), 50, 20), exact(np.arange(5000), v.astype(float), range(0, 5000, 50), 20)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(len(x) == 20 and x == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


def test_recall_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet").where(ann.usable(F.col("embedding")))
    ids, v = zip(*((r.vec_id, r.embedding) for r in df.collect()))
    ids, v = np.array(ids), np.array(v, float)
    got, want = found(df, 20, 20), exact(ids, v, [i for i in ids if i % 20 == 0], 20)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_recall_with_forty_times_the_lists_that_are_visited(spark, monkeypatch):
    fits = []
    real = ann.fitted
    monkeypatch.setattr(ann, "fitted", lambda at, d, *rest: fits.append((real(at, d, *rest), at, d)) or fits[-1][0])
    monkeypatch.setattr(ann, "LEAST_LISTS", 700)
    r = np.random.default_rng(5)
    v = (r.normal(size=(1200, 32))[r.integers(0, 1200, 45_000)] + 0.15 * r.normal(size=(45_000, 32))).astype(np.float32)
    got, want = found(frame(spark, v), 100, 20), exact(np.arange(45_000), v.astype(float), range(0, 45_000, 100), 20)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    (visited, ratio), at, d = fits[-1]
    each = np.mean([len(x) for x in ann.reach(at[:, :visited], d[:, :visited], ratio)])
    assert 700 >= 40 * each


def test_fitted_takes_what_visits_fewer_lists():
    d = np.array([[1.0, 4.0, 9.0, 100.0], [100.0, 90.0, 80.0, 1.0]])
    at = np.argsort(d, 1)
    d = np.sort(d, 1)
    visited, ratio = ann.fitted(at, d, [(0, [2]), (1, [3])], 1.0)
    assert [len(x) for x in ann.reach(at[:, :visited], d[:, :visited], ratio)] == [3, 1]
    assert ann.fitted(at, d, [(0, [3, 1]), (1, [2])], 1.0) == (2, float("inf")) and ann.fitted(at, d, [], 0.9) == (4, float("inf"))
    assert ann.fitted(at[:, :1], d[:, :1], [(0, [3])], 0.9) is None


@pytest.mark.parametrize("n,width", [(500, 10), (4096, 20), (4096, 200), (60, 60), (9, 5), (1, 3)])
def test_graph_search_finds_the_nearest_centroids(n, width):
    r = np.random.default_rng(3)
    c, x = r.normal(size=(n, 16)), r.normal(size=(300, 16))
    at, d = ann.CentroidGraph(c).search(x, width)
    width = min(width, n)
    true = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
    best = np.argsort(true, 1)[:, :width]
    assert at.shape == d.shape == (300, width) and (np.diff(d, axis=1) >= 0).all()
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at, best)]) > 0.95 * width
    assert np.allclose(d[at >= 0], np.take_along_axis(true, np.maximum(at, 0), 1)[at >= 0], atol=1e-3) and all(len(set(a[a >= 0])) == (a >= 0).sum() for a in at)


def test_halving_is_balanced():
    r = np.random.default_rng(4)
    x = np.concatenate([np.zeros((700, 4)), r.normal(size=(300, 4))])
    parts = ann.halve(x, 8, r)
    assert sorted(np.concatenate(parts)) == list(range(1000)) and max(map(len, parts)) <= 2 * 1000 / 8
