import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import blocks, forest, pivots


def vectors(n, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, d))
    return x


def truth(ids, x, q_ids, k):
    out = {}
    for i in q_ids:
        s = x[ids.index(i)] @ x.T
        order = np.lexsort((ids, -s))
        out[i] = [(ids[j], s[j]) for j in order if ids[j] != i][:k]
    return out


def table(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row], "x") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score string").repartition(3)


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_forest_recall(spark, scale):
    x = vectors(1500)
    if scale:
        x *= np.random.default_rng(2).uniform(0.2, 3, (len(x), 1))
    got = collected(forest.neighbours(table(spark, x), F.col("vec_id") % 20 == 0, 10))
    want = truth(list(range(len(x))), x, range(0, 1500, 20), 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert all(abs(s - x[q] @ x[i]) < 1e-9 for q in got for i, s in got[q])


@pytest.mark.parametrize("rows", [64, 4096])
def test_pivots_are_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(pivots, "ROWS", rows)
    x = vectors(900, 6)
    x[100:160] = x[0]
    f = np.floor(64 * x)
    got = collected(pivots.top_products(table(spark, x), F.col("vec_id") % 20 == 0, pivots.scaled_floor(), 7))
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in truth(list(range(900)), f, range(0, 900, 20), 7).items()}


def test_large_integers_stay_exact(spark):
    x = np.array([[2.0**22 + 1 / 64, 3.0], [2.0**22, 5.0], [-1.0, 2.0]])
    got = collected(pivots.top_products(table(spark, x), F.col("vec_id") == 0, pivots.scaled_floor(), 5))
    f = [[int(np.floor(64 * v)) for v in row] for row in x]
    assert got[0] == sorted([(i, f[0][0] * f[i][0] + f[0][1] * f[i][1]) for i in (1, 2)], key=lambda p: -p[1])


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [inf, 0.0]), (7, [1.0]), (8, []), (20, [0.0, -1.0]), (1, [0.5, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(forest.neighbours(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {0: [(1, 0.5), (20, 0.0)], 20: [(0, 0.0), (1, -0.5)]}
    got = collected(pivots.top_products(df, F.col("vec_id") % 20 == 0, pivots.scaled_floor(), 20))
    assert got == {0: [(1, 2048), (5, 0), (20, 0)], 20: [(0, 0), (5, 0), (1, -2048)]}
    for none in (df.filter("false"), df.filter("vec_id = 2"), df.filter("vec_id = 0")):
        assert forest.neighbours(none, F.col("vec_id") % 20 == 0).count() == 0
        assert pivots.top_products(none, F.col("vec_id") % 20 == 0, pivots.scaled_floor()).count() == 0


def test_many_equal_vectors(spark):
    x = np.r_[np.tile([[1.0, 2.0, 3.0]], (400, 1)), vectors(200, 3)]
    got = collected(forest.neighbours(table(spark, x), F.col("vec_id") % 20 == 0, 20))
    exact = collected(pivots.top_products(table(spark, x), F.col("vec_id") % 20 == 0, pivots.scaled_floor(), 20))
    assert len(got) == len(exact) == 30
    want = truth(list(range(600)), np.floor(64 * x), [0, 380], 20)
    assert exact[380] == [(i, int(s)) for i, s in want[380]] and exact[0] == [(i, int(s)) for i, s in want[0]]


def test_cut_spreads_heavy_bins():
    counts = np.array([[3, 0, 50, 4, 9], [0, 0, 0, 1, 1]])
    cut = blocks.Cut.of(counts, 10)
    assert cut.spread[0].tolist() == [1, 1, 5, 1, 1]
    held = np.zeros(cut.blocks)
    for (g, b), c in np.ndenumerate(counts):
        held[cut.base[g, b] : cut.base[g, b] + cut.spread[g, b]] += c / cut.spread[g, b]
    assert held.max() <= 10 and held.sum() == counts.sum()
