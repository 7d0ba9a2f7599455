import numpy as np
import pytest

from threadloom.llm import quality

GOOD = "It is a plain text about the sea and the people who live by it, number {}."
BAD = "BUY!! NOW!! $$$ CHEAP!! ### {}"


def table(spark, n=120):
    rows = [(i, (GOOD if i % 4 else BAD).format("w" * (i % 9)) + (" you scum" if i % 10 == 1 else ""), f"h{i % 3}", "en" if i % 2 else None, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string")


def label(spark, ids):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 10 == 1)) for i in ids], "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs = table(spark)
    got = quality.score(docs, label(spark, range(60))).collect()
    assert len(got) == 120
    for r in got:
        assert r.keep == (r.doc_id % 4 != 0 and r.doc_id % 10 != 1), r
    kept = quality.accepted(docs, label(spark, range(60)))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 4 and i % 10 != 1}


def test_shrinkage_of_sparse_sites(spark):
    even = spark.createDataFrame([(50.0, 100), (49.0, 100), (51.0, 100), (1.0, 1)], "g double, n long")
    apart = spark.createDataFrame([(90.0, 100), (10.0, 100), (85.0, 100), (15.0, 100)], "g double, n long")
    assert quality.shrinkage(even, "g", "n")[1] > 100 > 10 > quality.shrinkage(apart, "g", "n")[1]
    assert quality.shrinkage(even.filter("false"), "g", "n") == (0.5, 1.0)


def test_site_moves_an_undecided_text(spark):
    rows = [(i, GOOD.format(i % 7) if s == "good" else BAD.format(i % 7), s, "en") for i, s in enumerate(["good", "bad"] * 60)] + [(900, "", "good", "en"), (901, "", "bad", "en"), (902, "", "new", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(r[2] == "good"), 0) for i, r in enumerate(rows[:120])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_score for r in quality.score(docs, labels).collect()}
    assert got[900] > got[902] > got[901]


def test_logistic_against_plain_gradient():
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=(200, 2)), np.ones(200)]
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.2).astype(float)
    w = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - np.array([1, 1, 1e-6]) * w).max() < 1e-4


def test_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b", "s", "en"), (1, None, None, None), (2, "long " * 100_000, "s", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 1), (2, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        got = quality.score(docs, some).collect()
        assert len(got) == 4 and all(0 < r.quality_score < 1 for r in got)
    assert quality.score(docs.filter("false"), labels).count() == 0
