import pytest

from threadloom.llm.mixing import mix_sources, source_targets


def test_targets_fill_up_to_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    assert got["a"] == 20.0
    assert sum(got.values()) == pytest.approx(240)
    assert got["b"] == pytest.approx(140) and got[None] == pytest.approx(80) or got[None] == pytest.approx(100)


def test_mix_is_near_its_targets_and_repeatable(spark):
    rows = [(i, f"s{i % 4 if i % 3 else 0}", "w " * (i % 17 + 1), "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    first = sorted(map(tuple, mix_sources(docs.repartition(7)).collect()))
    assert first == sorted(map(tuple, mix_sources(docs.repartition(2)).collect()))
    taken, targets = {}, {}
    for _, source, size, total, target, repeats in first:
        assert 0 <= repeats <= 2
        taken[source] = taken.get(source, 0) + repeats * size
        targets[source] = target
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 2 * 17
    assert sum(taken.values()) <= 1.5 * sum(r[2] for r in first) <= sum(taken.values()) + 17


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a", "x y"), (None, "a", "x y"), (2, "a", " \t "), (3, None, "q " * 50_000)], "doc_id long, source string, text string")
    got = mix_sources(docs).collect()
    assert len(got) == 5
    assert {r.repeats for r in got if r.size == 0} == {0}
    assert len({r.repeats for r in got if r.source == "a" and r.size}) == 1
    assert mix_sources(docs.filter("false")).count() == 0
