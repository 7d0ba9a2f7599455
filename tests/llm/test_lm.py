import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import lm, recurrent


def small_model():
    counts = np.arange(200, 0, -1).astype(float)
    model = recurrent.Model.new(counts, 10, 30)
    rng = np.random.default_rng(1)
    for t in (model.classes, model.words):
        t += rng.normal(0, 0.3, t.shape).astype(t.dtype)
    return model


def plain_score(model, symbols):
    """One symbol at a time, the whole softmax spelled out."""
    h, last, total = np.zeros((1, recurrent.HIDDEN), np.float32), model.end, 0.0
    for y in symbols:
        h = model.step(np.array([last]), h)[0]
        z = (h @ model.classes + model.class_bias)[0].astype(float)
        p = np.exp(z - z.max())
        p /= p.sum()
        if y < model.end:
            c, w = divmod(int(y), recurrent.CLASS_WORDS)
            v = (h[0] @ model.words[c] + model.word_bias[c]).astype(float)
            q = np.exp(v - v.max())
            total += math.log(p[c]) + math.log(q[w] / q.sum())
        else:
            total += math.log(p[recurrent.CLASSES + y - model.end])
        last = y
    return total


def test_state_is_carried_across_windows(monkeypatch):
    model = small_model()
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 200, n), model.end) for n in (0, 3, 700, 40)] + [np.array([model.unknown, model.end])]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.score(texts), want, rtol=1e-4)
    monkeypatch.setattr(recurrent, "SCORE_WINDOW", 7)
    assert np.allclose(model.score(texts), want, rtol=1e-4)
    assert len(model.score([])) == 0


def test_probabilities_sum_to_one():
    model = small_model()
    symbols = np.append(np.arange(200), [model.end, model.unknown])
    states = np.tile(np.random.default_rng(3).normal(size=(1, recurrent.HIDDEN)).astype(np.float32), (len(symbols), 1))
    assert np.exp(model.log_odds(states, symbols)).sum() == pytest.approx(1, abs=1e-3)


def test_gradients_against_differences():
    model = small_model()
    for name in ("enter", "recur", "classes", "class_bias", "words", "word_bias"):
        setattr(model, name, getattr(model, name).astype(float))
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 200, (5, 3)), rng.integers(0, 200, (5, 3))
    x[2, 1], y[1, 1], y[3, 0] = model.end, model.end, model.unknown
    h = rng.normal(size=(3, recurrent.HIDDEN)) * 0.1
    _, grads, _ = model.gradients(x, y, h)
    for table, (rows, g) in zip(model.tables(), grads, strict=True):
        whole = np.zeros_like(table)
        whole[rows] = g
        for cell in sorted(zip(*np.unravel_index(np.argsort(-np.abs(whole), axis=None)[:3], whole.shape), strict=True)):
            before = table[cell]
            values = []
            for e in (1e-4, -1e-4):
                table[cell] = before + e
                values.append(model.gradients(x, y, h)[0])
            table[cell] = before
            assert whole[cell] == pytest.approx((values[0] - values[1]) / 2e-4, rel=2e-2, abs=1e-3)


def learns():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def corpus():
    rng = np.random.default_rng(5)
    kinds = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]]
    texts = [" ".join(rng.choice(kinds[i % 2], 80, p=np.arange(60, 0, -1) / 1830)) + (" Rare%d" % i if i % 5 == 0 else "") for i in range(240)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("held", [lm.HELD_WORDS, 20, 0])
def test_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(lm.lexicon, "__defaults__", (held,))
    rows = corpus() + [(500, None), (501, ""), (502, " \t"), (503, "never seen before words"), (7, corpus()[7][1])]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = {}
    for r in lm.scores(docs, learns()).collect():
        got.setdefault(r.doc_id, []).append(r)
    c, n = Counter(), 0
    tokens = {k: [*(t or "").lower().split(), None] for k, t in enumerate(t for _, t in rows)}
    for k, (i, _) in enumerate(rows):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens[k])
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(rows) and len(got[7]) == 2
    for k, (i, _) in enumerate(rows):
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[k]), rel=1e-9)
            assert r.score < 0
            own = Counter(tokens[k]) if zlib.crc32(str(i).encode()) % 7 != 2 else Counter()
            assert r.n_elsewhere == sum(c[w] > own[w] for w in tokens[k]) and r.elsewhere == r.n_elsewhere / r.n_tokens
    if held == lm.HELD_WORDS:
        unseen = [r for i, _ in corpus() for r in got[i] if zlib.crc32(str(i).encode()) % 7 == 2]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) * 0.97


def test_nothing_learned_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scores(docs, F.lit(False)).collect()}
    assert got[None].n_known == 0 and got[None].train_tokens == 0 and got[None].base_score == 0
    assert lm.scores(docs.filter("false"), F.lit(True)).count() == 0


def test_all_learning_documents_train(spark, monkeypatch):
    seen, plain = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda texts, known: seen.append(texts.count()) or plain(texts, known))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm.scores(docs, learns()).count() == len(corpus())
    assert seen == [sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in corpus())]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    runs = [{r.doc_id: r.score / r.n_tokens for r in lm.scores(docs.repartition(n), learns()).collect()} for n in (1, 16)]
    assert runs[0].keys() == runs[1].keys() and all(abs(runs[0][k] - runs[1][k]) < 1e-6 for k in runs[0])


def test_averaged_copies_against_plain_ones(spark, monkeypatch):
    """The model of three shards is the mean, by use, of three copies trained here."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 6500)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.word_counts(docs).cache()
    known = lm.lexicon(counts, len(rows))
    shards = round(known.tokens / 6500)
    assert shards == 3
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    got = lm.trained(docs, known)
    sums, uses = None, None
    for shard in range(shards):
        model = recurrent.Model.new(known.counts[: known.modelled].astype(float), known.ends, known.other_tokens + known.other_distinct + 1)
        model.unknown_weight = 1 + (known.other_distinct + 1) / max(known.other_tokens, 1)
        start = [t.astype(float) for t in model.tables()]
        look = lm.symbols_of(known, model)
        used = model.train(np.concatenate([look(lm.split(t.encode())) for i, t in sorted(rows, key=lambda r: h[r[0]]) if h[i] % shards == shard]))
        weighted = [t * n.reshape(-1, *[1] * (t.ndim - 1)) for t, n in zip(model.tables(), used)]
        sums, uses = (weighted, used) if sums is None else ([a + b for a, b in zip(sums, weighted)], [a + b for a, b in zip(uses, used)])
    for table, first, s, n in zip(got.tables(), start, sums, uses):
        n = n.reshape(-1, *[1] * (s.ndim - 1))
        assert np.allclose(table, np.where(n > 0, s / np.maximum(n, 1), first), atol=1e-5)
