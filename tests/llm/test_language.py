import numpy as np

from threadloom.llm import language

SAMPLES = {"en": "the cat and the dog with that thing of theirs", "de": "der hund und die katze sich nicht über ein", "fr": "le chat et la souris où les élèves étaient"}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.choice(SAMPLES[lang].split(), 30))) for lang in SAMPLES for _ in range(n)]


def test_held_out_accuracy():
    learned = corpus(40, 1)
    network = language.fitted([language.all_windows(t) for _, t in learned], [lang for lang, _ in learned])
    held = corpus(20, 2)
    got = network.predict([t.upper() for _, t in held])
    assert sum(p == lang for (p, _), (lang, _) in zip(got, held, strict=True)) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for _, s in got)


def test_pooling_against_plain_convolution():
    network = language.Network.new(["a", "b"]).ready()
    rows = language.windows("Some text, with é and 12 bytes. " * 20)
    best, at = network.pooled(rows, True)
    for i, r in enumerate(rows):
        j = 0
        for w, f in zip(language.WIDTHS, network.filters, strict=True):
            plain = np.array([sum(f[k, r[p + k]] for k in range(w)) for p in range(language.WINDOW - w + 1)])
            assert np.allclose(best[i, j : j + language.FILTERS], plain.max(axis=0), atol=1e-5)
            j += language.FILTERS


def test_nulls_letters_and_nothing(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate(corpus(10, 3))] + [(100, None, "en", "x"), (101, " 12 !", "en", "x"), (None, "", None, "x"), (102, "der und nicht " * 50_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs)).collect()}
    assert len(got) == len(rows)
    assert got[100] == got[101] == got[None] == ("und", 0.0)
    assert got[102][0] == "de"
    nothing = docs.filter("false")
    assert language.identify(nothing, language.learn(nothing)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(nothing)).collect()} == {"und"}
