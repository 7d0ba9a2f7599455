from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from threadloom.llm import pieces, quality, secrets, simhash  # noqa: E402
from threadloom.llm.queries import PIECES  # noqa: E402

GOOD = "Plain text number {} is about the sea, the land and all who live there by {} words of {}."
BAD = "BUY!! NOW!! $$$ CHEAP!! ### {}"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    texts = [(BAD if i % 4 == 0 else GOOD).format(*[f"w{i * j % 101}q{i}" for j in (1, 2, 3)]) for i in range(200)]
    texts[7] = texts[5]
    texts[9] += ' token = "0123456789abcdef0123456789abcdef"'
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200, 2)] + [(i, 1, 0) for i in range(1, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_each_stage_works_on_what_was_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = pipeline.keep_quality(spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(200) if i % 4} <= ids and not {i for i in range(200) if i % 4 == 0} & ids
    single = pipeline.drop_near_duplicates(spark, kept, folder)
    left = {r.doc_id for r in single.collect()}
    assert 5 in left and 7 not in left
    texts = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        texts.setdefault(r.text or "", r.doc_id)
    assert left == set(texts.values()) and simhash
    clean = pipeline.remove_secrets(spark, single, folder)
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id.keys() == left and "0123456789abcdef" not in by_id[9].text and by_id[9].n_chars == len(by_id[9].text)
    assert all(by_id[i].text == r.text for i, r in ((r.doc_id, r) for r in single.collect()) if i != 9)
    mix = pipeline.mix(spark, clean, folder)
    taken = Counter(r.doc_id for r in mix.collect())
    assert taken and max(taken.values()) <= 2 and taken.keys() <= left
    assert kept.columns == single.columns == clean.columns == mix.columns == columns
    last = pipeline.tokenize(spark, mix, folder)
    codec = pieces.Codec(PIECES)
    for r in last.collect():
        assert r.ids == codec.reference.encode(by_id[r.doc_id].text)


def test_run_is_repeatable(spark, folder):
    first = sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, folder).collect())
    assert first and first == sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, folder).collect())
    assert [name for name, _ in pipeline.STAGES] and pipeline.ORACLE_SQL is None
    assert quality and secrets
