import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import simhash


def classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, dtype=np.int64).view(np.uint64)
    for i in range(len(x)):
        for j in np.nonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3)[0]:
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_code_words_cover_two_errors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    for errors in (0, 1, 2):
        y = x.copy()
        for _ in range(errors):
            y ^= 1 << rng.integers(0, 23, len(x))
        (a, _), (b, _) = simhash.code_indices(x), simhash.code_indices(y)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_keys_of_all_links_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    for errors in range(4):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in x], dtype=np.uint64)
        y = (x.view(np.uint64) ^ flips).view(np.int64)
        ours, theirs = ({} for _ in range(2))
        for fps, into in ((x, ours), (y, theirs)):
            for r, k in zip(*simhash.link_keys(fps), strict=True):
                into.setdefault(int(r), set()).add(int(k))
        assert all(ours[i] & theirs[i] for i in ours)


def test_fingerprint_of_few_words():
    one = simhash.fingerprint(b"A b")
    assert one == simhash.fingerprint(b"  a\tB ") != 0
    assert simhash.fingerprint(b" \n") == simhash.fingerprint(None) == 0


def test_slices_of_long_texts_do_not_matter(monkeypatch):
    rng = np.random.default_rng(5)
    text = " \t".join("Ab%d" % i for i in rng.integers(0, 300, 4000)).encode()
    want = simhash.fingerprint(text), simhash.fingerprint(text, 1), simhash.fingerprint(b"a b")
    for size in (1, 7, 500):
        monkeypatch.setattr(simhash.word_slices, "__defaults__", (size,))
        assert (simhash.fingerprint(text), simhash.fingerprint(text, 1), simhash.fingerprint(b"a b")) == want


def test_components_against_brute_force(spark):
    words = "the of and to in is was for on with as by at from that".split()
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    texts = [None, "", "  "]
    for b in base:
        texts += [b, b] + [b + " " + x for x in ("tail", "end more")] + [b.replace("the", "th", 1)]
    texts.append("long " * 200_000)
    rows = [(i + 5, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [simhash.fingerprint((t or "").encode()) for _, t, _ in rows]
    assert [got[r[0]][0] for r in rows] == fps
    want = classes(fps)
    least = {c: min(rows[i][0] for i in range(len(rows)) if want[i] == c) for c in set(want)}
    assert [got[r[0]][1] for r in rows] == [least[c] for c in want]


def test_chain_and_star_of_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(3)
    from threadloom.llm.common import components

    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(50)}


def test_nulls_repeats_and_nothing(spark):
    schema = "doc_id long, text string, component_id string"
    rows = [(None, "a b c d", "z"), (3, "a b c d", "y"), (3, "a b c d", "y"), (None, None, None), (7, "other words are here", "w")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None), (7, 7)], key=str)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == ["3", "7", "None"]
    assert simhash.near_duplicates(docs.filter("false")).count() == 0 == simhash.deduplicated(docs.filter("false")).count()


def test_groups_that_share_an_id_keep_one_row_each(spark):
    texts = ["sun and moon over the sea", "nine tall trees by a wall", "quite other words stand here"]
    rows = [(None, t) for t in texts for _ in range(2)] + [(4, "one id of a first text"), (4, "but also of some second one"), (4, "one id of a first text"), (5, "one id of a first text")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted({t for _, t in rows})


def jaccard(a, b, n=5):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (t.lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_documents_that_go_are_like_one_that_stays(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for group in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(40, 300))))
        for copy in range(int(rng.integers(1, 9))):
            # Each copy differs from the one before it, so the last ones are further from the first.
            for at in rng.integers(0, len(words), copy % 3):
                words[at] = str(rng.choice(vocabulary))
            rows.append((int(rng.integers(0, 10**6)), " ".join(words) if copy % 4 else " ".join(words).upper(), group))
    rows += [(i, t, -1) for i, t in ((1, ""), (2, None), (3, " "), (4, "one"), (5, "one"), (6, "two"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int").withColumnRenamed("t", "group")
    kept = simhash.deduplicated(docs).collect()
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 2).collect()}
    texts = {r.doc_id: r.text or "" for r in kept}
    for i, t, _ in rows:
        if i not in texts:
            assert any(j != i and group[j] == group[i] and jaccard(t or "", x or "") >= 0.8 for j, x, _ in rows)
    assert {group[i] for i, _, _ in rows} == {group[i] for i in texts}
    assert len(kept) < len(rows) - 15 and {1, 4, 6} <= texts.keys() and not {2, 3, 5} & texts.keys()


def test_repeated_ids_in_any_partitions(spark):
    a, b = "the first of these two texts tells of the sea", "but another one that is longer speaks of mountains and of snow"
    rows = [(3, b, "x"), (5, a, "y"), (5, b, "z"), (5, a, "y")]
    for n in (1, 2, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(n)
        assert sorted(map(tuple, simhash.deduplicated(docs).collect())) == [(3, b, "x"), (5, a, "y")]


def test_fingerprint_against_its_statement():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 3, 4, 50, 700):
        words = [str(w) for w in rng.choice(["Aé", "b", "cC", "ddd", "ß"], n)]
        text = " \t".join(words)
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in words]
        shingles = [b" ".join(low[i : i + 3]) for i in range(len(low) - 2)] or ([b" ".join(low)] if low else [])
        found = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in found) * 2 > len(found))
        assert simhash.fingerprint(text.encode()) % 2**64 == want
        assert simhash.shingle_set(text.encode(), 3).tolist() == sorted({h - 2**64 if h >= 2**63 else h for h in found})


def test_links_grow_with_the_texts_not_with_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base, rows = [f"w{i}" for i in range(900)], []
    for i in range(160):
        words = list(base)
        words[int(rng.integers(0, 900))] = f"x{i}"
        rows.append((i, " ".join(words)))
    fps = np.array(sorted({simhash.fingerprint(t.encode(), 2) for _, t in rows}), dtype=np.int64).view(np.uint64)
    pairs = int((np.bitwise_count(fps[:, None] ^ fps) <= 3).sum()) - len(fps)
    assert pairs > 20 * len(fps)
    made, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links, *ends: made.append(links.count()) or components(links, *ends))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicated(docs).collect()] == [0]
    assert {r.component_id for r in simhash.near_duplicates(docs, 2).collect()} == {0}
    assert made and max(made) <= len(fps)


def crowded(seed, n=300):
    """Distinct fingerprints in some dense groups, of which some are near to each other, sorted."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(-(1 << 63), 1 << 63, 4, dtype=np.int64)
    centre = np.append(centre, centre ^ np.int64(0b111111))
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(n)]
    return np.unique(rng.choice(centre, n) ^ np.array(flips, dtype=np.uint64).view(np.int64))


def test_components_of_fingerprints_by_any_way(spark, monkeypatch):
    x = crowded(13)
    want = {int(x[i]): int(x[r]) for i, r in enumerate(classes(x))}
    docs = spark.createDataFrame([(v,) for v in x.tolist()], "fp long").repartition(3)
    for crowd in (4096, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r.node: r.root for r in simhash.fingerprint_components(docs).collect()}
        assert {k: got.get(k, k) for k in want} == want and set(want.values()) != set(want)
        assert all(k != r or k in set(got.values()) for k, r in got.items())


def test_forest_and_balls_join_what_pairs_join(spark):
    import pyarrow as pa

    x = crowded(14)
    want = classes(x)
    for links in (simhash.forest(pa.table({"key": [7] * len(x), "fp": x, "root": x})).to_pylist(), [r.asDict() for r in simhash.ball_links(spark.createDataFrame([(v, v) for v in x.tolist()], "fp long, root long")).collect()]):
        at = {int(v): i for i, v in enumerate(x)}
        root = list(range(len(x)))
        for _ in range(len(x)):
            for r in links:
                a, b = at[r["a"]], at[r["b"]]
                root[a] = root[b] = min(root[a], root[b])
        assert root == want
    assert simhash.forest(pa.table({"key": [1, 2], "fp": x[:2], "root": x[:2]})).num_rows == 0
    assert len(simhash.forest(pa.table({"key": [7] * len(x), "fp": x, "root": x})).to_pylist()) == len(x) - len(set(want))


def test_left_texts_against_all_their_pairs(spark):
    rng = np.random.default_rng(15)
    rows, common = [], list(range(10**6, 10**6 + 25))
    for cluster in range(12):
        fp = int(x) if (x := rng.integers(0, 4)) else 0
        base = rng.integers(0, 10**5, 60)
        for _ in range(6):
            s = base.copy()
            s[rng.choice(60, int(rng.integers(0, 12)), replace=False)] = rng.integers(0, 10**5)
            rows.append((len(rows), 0, fp ^ (int(rng.integers(0, 2)) * 56), cluster % 2, sorted({*s.tolist(), *common})))
    rows += [(len(rows) + i, 0, 9, 5, []) for i in range(3)]
    order = rng.permutation(len(rows)).tolist()
    texts = [(*r[:4], (None if k % 7 == 0 else k,), r[4]) for k, r in zip(order, rows, strict=True)]
    key = [(r[4][0] is None, r[4][0] or 0, r[0]) for r in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            a, b = set(x[5]), set(y[5])
            if x[3] == y[3] and (x[2] ^ y[2]).bit_count() <= 3 and (not a | b or len(a & b) >= 0.8 * len(a | b)):
                p, q = sorted((find(i), find(j)), key=lambda k: key[k])
                root[q] = p
    df = spark.createDataFrame([(*t[:4], (t[4][0] is None, t[4][0]), t[5]) for t in texts], "t1 long, t2 long, fp long, root long, least struct<n:boolean,doc_id:long>, s array<long>")
    got = sorted(r.t1 for r in simhash.least_of_linked(df, 0.8).collect())
    assert got == sorted(texts[i][0] for i in range(len(texts)) if find(i) == i) and 12 < len(got) < len(texts) - 10
