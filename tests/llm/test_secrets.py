import hashlib
import re
import time
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import secrets
from threadloom.llm.chain import INSIDE, Chain

# The patterns as they are stated, without the shortcuts of the operator.
PLAIN = (
    (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute_force(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PLAIN) for m in p.finditer(text) if len(m[g]) >= n)


PARTS = ["password", "Api_KEY", "ſecret", "tok", "token", "AKIA", "AKIAAKIA", "0a" * 12, "f" * 23, "'", '"', ":", "=", " ", "ab12_/", "é", "Z9" * 8, "\n"]


@given(st.lists(st.sampled_from(PARTS), max_size=14))
@settings(max_examples=400, deadline=None)
def test_base_spans_against_stated_patterns(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == brute_force(text)
    kept = [s for s in secrets.spans([text], secrets.trained())[0] if s[1] != 3]
    assert kept == brute_force(text)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 3):
        chain = Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)))
        scores = rng.normal(size=(n, 3))

        def value(tags):
            if tags[0] == INSIDE or any(a == 0 and b == 2 for a, b in zip(tags, tags[1:])):
                return -np.inf
            return sum(scores[i, t] for i, t in enumerate(tags)) + sum(chain.pair[a, b] for a, b in zip(tags, tags[1:]))

        assert chain.best(scores) == list(max(product(range(3), repeat=n), key=value))


def test_runs_of_many_sequences_are_decoded_as_the_whole():
    rng = np.random.default_rng(6)
    for _ in range(300):
        chain = Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)) * rng.choice([0.1, 1]))
        sizes = rng.integers(1, 9, 5)
        scores = rng.normal(size=(sizes.sum(), 3)) * 3 + [rng.normal(2, 2), 0, 0]
        starts = np.cumsum(sizes) - sizes
        assert chain.decode(scores, starts).tolist() == [t for a, n in zip(starts, sizes) for t in chain.best(scores[a : a + n])]
    chain = Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(1000, 3))
    assert chain.decode(scores, np.array([0, 10])).tolist() == chain.best(scores[:10]) + chain.best(scores[10:])


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(5)
    chain = Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)))
    scores, tags, sizes = rng.normal(size=(4, 2, 3)), np.array([[1, 0], [2, 1], [0, 2], [0, 2]]), np.array([3, 4])
    value, one, two = chain.gradient(scores, tags, sizes)

    def likelihood(pair, scores):
        out = 0.0
        for k, n in enumerate(sizes):
            ways = [x for x in product(range(3), repeat=int(n)) if x[0] != INSIDE and not any(a == 0 and b == 2 for a, b in zip(x, x[1:]))]
            of = [sum(scores[i, k, t] for i, t in enumerate(x)) + sum(pair[a, b] for a, b in zip(x, x[1:])) for x in ways]
            true = tuple(tags[:n, k])
            out += of[ways.index(true)] - np.log(np.exp(of).sum())
        return out

    assert abs(value - likelihood(chain.pair, scores)) < 1e-9
    for at in product(range(4), range(2), range(3)):
        moved = scores.copy()
        moved[at] += 1e-6
        assert abs((likelihood(chain.pair, moved) - value) / 1e-6 + one[at]) < 1e-4
    for at in product(range(3), range(3)):
        moved = chain.pair.copy()
        moved[at] += 1e-6
        assert at == (0, 2) or abs((likelihood(moved, scores) - value) / 1e-6 + two[at]) < 1e-4


def test_held_out_examples():
    right = wrong = missed = 0
    made = secrets.examples(300, seed=99)
    for (_, marked), found in zip(made, secrets.model_spans([text for text, _ in made], secrets.trained())):
        got = set(found)
        right, wrong, missed = right + len(got & set(marked)), wrong + len(got - set(marked)), missed + len(set(marked) - got)
    assert wrong <= 0.02 * right and missed <= 0.04 * right


def test_scan_and_redaction(spark):
    key = "ghp_" + "aB3" * 12
    rows = [(1, f"é the key is {key} ok and password: hunter22.", "x", 5), (2, None, "x", None), (None, "", "x", 0), (1, "plain words only", "x", 16), (3, "w" * 500_000 + " " + "0f" * 20, "x", 500_041)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_chars long")
    got = {(r.doc_id, r.spans): r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert len(got) == 5
    first = next(r for r in got.values() if r.n_assign)
    assert first.spans == f"model:13:{13 + len(key)},assign:61:80" and first.n_model == 1
    assert first.base_sha256 == hashlib.sha256(b"assign:61:80").hexdigest()
    assert {r.base_sha256 for r in got.values() if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    clean = {(r.doc_id, r.n_chars): r.text for r in secrets.redacted(docs).collect()}
    text = "é the key is [model removed] ok and [assign removed]"
    assert clean[(1, len(text))] == text and clean[(1, 16)] == "plain words only" and clean[(2, None)] is None
    assert secrets.redacted(docs).schema == docs.schema and secrets.scan(docs.filter("false")).count() == 0


def plain_tokens(text):
    """Tokens as they are stated: pieces between blanks and quotes, cut at signs of assignment, less their ends."""
    out = []
    for piece in re.finditer(r"""[^\s"'`<>(),;]+""", text):
        p = piece[0]
        cuts = [-1, len(p)]
        if (p[0].isalpha() or p[0] in "_[-") and "://" not in p:
            cuts += [i for i, c in enumerate(p) if c == "=" or c == ":" and p[i + 1 : i + 2] != "/"]
        cuts.sort()
        for a, b in zip(cuts, cuts[1:]):
            end = len(p[a + 1 : b].rstrip(secrets.ENDING))
            if end:
                out.append((piece.start() + a + 1, piece.start() + a + 1 + end))
    return out


def test_tokens_and_scores_do_not_depend_on_how_texts_are_read(monkeypatch):
    chain = secrets.trained()
    odd = ["", "...", " x", 'a=b: x\n\n key=ABCD-12345. "q" ... ,, end', "order = AIzaHIWzZ = x", "plain words only", "é=ß:ü \U0001f600x \ud800 http://a=b:c a://b", "x" * 300 + " =:= a:=b"]
    texts = odd + [t for t, _ in secrets.examples(60, seed=5)] + odd
    whole, scores = secrets.scored(texts, chain)
    for k, text in enumerate(texts):
        own = whole.text == k
        assert list(zip(whole.begin[own].tolist(), whole.end[own].tolist())) == plain_tokens(text)
        one, rows = secrets.features([text])
        assert np.allclose(scores[own], chain.unary[rows].sum(axis=1)) and np.allclose(scores[own], secrets.scored([text], chain)[1])
    monkeypatch.setattr(secrets, "AT_ONCE", 40)
    secrets.powers.cache_clear()
    assert len(list(secrets.parts_of(texts))) > 50 and np.allclose(secrets.scored(texts, chain)[1], scores)
    secrets.powers.cache_clear()


def test_the_chain_decides():
    """More spans are wrong or missed without the weights of pairs, many more without those of inside."""
    chain, made = secrets.trained(), secrets.examples(600, seed=31)

    def errors(c):
        return sum(len(set(m) ^ set(x)) for (_, m), x in zip(made, secrets.model_spans([t for t, _ in made], c)))

    cut = Chain(chain.unary.copy(), chain.pair)
    cut.unary[:, INSIDE] = 0
    assert np.abs(chain.pair).max() > 0.1 and np.abs(chain.unary[:, INSIDE]).max() > 0.1
    assert errors(chain) < errors(Chain(chain.unary, np.zeros((3, 3)))) and 3 * errors(chain) < errors(cut)


def test_named_cases():
    chain = secrets.trained()
    for text, value in (("set db_pass: correcthorsebatterystaple\n", "correcthorsebatterystaple"), ("Authorization: Bearer abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz")):
        assert [text[a:b] for a, b in secrets.model_spans([text], chain)[0]] == [value]
    for text in ("the password is required for all", "see https://www.a.com/foo?page=3 on 2024-05-06", "my card 4111111111111111 and mail ab.cd@ef.com", ""):
        assert secrets.model_spans([text], chain) == [[]]


def test_secrets_of_several_tokens():
    chain = secrets.trained()
    two = "Zk3mQ9xT7bLp2WvR aB8dKe5fGh1jMn4q"
    text = f"the access_key = {two}\nand words after it"
    assert secrets.model_spans([text], chain) == [[(17, 17 + len(two))]]
    rng = np.random.default_rng(7)
    lines = "\n".join("".join(rng.choice(list("ABCDEFGHabcdefgh0123456789+/"), 64)) for _ in range(5)) + "\nab12Cd"
    text = f"see\n-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----\nmore text"
    start = text.index(lines)
    assert any(s <= start and start + len(lines) - 7 <= e for s, e in secrets.model_spans([text], chain)[0])


def test_spans_that_reach_beyond_base_spans():
    for text, left in (("password=Summer2024!Blue#9x and the rest", " and the rest"), ("the access_key = x9Zk-" + "0a" * 12 + "-Qw7Lp2 ok", " ok")):
        found = secrets.spans([text], secrets.trained())[0]
        assert secrets.redacted_text(text, found).endswith("removed]" + left)
    inside = 'token = "0123456789abcdef0123456789abcdef"'
    assert all(k != 3 for _, k, _ in secrets.spans([inside], secrets.trained())[0])


def test_long_texts_of_any_kind():
    chain = secrets.trained()
    for text in ("!" * 300_000, "0a" * 12 + "\n" * 200_000, ("f" * 24 + "\n") * 20_000, "password=Ab1x" * 20_000, "aB3xK9mQ2 " * 30_000):
        started = time.time()
        assert secrets.redacted_text(text, secrets.spans([text], chain)[0]) is not None
        assert time.time() - started < 10
