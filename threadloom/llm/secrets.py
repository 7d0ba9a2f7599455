"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds what these don't name."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import BEGIN, INSIDE, OUTSIDE, Chain
from .common import prepare

KINDS = ("assign", "access", "hex", "model")
# The base patterns. Runs of one set of characters match whole, so least lengths can stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, in the order of start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(n in lower for n in ASSIGN_NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# --- what the chain reads --------------------------------------------------------------------------------------------

#: What lies between pieces: blanks and quotes. All else is tagged.
BETWEEN = re.compile(r"""[\s"'`<>(),;]+""")
#: What ends a token without being part of it.
ENDING = ".,;:!?=*$%&#|"
NO_TOKEN = ENDING + "".join(c for c in map(chr, range(1 << 14)) if BETWEEN.match(c))
#: Tokens before one that are looked at for words that announce a credential.
NEAR = 5
# Words that announce a credential, in code, settings and prose.
CUES = frozenset("password passwd passphrase pwd pass secret secrets token tokens key keys apikey auth authorization bearer basic credential credentials private access clientsecret accesskey secretkey privatekey accesstoken authtoken sessionkey session cookie jwt signature sig sas pat pin otp login".split())
#: Beginnings of known credentials' formats.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xox", "sk_live_", "sk_test_", "sk-", "pk_live_", "AIza", "ya29.", "eyJ", "SG.", "hf_", "npm_", "pypi-", "dop_v1_", "ASIA", "AKIA", "MII", "ssh-rsa", "AAAA")
FORMS = (re.compile(r"[0-9.,:/+()-]+"), re.compile(r".*://.*|www\..*", re.S), re.compile(r"[^@]+@[^@]+\.[^@]+"), re.compile(r"[^/]*(/[A-Za-z._-]{2,}[^/]{0,4}){2,}/?"), re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*"), re.compile(r"[A-Za-z]*[a-z]{7}[A-Za-z0-9_.-]*|[a-z]{3,}[A-Z][a-z]{2,}[A-Za-z]*"))
#: Characters that are read at a time.
AT_ONCE = 1 << 20
BETWEEN_KIND, LOWER, UPPER, DIGIT, MARK = range(5)
GAPS = ("start", "space", "line", "assign", "quote", "other")
#: Lengths and shares of the digits at which another value of a feature begins.
SIZES = np.array([2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 128])
#: Buckets of hashed neighbouring words.
WORDS = 1 << 14
#: Bits that the features of a token take in its code, from the lowest: kinds of characters that are there, length,
#: digits, changes of kind, first and last kind, different characters, prefix, form, distance of a cue, gap.
FIELDS = {"kinds": 4, "size": 5, "digits": 3, "changes": 4, "first": 3, "last": 3, "chars": 4, "prefix": 5, "form": 3, "cue": 3, "gap": 3}
AT = dict(zip(FIELDS, np.cumsum([0, *FIELDS.values()]).tolist(), strict=False))
#: Features of a token by itself: each a tuple of fields whose values count together.
OWN = (("kinds",), ("size",), ("digits",), ("changes",), ("first", "last"), ("chars",), ("prefix",), ("form",), ("cue",), ("gap",), ("kinds", "size"), ("kinds", "changes"), ("kinds", "chars"), ("size", "chars"), ("cue", "kinds"), ("cue", "size"), ("cue", "chars"), ("cue", "gap"), ("kinds", "size", "gap"))
WIDTHS = [1 << sum(FIELDS[f] for f in names) for names in OWN]
#: Where the weights of own features, of neighbours' kinds and lengths, of their words and of files begin.
OWN_AT = np.cumsum([1, *WIDTHS]).tolist()
SIDES = OWN_AT[-1]
SIDE_CODES = 1 << (FIELDS["kinds"] + FIELDS["size"])
WORDS_AT = SIDES + 2 * (SIDE_CODES + 1)
FILES_AT = WORDS_AT + 2 * WORDS
FEATURES = FILES_AT + 8


@lru_cache(maxsize=1)
def kinds_of_characters() -> np.ndarray:
    """The kind of each character of the basic plane."""
    out = np.empty(1 << 16, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = BETWEEN_KIND if BETWEEN.match(c) else UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else MARK
    return out


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, by which runs of characters are hashed."""
    base, size = 0x9E3779B97F4A7C15, 2 * AT_ONCE
    out = np.full((2, size), 1, np.uint64)
    for row, b in enumerate((base, pow(base, -1, 1 << 64))):
        out[row, 1:] = b
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out[row], out=out[row])
    return out[0], out[1]


def hashed(words: list[str]) -> np.ndarray:
    """Hashes of words as `runs` has them."""
    out = [sum(ord(c) * int(p) for c, p in zip(w, powers()[0], strict=False)) % (1 << 64) for w in words]
    return np.sort(np.array(out, np.uint64))


@lru_cache(maxsize=1)
def cue_hashes() -> np.ndarray:
    return hashed(list(CUES))


@dataclass
class Tokens:
    """Tokens of texts in a row: text, place in it, code of the own features, code for the neighbours, hashed word."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    code: np.ndarray
    word: np.ndarray
    cue: np.ndarray


def before(mask: np.ndarray) -> np.ndarray:
    """How many are true before each place."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def read_part(parts: list[tuple[int, int, str]]) -> Tokens:
    """Tokens of parts (text, place of the part in it, characters); a part that goes on in a text begins between pieces."""
    whole = "\n".join(x for _, _, x in parts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = kinds_of_characters()[np.minimum(codes, 0xFFFF)]
    size = np.array([len(x) + 1 for _, _, x in parts])
    part_at = np.cumsum(size) - size
    out_of = kinds == BETWEEN_KIND
    # Pieces are cut at `=`, and at `:` but in front of `/`, where they begin like a name and are no addresses.
    signs = np.nonzero((codes == ord("=")) | (codes == ord(":")))[0]
    if len(signs):
        starts = np.nonzero(~out_of & np.append(True, out_of[:-1]))[0]
        following = np.append(codes, [0, 0])
        slash = following[signs + 1] == ord("/")
        own = np.searchsorted(starts, signs, "right") - 1
        address = np.zeros(len(starts), bool)
        address[own[(codes[signs] == ord(":")) & slash & (following[signs + 2] == ord("/"))]] = True
        head = codes[starts[own]]
        name = (kinds[starts[own]] == LOWER) | (kinds[starts[own]] == UPPER) | (head == ord("_")) | (head == ord("[")) | (head == ord("-"))
        out_of[signs[name & ~address[own] & ((codes[signs] == ord("=")) | ~slash)]] = True
    edges = np.diff(np.concatenate([[True], out_of, [True]]).astype(np.int8))
    begin, end = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    ending = np.zeros(128, bool)
    ending[[ord(c) for c in ENDING]] = True
    ends = ending[np.minimum(codes, 127)] & (codes < 127)
    last = np.maximum.accumulate(np.where(ends, -1, np.arange(len(codes), dtype=np.int32)), dtype=np.int32) if len(codes) else np.zeros(0, np.int32)
    end = last[end - 1] + 1
    keep = end > begin
    begin, end = begin[keep], end[keep].astype(np.int64)
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return Tokens(empty, empty, empty, empty, empty, empty.astype(bool))
    n = end - begin
    count = {}
    for k in (LOWER, UPPER, DIGIT):
        c = before(kinds == k)
        count[k] = c[end] - c[begin]
    count[MARK] = n - count[LOWER] - count[UPPER] - count[DIGIT]
    changed = before(np.append(kinds[1:] != kinds[:-1], False))
    there = sum((count[k] > 0).astype(np.int64) << (k - 1) for k in (LOWER, UPPER, DIGIT, MARK))
    length = np.searchsorted(SIZES, n, "right")
    digits = 5 * count[DIGIT] // n
    changes = 8 * (changed[end - 1] - changed[begin]) // np.maximum(n - 1, 1)
    # What takes more to tell is told of tokens that aren't plain words or numbers.
    plain = (there == 1) | (there == 3) & (count[UPPER] == 1) | (there == 4) | (there == 2)
    chars, prefix, form = (np.zeros(len(n), np.int64) for _ in range(3))
    for k in np.nonzero((n >= 6) & (~plain | (n >= 14)))[0].tolist():
        w = whole[begin[k] : end[k]]
        chars[k] = 1 + min(12, int(12 * len(set(w)) / min(len(w), 40)))
        if w.startswith(PREFIXES):
            prefix[k] = 1 + next(i for i, x in enumerate(PREFIXES) if w.startswith(x))
        form[k] = next((i for i, x in enumerate(FORMS, 1) if x.fullmatch(w)), 0)
    # Hashes of words and of the runs of letters in them, ASCII letters in lower case.
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
    power, inverse = powers() if len(codes) <= 2 * AT_ONCE else long_powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(low * power[: len(codes)], out=sums[1:])
        word = (sums[end] - sums[begin]) * inverse[begin]
    letters = np.diff(np.concatenate([[False], (kinds == LOWER) | (kinds == UPPER), [False]]).astype(np.int8))
    run, stop = np.nonzero(letters == 1)[0], np.nonzero(letters == -1)[0]
    near = (stop - run >= 3) & (stop - run <= max(map(len, CUES)))
    run, stop = run[near], stop[near]
    with np.errstate(over="ignore"):
        h = (sums[stop] - sums[run]) * inverse[run]
    known = cue_hashes()
    found = np.zeros(len(codes) + 1, bool)
    found[run[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]] = True
    found = before(found)
    cue = found[end] > found[begin]
    # What stands between a token and the one before it in the same part.
    part = np.searchsorted(part_at, begin, "right") - 1
    first = np.append(True, part[1:] != part[:-1])
    gap_from = np.where(first, part_at[part], np.append(0, end[:-1]))
    between = []
    for mask in (codes == ord("\n"), (codes == ord("=")) | (codes == ord(":")), (codes == ord('"')) | (codes == ord("'")) | (codes == ord("`")), ~out_of | (codes == ord("("))):
        c = before(mask)
        between.append(c[begin] > c[gap_from])
    line, assign, quote, other = between
    offset = np.array([x for _, x, _ in parts])[part]
    gap = np.select([first & (offset == 0), line, assign, quote, other], [0, 2, 3, 4, 5], 1)
    values = {"kinds": there, "size": length, "digits": digits, "changes": changes, "first": kinds[begin], "last": kinds[end - 1], "chars": chars, "prefix": prefix, "form": form, "gap": gap}
    code = sum(v.astype(np.int64) << AT[f] for f, v in values.items())
    text = np.array([x for x, _, _ in parts])[part]
    shift = offset - part_at[part]
    return Tokens(text, begin + shift, end + shift, code, (word >> np.uint64(40)).astype(np.int64) % WORDS, cue)


def long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `powers`, for a part with a token longer than the parts are."""
    out = np.full((2, n), 1, np.uint64)
    with np.errstate(over="ignore"):
        for row, b in enumerate((powers()[0][1], powers()[1][1])):
            out[row, 1:] = b
            np.multiply.accumulate(out[row], out=out[row])
    return out[0], out[1]


def parts_of(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """The texts in lists of about AT_ONCE characters; longer texts are cut behind tokens."""
    out, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end, reach = at, at + AT_ONCE
            # Behind a token, so that all that stands between it and the next one is read with the next.
            while end == at:
                cut = BETWEEN.search(text, reach) if reach < len(text) else None
                end = at + len(text[at : cut.start()].rstrip(NO_TOKEN)) if cut else len(text)
                reach = cut.end() + AT_ONCE if cut else reach
            out.append((k, at, text[at:end]))
            size += end - at
            at = end
            if size >= AT_ONCE:
                yield out
                out, size = [], 0
    if out:
        yield out


def read(texts: list[str]) -> Tokens:
    """Tokens of all texts. What a token has by those before it in its text is told here."""
    found = [read_part(p) for p in parts_of(texts)]
    if not found:
        return read_part([(0, 0, "")])
    t = Tokens(*(np.concatenate([getattr(f, x) for f in found]) for x in ("text", "begin", "end", "code", "word", "cue")))
    distance = np.zeros(len(t.text), np.int64)
    for k in range(min(NEAR, len(t.text) - 1), 0, -1):
        distance[k:][t.cue[:-k] & (t.text[k:] == t.text[:-k])] = k
    t.code += distance << AT["cue"]
    return t


def of_files(texts: list[str]) -> np.ndarray:
    """Two features of each text: its share of signs that code has, and of line breaks."""
    out = np.empty((len(texts), 2), np.int64)
    for k, text in enumerate(texts):
        n = len(text) + 1
        out[k] = min(3, int(200 * sum(map(text.count, "{};=")) / n)), 4 + min(3, int(100 * text.count("\n") / n))
    return FILES_AT + out


def own_features(code: np.ndarray) -> np.ndarray:
    """Places of the weights of each code's own features."""
    out = np.zeros((len(code), len(OWN) + 1), np.int64)
    for k, names in enumerate(OWN):
        value = np.zeros(len(code), np.int64)
        for f in names:
            value = value << FIELDS[f] | code >> AT[f] & ((1 << FIELDS[f]) - 1)
        out[:, k + 1] = OWN_AT[k] + value
    return out


def beside_features(t: Tokens) -> np.ndarray:
    """Places of the weights that a token has by the one before and the one after it in its text: kind and length, word."""
    n = len(t.text)
    side, out = t.code & (SIDE_CODES - 1), np.empty((n, 4), np.int64)
    same = t.text[1:] == t.text[:-1]
    for k, (own, other) in enumerate(((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
        at = SIDES + k * (SIDE_CODES + 1)
        out[:, 2 * k] = out[:, 2 * k + 1] = at + SIDE_CODES
        out[own, 2 * k] = np.where(same, at + side[other], at + SIDE_CODES)
        out[own, 2 * k + 1] = np.where(same, WORDS_AT + k * WORDS + t.word[other], at + SIDE_CODES)
    return out


def features(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """All tokens of texts and the places of their features' weights."""
    t = read(texts)
    return t, np.concatenate([own_features(t.code), beside_features(t), of_files(texts)[t.text]], axis=1)


def scored(texts: list[str], chain: Chain) -> tuple[Tokens, np.ndarray]:
    """All tokens of texts and the score of each tag: the sums of the weights of `features`, each code's found once."""
    t = read(texts)
    codes, at = np.unique(t.code, return_inverse=True)
    out = chain.unary[own_features(codes)].sum(axis=1)[at]
    for column in beside_features(t).T:
        out += chain.unary[column]
    return t, out + chain.unary[of_files(texts)].sum(axis=1)[t.text]


def model_spans(texts: list[str], chain: Chain) -> list[list[tuple[int, int]]]:
    """Spans that the chain tags in each text: from a begin over its insides. All tokens of a text are one sequence."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    t, scores = scored(texts, chain)
    tags = chain.decode(scores, np.nonzero(np.append(True, t.text[1:] != t.text[:-1]))[0])
    at = np.nonzero(tags)[0]
    for text, begin, end, tag in zip(t.text[at].tolist(), t.begin[at].tolist(), t.end[at].tolist(), tags[at].tolist(), strict=True):
        if tag == BEGIN:
            out[text].append((begin, end))
        else:
            out[text][-1] = (out[text][-1][0], end)
    return out


def spans(texts: list[str | None], chain: Chain) -> list[list[Span]]:
    """Of each text its base spans, and those of the chain that don't lie wholly inside them, by start and kind."""
    out = []
    for text, added in zip(texts, model_spans([t or "" for t in texts], chain), strict=True):
        base = base_spans(text or "")
        starts, ends = [], []
        for s, _, e in base:
            if ends and s <= ends[-1]:
                ends[-1] = max(e, ends[-1])
            else:
                starts.append(s), ends.append(e)
        for s, e in added:
            k = bisect_right(starts, s) - 1
            if k < 0 or e > ends[k]:
                base.append((s, 3, e))
        out.append(sorted(base))
    return out


# --- what it is trained on -------------------------------------------------------------------------------------------


def examples(n: int = 1200, seed: int = 17) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made texts with the places of the secrets in them, next to what only looks like one."""
    rng = Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(chars: str, low: int, high: int) -> str:
        return "".join(rng.choices(chars, k=rng.randint(low, high)))

    def pick(*options: str) -> str:
        return options[rng.randrange(0, len(options))]

    names = ("access_key", "client_secret", "auth", "private_key", "credentials", "SESSION_KEY", "Authorization", "db_pass", "pwd", "key", "signature", "passphrase", "authToken")
    common = "able back call down every find great hand into just know large make never open part quick right small time under very water year horse battery staple correct river summer winter garden".split()
    neutral = ("version", "id", "file", "date", "order", "call", "see", "page", "host", "name", "number", "ref")
    letters = "eeaaiinnorrsstlhducmpgbvfyéüñ"

    def word() -> str:
        w, r = draw(letters, 1, 10) if rng.random() < 0.85 else draw(letters, 10, 20), rng.random()
        return w.capitalize() if r < 0.12 else w.upper() if r < 0.14 else w + draw("0123456789", 1, 3) if r < 0.17 else draw("0123456789", 1, 5) if r < 0.2 else w + "-" + draw(letters, 2, 6) if r < 0.22 else pick(*names, *neutral, "the", "pass", "keys") if r < 0.27 else w

    def prose() -> str:
        return " ".join(word() + ("," if rng.random() < 0.06 else "." if rng.random() < 0.05 else "") for _ in range(rng.randrange(2, 16)))

    secret = [
        lambda: pick("ghp_", "gho_", "ghs_") + draw(alnum, 36, 36), lambda: "glpat-" + draw(alnum + "-_", 20, 20), lambda: "xoxb-" + draw("0123456789", 11, 12) + "-" + draw(alnum, 24, 24),
        lambda: pick("sk_live_", "sk_test_", "sk-") + draw(alnum, 24, 48), lambda: "AIza" + draw(alnum + "-_", 35, 35), lambda: "eyJ" + draw(alnum, 17, 40) + ".eyJ" + draw(alnum, 30, 60) + "." + draw(alnum + "-_", 30, 43),
        lambda: "hf_" + draw(alnum, 34, 34), lambda: "ASIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: draw(alnum + "+/", 40, 40), lambda: draw(alnum, 20, 32), lambda: draw(alnum + "!@#%^&*", 10, 16) + draw("0123456789", 2, 2), lambda: draw("0123456789abcdef", 32, 64),
    ]
    plain = [
        lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}:{rng.randrange(10, 60)}:00Z", lambda: f"https://www.{draw('abcdefgh', 4, 9)}.com/{draw('abcdefgh', 3, 8)}/{rng.randrange(1, 99999)}?page={rng.randrange(1, 9)}",
        lambda: f"+{rng.randrange(1, 99)}-{rng.randrange(100, 999)}-{rng.randrange(1000000, 9999999)}", lambda: f"{draw('abcdefgh', 4, 9)}{rng.randrange(1, 999)}@{draw('abcdefgh', 4, 9)}.com", lambda: draw("0123456789", 8, 16),
        lambda: f"{rng.randrange(10, 255)}.{rng.randrange(10, 255)}.{rng.randrange(10, 255)}.{rng.randrange(10, 255)}:8080", lambda: f"src/{draw('abcdefgh', 4, 9)}/{draw('abcdefgh', 4, 9)}_v{rng.randrange(1, 30)}.py", lambda: f"{draw('abcdefgh', 4, 8)}-{draw('abcdefgh', 4, 8)}-v{rng.randrange(1, 9)}.{rng.randrange(1, 30)}.{rng.randrange(1, 9)}",
        lambda: draw("abcdefgh", 3, 7) + draw("ABCDEFGH", 1, 1) + draw("abcdefgh", 3, 7) + draw("ABCDEFGH", 1, 1) + draw("abcdefgh", 2, 6), lambda: f"{draw('0123456789', 4, 4)}-{draw('0123456789', 4, 4)}-{draw('0123456789', 4, 4)}-{draw('0123456789', 4, 4)}", lambda: f"${rng.randrange(1, 999)},{rng.randrange(100, 999)}.{rng.randrange(10, 99)}", lambda: f"{draw('aeinorstlh', 5, 12)}{rng.randrange(1, 999)}", lambda: f"({rng.randrange(100, 999)})555-{rng.randrange(1000, 9999)}", lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f"DE{rng.randrange(10, 99)}{draw('0123456789', 18, 18)}",
    ]
    several = [
        lambda: " ".join(draw(alnum, 14, 28) for _ in range(2)), lambda: " ".join(draw("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", 5, 5) for _ in range(rng.randrange(3, 7))),
        lambda: " ".join(draw(alnum, 8, 8) for _ in range(rng.randrange(2, 6))), lambda: " ".join(draw("0123456789abcdef", 8, 8) for _ in range(rng.randrange(4, 9))),
    ]

    def passphrase() -> str:
        return "".join(rng.choices(common, k=rng.randrange(3, 6))) if rng.random() < 0.5 else draw("abcdefghijklmnopqrstuvwxyz", 18, 32)

    def block() -> tuple[str, str, str]:
        kind = pick("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
        lines = [draw(alnum + "+/", 64, 64) for _ in range(rng.randrange(1, 8))] + [draw(alnum + "+/", 20, 63) + draw(alnum, 1, 1)]
        return f"-----BEGIN {kind}-----\n", "\n".join(lines), f"\n-----END {kind}-----"

    out = []
    for i in range(n):
        text, places = prose() if rng.random() < 0.5 else "", []
        for j in range(rng.randrange(1, 4)):
            marked = (i + j) % 2 == 0
            kind = rng.random()
            if marked and kind < 0.12:
                head, value, end = block()
                lead, tail = f"{prose()}\n{head}", end + "\n"
            else:
                wordy = kind > (0.88 if marked else 0.8)
                value = passphrase() if marked and wordy else common[rng.randrange(0, len(common))] if wordy else several[rng.randrange(0, len(several))]() if marked and kind < 0.35 else secret[rng.randrange(0, len(secret))]() if marked else plain[rng.randrange(0, len(plain))]()
                known = value.startswith(PREFIXES)
                name = pick(*names) if marked and not known else pick(*(names if rng.random() < (0.5 if known else 0.15) + 0.5 * wordy else neutral))
                form = rng.randrange(0, 8)
                lead = [
                    f"{prose()} {name} = ", f'{prose()}\n"{name}": "', f"{prose()} {name}: ", f"{prose()}\nexport {name.upper()}=", f"{prose()} the {name} is ",
                    f"{prose()}\n{name}=", f"{prose()} --{name} ", f"{prose()}\nAuthorization: Bearer " if marked else f"{prose()} Basic {name} ",
                ][form]
                if marked and wordy and form == 4:
                    lead = f"{prose()} {name}: "
                tail = ('"' if form == 1 else "") + pick("\n", ". ", ", ", " ")
            if text and not text[-1].isspace():
                text += pick(" ", "\n", ". ")
            if marked:
                places.append((len(text + lead), len(text + lead + value)))
            text += lead + value + tail
        out.append((text + (prose() if rng.random() < 0.8 else ""), places))
    return out


def fit(texts: list[tuple[str, list[tuple[int, int]]]], epochs: int = 8, step: float = 0.3, shrink: float = 1e-5, together: int = 24) -> Chain:
    """Stochastic gradient ascent on the likelihood of the tags, some sequences a step; steps adapt to each weight."""
    t, rows = features([text for text, _ in texts])
    tags = np.full(len(t.text), OUTSIDE)
    last = None
    for i, (k, start, end) in enumerate(zip(t.text.tolist(), t.begin.tolist(), t.end.tolist(), strict=True)):
        own = next(((k, m) for m in texts[k][1] if m[0] < end and start < m[1]), None)
        if own is not None:
            tags[i] = INSIDE if own == last else BEGIN
        last = own
    starts = np.nonzero(np.append(True, t.text[1:] != t.text[:-1]))[0]
    size = np.diff(np.append(starts, len(t.text)))
    # Sequences of like length step side by side.
    by_size = np.argsort(size, kind="stable")
    groups = [by_size[i : i + together] for i in range(0, len(by_size), together)]
    chain = Chain(np.zeros((FEATURES, 3)), np.zeros((3, 3)))
    square, square_pair = np.full_like(chain.unary, 1e-2), np.full((3, 3), 1e-2)
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(groups)):
            begin, n = starts[groups[i]], size[groups[i]]
            at = np.minimum(begin + np.arange(n.max())[:, None], len(t.text) - 1)
            there = np.arange(n.max())[:, None] < n
            _, one, two = chain.gradient(chain.unary[rows[at]].sum(axis=2), tags[at], n)
            used, place = np.unique(rows[at[there]], return_inverse=True)
            errors = np.repeat(one[there], rows.shape[1], axis=0)
            g = shrink * chain.unary[used] + np.stack([np.bincount(place.reshape(-1), errors[:, k], len(used)) for k in range(3)], axis=1)
            square[used] += g * g
            chain.unary[used] -= step * g / np.sqrt(square[used])
            square_pair += two * two
            chain.pair -= step * two / np.sqrt(square_pair)
    return chain


@lru_cache(maxsize=1)
def trained() -> Chain:
    return fit(examples())


# --- tables ----------------------------------------------------------------------------------------------------------


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(doc_id, found) of every row of `docs` (doc_id, text); found: array of (kind, start, end), by start, then kind.

    Whole texts are scanned; places are code points, the end excluded. Null and empty texts have no spans. Repeated
    rows stay, an empty table gives an empty result; other columns are not read.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans(b.column(1).to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted_text(text: str, found: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by a mark of its kind."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]} removed]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, chain: Chain | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, with secrets replaced in `text`; `length`, if there, is set anew for changed texts."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(chain or trained())

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        found = spans([t or "" for t in texts], shared.value)
        return pd.Series([redacted_text(t, x) if x else t for t, x in zip(texts, found, strict=True)], dtype=object)

    out = docs.withColumn("__clean", clean(F.col(text).cast("string")))
    if length in docs.columns:
        changed = ~F.col("__clean").eqNullSafe(F.col(text))
        out = out.withColumn(length, F.when(changed, F.length("__clean")).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.withColumn(text, F.col("__clean")).select(*docs.columns)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans and all spans as a string, of every row of a scan."""
    words = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] != "model")
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(words(base), 256).alias("base_sha256"), words(F.col("found")).alias("spans"), count("model"))
