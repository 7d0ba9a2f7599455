"""Full-text search: an inverted index as tables, a small query language, and BM25 ranks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import durable
from .corpus import Corpus, Scope, by_origin, message_predicate, sessions_in

# The rank's parameters and its least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


LEXER = re.compile(r"""\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[^\W]+|[^\x00-\x7f]+)|(?P<mark>[()*^:,+]))""", re.U)


def terms_of(text: str) -> tuple[str, ...]:
    """Terms of a query's string, by the same rules as those of texts."""
    source, plain = X._accents()
    return tuple(t for t in re.split(r"[\W_]+", text.lower().translate(str.maketrans(source, plain))) if t)


@dataclass
class Parser:
    """OR binds least, then AND (also unwritten), then NOT; strings are phrases, * makes a prefix, ^ a beginning."""

    query: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def parse(self):
        pos = 0
        while self.query[pos:].strip():
            m = LEXER.match(self.query, pos)
            if not m:
                raise QueryError(f"syntax error near {self.query[pos:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()
        if not self.tokens:
            raise QueryError("empty query")
        out = self.either()
        if self.at < len(self.tokens):
            raise QueryError(f"syntax error near {self.tokens[self.at][1]!r}")
        return out

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str) -> bool:
        if self.peek() in (("word", value), ("mark", value)):
            self.at += 1
            return True
        return False

    def either(self):
        out = self.both()
        while self.take("OR"):
            out = Op("or", out, self.both())
        return out

    def both(self):
        out = self.without()
        while True:
            if self.take("AND"):
                out = Op("and", out, self.without())
            elif self.peek()[0] != "end" and self.peek() not in (("word", "OR"), ("word", "NOT"), ("mark", ")")):
                out = Op("and", out, self.without())
            else:
                return out

    def without(self):
        out = self.unit()
        while self.take("NOT"):
            out = Op("not", out, self.unit())
        return out

    def unit(self):
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise QueryError("missing )")
            return out
        if self.peek() == ("word", "NEAR") and self.tokens[self.at + 1 : self.at + 2] == [("mark", "(")]:
            self.at += 2
            phrases = []
            while self.peek()[0] in ("word", "string"):
                phrases.append(self.phrase())
            distance = 10
            if self.take(","):
                if not self.peek()[1].isdigit():
                    raise QueryError("NEAR needs a number")
                distance = int(self.peek()[1])
                self.at += 1
            if not self.take(")") or not phrases:
                raise QueryError("NEAR is not closed")
            return Near(tuple(phrases), distance)
        if self.peek()[0] == "word" and self.tokens[self.at + 1 : self.at + 2] == [("mark", ":")]:
            if self.peek()[1] != "text":
                raise QueryError(f"no such column: {self.peek()[1]}")
            self.at += 2
            return self.unit()
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.take("^")
        words: list[str] = []
        while True:
            kind, value = self.peek()
            if kind not in ("word", "string") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"syntax error near {value!r}")
            self.at += 1
            words += terms_of(value[1:-1].replace('""', '"') if kind == "string" else value)
            if not self.take("+"):
                break
        return Phrase(tuple(words), self.take("*"), initial)


def leaves(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return leaves(node.left) + leaves(node.right)


def index(texts: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf, positions), and (key, dl): the length of every text, null ones included.

    Lengths are worked out at once, as a ranking needs them twice; postings when they are read, as far as they are.
    """
    found = texts.select(key, X.terms(F.col("text")).alias("terms"))
    lengths = durable(found.select(key, F.size("terms").alias("dl")))
    places = found.select(key, F.posexplode("terms").alias("pos", "term"))
    postings = places.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return postings, lengths


def followed(places: Column, after: int):
    """A condition on a place: another term stands so many places behind it."""
    return lambda p: F.array_contains(places, p + after)


def starts(phrase: Phrase, at: dict[tuple[str, bool], Column]) -> Column:
    """Where a phrase begins in a text."""
    units = [(t, phrase.prefix and i == len(phrase.terms) - 1) for i, t in enumerate(phrase.terms)]
    if not units:
        return F.array().cast("array<int>")
    out = at[units[0]]
    for i, u in enumerate(units[1:], 1):
        out = F.filter(out, followed(at[u], i))
    return F.filter(out, lambda p: p == 0) if phrase.initial else out


def near(node: Near, at: dict) -> Column:
    """Whether all phrases lie with at most so many terms between the first one's end and the last one's start."""
    places = [starts(p, at) for p in node.phrases]

    def beside(p: Column, size: int):
        return lambda q: (q >= p) & (q - p - size <= node.distance)

    def leads(i: int):
        def holds(p: Column) -> Column:
            every = F.lit(True)
            for j, other in enumerate(places):
                if j != i:
                    every = every & F.exists(other, beside(p, len(node.phrases[i].terms)))
            return every

        return holds

    out = F.lit(False)
    for i in range(len(places)):
        out = out | F.exists(places[i], leads(i))
    return out


def matches(node, at: dict) -> Column:
    if isinstance(node, Phrase):
        return F.size(starts(node, at)) > 0
    if isinstance(node, Near):
        return near(node, at)
    left, right = matches(node.left, at), matches(node.right, at)
    return left & right if node.kind == "and" else left | right if node.kind == "or" else left & ~right


def ranked(postings: DataFrame, lengths: DataFrame, query: str, key: str = "event_id") -> DataFrame:
    """(key, rank) of the texts that a query matches; lower ranks are better.

    Only postings of the query's terms are read. Frequencies and lengths count over all texts of the index.
    """
    node = Parser(query).parse()
    phrases = leaves(node)
    units = sorted({(t, p.prefix and i == len(p.terms) - 1) for p in phrases for i, t in enumerate(p.terms)})
    wanted = F.lit(False)
    for term, prefix in units:
        wanted = wanted | (F.col("term").startswith(term) if prefix else F.col("term") == term)
    of = lambda term, prefix: F.col("term").startswith(term) if prefix else F.col("term") == term
    places = [F.array_sort(F.flatten(F.collect_list(F.when(of(*u), F.col("positions"))))).alias(f"p{i}") for i, u in enumerate(units)]
    texts = postings.filter(wanted).groupBy(key).agg(*places or [F.lit(0).alias("none")])
    at = {u: F.col(f"p{i}") for i, u in enumerate(units)}
    texts = durable(texts.select(key, matches(node, at).alias("hit"), *[F.size(starts(p, at)).alias(f"tf{i}") for i, p in enumerate(phrases)]))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    held = texts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]).first()
    import math

    d = lambda x: F.lit(float(x))
    rank = d(0)
    for i in range(len(phrases)):
        idf = max(LEAST_IDF, math.log((whole["n"] - held[f"n{i}"] + 0.5) / (held[f"n{i}"] + 0.5))) if whole["n"] else 0.0
        tf = F.col(f"tf{i}").cast("double")
        rank = rank - d(idf) * (tf * d(K1 + 1)) / (tf + d(K1) * (d(1 - B) + d(B) * F.col("dl") / d(whole["avgdl"] or 1)))
    return texts.filter("hit").join(lengths, key).select(key, rank.alias("rank"))


def search(corpus: Corpus, query: str, scope: Scope | None = None, actor: str | None = None, kind: str | None = None, limit: int = 20, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Live placements whose text a query matches, best first; a row a placement. Pass `tables` to use a stored index.

    The human origin leaves out user messages by others, and keeps all that isn't a user's; another origin looks at
    user messages of that verdict alone.
    """
    scope = scope or Scope()
    hits = ranked(*(tables or index(corpus.events)), query)
    events = corpus.events.select("event_id", "ts", "actor", "type", "text").filter("length(text) > 0")
    if actor:
        events = events.filter(F.col("actor") == actor)
    if kind:
        events = events.filter(F.col("type") == kind)
    rows = corpus.placements.filter("live = 1").join(events.join(hits, "event_id"), "event_id").filter(message_predicate(scope))
    rows = rows.join(sessions_in(corpus, scope).select("session_id", "source", "cwd", "title", "hidden_at", "hidden_reason"), "session_id")
    if scope.origin == "human":
        if actor in (None, "user"):
            users = by_origin(rows.filter("actor = 'user'"), corpus, "human")
            rows = users if actor else users.unionByName(rows.filter("actor <> 'user'"))
    elif scope.origin != "all":
        rows = by_origin(rows.filter("actor = 'user'"), corpus, scope.origin)
    out = corpus.with_origin(rows).select("rank", "ts", "source", "session_id", "seq", "event_id", "cwd", "title", "actor", "type", "inherited", "origin", "hidden_at", "hidden_reason", "text")
    ordered = out.orderBy("rank", F.desc("ts"), F.desc("session_id"), F.desc("seq"))
    return ordered if limit < 0 else ordered.limit(limit)


def snippet(text: str | None, query: str, size: int = 12) -> str:
    """The part of a text of so many terms that holds most of a query's terms, these in brackets."""
    wanted = [(p.terms, p.prefix) for p in leaves(Parser(query).parse())]
    words = [m for m in re.finditer(r"[^\W_]+", text or "")]
    plain = [terms_of(m[0]) for m in words]
    hit = [False] * len(words)
    for phrase, prefix in wanted:
        for i in range(len(words) - len(phrase) + 1 if phrase else 0):
            own = [plain[i + j][0] if plain[i + j] else "" for j in range(len(phrase))]
            if all(o == t or prefix and j == len(phrase) - 1 and o.startswith(t) for j, (o, t) in enumerate(zip(own, phrase, strict=True))):
                hit[i : i + len(phrase)] = [True] * len(phrase)
    if not words:
        return ""
    start = max(range(max(1, len(words) - size + 1)), key=lambda i: (sum(hit[i : i + size]), -i))
    end = min(len(words), start + size)
    out, at = ["…" if start else text[: words[0].start()]], words[start].start()
    for i in range(start, end):
        out.append(text[at : words[i].start()])
        before, after = hit[i] and not (i > start and hit[i - 1]), hit[i] and not (i + 1 < end and hit[i + 1])
        out.append(f"{'[' * before}{words[i][0]}{']' * after}")
        at = words[i].end()
    out.append("…" if end < len(words) else text[at:])
    return "".join(out)


def with_snippets(hits: DataFrame, query: str) -> DataFrame:
    make = F.pandas_udf(lambda s: s.map(lambda t: snippet(t, query)), "string")
    return hits.withColumn("snippet", make("text"))
