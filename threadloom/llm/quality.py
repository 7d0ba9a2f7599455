"""Quality of documents: a text classifier's evidence combined with what is known of a document's site."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, prepare, stored

#: Labelled rows that the classifier is fitted on at most; site posteriors use every labelled row.
FIT_ROWS = 4000
#: Words whose presence the classifier weighs, chosen by the likelihood ratio of their presence and the label.
CUE_WORDS = 64
#: Letters of a word's beginning that is a cue of its own: inflected words share it.
STEM = 5
LETTERS = re.compile(r"[^\W\d_]+")
HEADS = ("quality", "toxic")

UPPER, LOWER, DIGIT, BLANK, SYMBOL, BANG, BAR, OTHER, HIGH = range(9)
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = UPPER, LOWER, DIGIT, HIGH
for _chars, _kind in ((" \t\n\r\x0b\x0c", BLANK), ("#$%&*@^~\\_=+<>", SYMBOL), ("!?", BANG), ("|", BAR)):
    for _c in _chars:
        _KIND[ord(_c)] = _kind


def presence(text: str) -> set[str]:
    """Words of a text in lower case, and the beginnings of longer ones, marked by a hyphen."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


def style(text: str, words: list[str]) -> list[float]:
    """How a whole text is written: capitals, symbols, repetition, words' lengths and lines."""
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=9)
    n, letters, size = len(words) + 1, kinds[UPPER] + kinds[LOWER] + kinds[HIGH] + 1, kinds.sum() + 1
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        kinds[UPPER] / letters, min(5, kinds[SYMBOL] / n), min(5, kinds[BANG] / n), min(5, kinds[BAR] / n), repeats / n,
        len(set(words)) / n, min(3, len(text) / n / 10), kinds[DIGIT] / size, np.log1p(n) / 10, np.log1p(kinds[SYMBOL]) / 5,
        np.log1p(kinds[BANG]) / 5, np.log1p(repeats) / 5, np.log1p(kinds[BAR]) / 5, 1 - len(set(lines)) / max(1, len(lines)), letters / size,
    ]


@dataclass
class Classifier:
    """Logistic regressions, one a head, over the style of a text and the cue words in it."""

    cues: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # head, feature; the last feature is the constant
    rates: tuple[float, ...]

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.mean) + 1))
        known = self.cues.keys()
        for row, t in zip(out, texts, strict=True):
            t = t or ""
            row[: len(self.mean) - len(known)] = style(t, t.split())
            for w in known & presence(t):
                row[self.cues[w]] = 1
        out[:, :-1] = (out[:, :-1] - self.mean) / self.scale
        out[:, -1] = 1
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of each head, as far as the text speaks for it: without the fit's base rate."""
        base = np.array([np.log(r / (1 - r)) for r in self.rates])
        return np.clip(self.features(texts) @ self.weights.T - base, -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty on all but the constant, by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(raw: np.ndarray, labels: np.ndarray, cues: list[str]) -> Classifier:
    """A classifier from plain features (style, then presence of cues, then 1) and labels, a column a head, 0 or 1."""
    plain, width = raw.shape[1] - 1 - len(cues), raw.shape[1]
    made = blank(cues, plain)
    made.rates = tuple((labels.sum(axis=0) + 1) / (len(raw) + 2))
    if len(raw):
        made.mean[:plain], made.scale[:plain] = raw[:, :plain].mean(axis=0), raw[:, :plain].std(axis=0) + 1e-3
        x = np.c_[(raw[:, :-1] - made.mean) / made.scale, raw[:, -1]]
        made.weights = np.array([logistic(x, labels[:, h]) for h in range(labels.shape[1])])
    else:
        made.weights = np.zeros((len(HEADS), width))
        made.weights[:, -1] = [np.log(r / (1 - r)) for r in made.rates]
    return made


def blank(cues: list[str], plain: int | None = None) -> Classifier:
    """A classifier that gives plain features."""
    plain = len(style("", [])) if plain is None else plain
    n = plain + len(cues)
    return Classifier({w: plain + i for i, w in enumerate(cues)}, np.zeros(n), np.ones(n), np.zeros((len(HEADS), n + 1)), ())


def cue_words(labelled: DataFrame, n: int, totals: dict[str, float], most: int = CUE_WORDS) -> list[str]:
    """Words whose presence tells most about a label, by their G statistic; at least 4 texts hold each.

    labelled: (text, heads as 0 or 1), n rows of them. Words are counted where the texts are; the best come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, hits = Counter(), [Counter() for _ in HEADS]
            for t, *marks in zip(b.column(0).to_pylist(), *[b.column(1 + i).to_pylist() for i in range(len(HEADS))], strict=True):
                words = presence(t or "")
                seen.update(words)
                for own, mark in zip(hits, marks, strict=True):
                    if mark:
                        own.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), *[pa.array([own[w] for w in seen], pa.int64()) for own in hits]], ["word", "seen", *HEADS])

    counts = labelled.select("text", *HEADS).mapInArrow(run, "word string, seen bigint, " + ", ".join(f"{h} bigint" for h in HEADS))
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("seen", *HEADS)]).filter("seen >= 4")
    best: set[str] = set()
    for h in HEADS:
        a, c, t = F.col(h).cast("double"), F.col("seen").cast("double"), float(totals[h])
        if not 0 < t < n:
            continue
        g = F.lit(0.0)
        for got, expected in ((a, c * t / n), (c - a, c * (n - t) / n), (F.lit(t) - a, (F.lit(float(n)) - c) * t / n), (F.lit(n - t) - c + a, (F.lit(float(n)) - c) * (n - t) / n)):
            g = g + F.when(got > 0, 2 * got * F.log(got / expected)).otherwise(0.0)
        best |= {r["word"] for r in counts.withColumn("g", F.round(g, 6)).orderBy(F.desc("g"), "word").limit(most).filter("g > 10.8").collect()}
    return sorted(best)


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic), a row an id: repeated labels are averaged, null ids and nulls left out."""
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.avg(F.col(h).cast("double")).alias(h) for h in HEADS])


def classifier(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fitted on the labelled documents that come first in hashed order, `rows` at most.

    Their texts stay on the executors; the driver gets words and numbers.
    """
    chosen = one_label(labels).na.drop().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    marks = [(F.col(h) >= 0.5).cast("int").alias(h) for h in HEADS]
    found = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *marks))
    sums = found.agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    cues = cue_words(found, sums["n"], {h: sums[h] or 0 for h in HEADS})
    plain = blank(cues)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(plain.features(texts.where(texts.notna(), None).tolist())), index=texts.index, dtype=object)

    rows = sorted(([*r["x"], *[r[h] for h in HEADS]] for r in found.select(features("text").alias("x"), *HEADS).collect()))
    data = np.array(rows, float).reshape(len(rows), -1) if rows else np.zeros((0, len(plain.mean) + 1 + len(HEADS)))
    return fit(data[:, : -len(HEADS)], data[:, -len(HEADS) :], cues)


def shrinkage(groups: DataFrame, good: str, n: str) -> tuple[float, float]:
    """(rate, strength): the overall rate, and how many rows the prior counts as, from how far rates of groups differ.

    Method of moments for a beta-binomial: the spread beyond what chance gives is between groups.
    """
    r = groups.agg(F.sum(good).alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("gg"), F.count("*").alias("k")).first()
    if not r["n"]:
        return 0.5, 1.0
    p = min(max(r["g"] / r["n"], 1e-4), 1 - 1e-4)
    spread, room = (r["gg"] - r["g"] ** 2 / r["n"]) / (p * (1 - p)) - (r["k"] - 1), r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    rho = min(max(spread / room if room > 0 else 0.0, 1e-3), 0.5)
    return p, 1 / rho - 1


@dataclass
class Sites:
    """A fitted classifier and what is known of hosts and of paths below them."""

    model: object  # broadcast Classifier
    evidence: DataFrame  # (doc_id, t, host, path, e, labels) of every document, stored; t tells texts of one id apart
    paths: DataFrame
    hosts: DataFrame
    priors: dict[str, tuple[float, float, float]]  # head: rate, strength of the prior of hosts, and of paths


def sites(docs: DataFrame, labels: DataFrame, host: str, path: str, rows: int) -> Sites:
    """Sums over each path and host: every document by the classifier, those with a label corrected to it."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(classifier(docs, labels, rows))
    evidence = stored(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.xxhash64(F.col("text").cast("string")).alias("t"), logits(model)("text").alias("e")))
    evidence = stored(evidence.join(one_label(labels), "doc_id", "left"))
    rates = [F.sum(own_rate(model.value, i)).alias(f"path_{h}") for i, h in enumerate(HEADS)]
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n_path"), *rates))
    hosts = stored(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), *[F.sum(f"path_{h}").alias(f"host_{h}") for h in HEADS]))
    priors = {}
    for h in HEADS:
        (rate, of_hosts), (_, of_paths) = shrinkage(hosts, f"host_{h}", "n_host"), shrinkage(paths, f"path_{h}", "n_path")
        priors[h] = (rate, of_hosts, of_paths)
    return Sites(model, evidence, paths, hosts, priors)


def logits(model):  # noqa: ANN001, ANN201
    """A column function from a text to the classifier's evidence, a number for each head."""

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.value.logits(texts.where(texts.notna(), None).tolist())), index=texts.index, dtype=object)

    return lambda text: evidence(F.col(text).cast("string"))


def expected(model: Classifier, head: int) -> Column:
    """Chance by the text alone, from the evidence in the column `e`."""
    rate = model.rates[head]
    return 1 / (1 + F.exp(-(F.col("e")[head] + F.lit(float(np.log(rate / (1 - rate)))))))


def own_rate(model: Classifier, head: int) -> Column:
    """What a row adds to its site: its label, or its chance by the text where it has none."""
    return F.coalesce(F.col(HEADS[head]), expected(model, head))


def judged(rows: DataFrame, known: Sites) -> DataFrame:
    """Rows of (e, host, path, labels) with quality_score, toxic_score and keep; a row's own part of its site doesn't count for it."""
    out = join_small(join_small(rows, known.paths, ["host", "path"]), known.hosts, ["host"])
    for i, h in enumerate(HEADS):
        rate, of_hosts, of_paths = known.priors[h]
        own = own_rate(known.model.value, i)
        at_host = (F.greatest(F.lit(0.0), F.col(f"host_{h}") - own) + F.lit(of_hosts * rate)) / (F.col("n_host") - 1 + F.lit(of_hosts))
        at_path = (F.greatest(F.lit(0.0), F.col(f"path_{h}") - own) + F.lit(of_paths) * at_host) / (F.col("n_path") - 1 + F.lit(of_paths))
        site = F.least(F.greatest(at_path, F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn(f"{h}_score", 1 / (1 + F.exp(-(F.col("e")[i] + F.log(site / (1 - site))))))
    return out.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, host, path, quality_score, toxic_score, keep) of every row of `docs` (doc_id, text, host, path).

    A text classifier gives each document's evidence. All documents of a host and of a path below it give these
    sites' rates: by the classifier, corrected by labels where there are any. A path's rate is shrunk toward its
    host's, and that toward the overall one, the more the fewer documents there are; a document's own text and
    label don't count for its site. The scores join the site's rate and the text's evidence, in log-odds. keep: quality is
    likely and toxicity isn't.

    Null texts count as empty; null hosts and paths are sites like others; null ids have no label. Repeated rows
    stay. Without labels the scores stay near a half. An empty table gives an empty result. Other columns are not read.
    """
    known = sites(docs, labels, host, path, rows)
    return judged(known.evidence, known).select("doc_id", "host", "path", *[f"{h}_score" for h in HEADS], "keep")


def accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """The rows that the scores keep, with their columns. Each text is scored once; what is rejected is left out by id and text."""
    known = sites(docs, labels, host, path, rows)
    ids = ["doc_id", "t", "host", "path"]
    rejected = judged(known.evidence, known).filter("NOT keep").select(*[F.col(c).alias(f"__{c}") for c in ids]).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("t"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    same_row = F.lit(True)
    for c in ids:
        same_row = same_row & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # Rejected rows grow with the input, so they are never broadcast.
    return packed.join(rejected.hint("merge"), same_row, "left_anti").select("__row.*")
