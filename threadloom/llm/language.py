"""Language of texts: a convolutional network over bytes, trained and run in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Bytes of a window; texts are cut into windows end to end.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Windows that the network takes at a time.
AT_ONCE = 64
#: Labelled documents of each language that the network is trained on (as expected), and bytes of whole texts at most.
FIT_DOCS, FIT_BYTES = 800, 3 << 20
EPOCHS, STEPS, STEP = 12, 300, 0.01
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


UNKNOWN = "und"

#: Bytes by class: letters, blank, digit, other ASCII, then bytes beyond ASCII; continuation bytes stay apart.
CLASSES = 128
_CLASS = np.full(256, 28, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[[9, 10, 11, 12, 13, 32]] = 26
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[0x80:0xC0] = 29 + np.arange(64)
_CLASS[0xC0:] = 93 + np.minimum(np.arange(64), 34)
BLANK = 26


def windows(text: str) -> np.ndarray:
    """Classes of the bytes of a whole text in lower case, a row a window; the last one is filled up with blanks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.full((max(1, -(-len(raw) // WINDOW)), WINDOW), BLANK, np.uint8)
    out.reshape(-1)[: len(raw)] = _CLASS[raw]
    return out


@dataclass
class Network:
    """Filters of several widths over one-hot bytes, maximum over a window, rectifier, softmax."""

    languages: list[str]
    filters: list[np.ndarray]  # a width each: offset, class, filter
    bias: np.ndarray
    dense: np.ndarray  # feature, language
    offset: np.ndarray

    @classmethod
    def new(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(5)
        n = len(WIDTHS) * FILTERS
        return cls(languages, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def ready(self) -> Network:
        """Sums filters over pairs of bytes, so that a position takes one look-up for two bytes."""
        self.tables = []
        for f in self.filters:
            steps = [((f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS), k, True) for k in range(0, len(f) - 1, 2)]
            if len(f) % 2:
                steps.append((f[-1], len(f) - 1, False))
            self.tables.append([(np.ascontiguousarray(t), k, pair) for t, k, pair in steps])
        return self

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each window, and its position if asked for."""
        c = np.ascontiguousarray(rows.T).astype(np.int32)
        pairs = c[:-1] * CLASSES + c[1:]
        best, at = [], []
        for w, steps in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - w + 1
            total = None
            for table, k, pair in steps:
                part = np.take(table, (pairs if pair else c)[k : k + n], axis=0, mode="clip")
                total = part if total is None else np.add(total, part, out=total)
            best.append(total.max(axis=0))
            if where:
                at.append(total.argmax(axis=0))
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1) if where else None

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Logarithm of the softmax for each window."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for i in range(0, len(rows), AT_ONCE):
            z = np.maximum(self.pooled(rows[i : i + AT_ONCE])[0] + self.bias, 0) @ self.dense + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[i : i + AT_ONCE] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, rows: np.ndarray, labels: np.ndarray) -> Network:
        """Gradient steps (Adam) on shuffled batches, STEPS of them at least; a filter learns at the position of its maximum."""
        rng = np.random.default_rng(6)
        parameters = [*self.filters, self.bias, self.dense, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * AT_ONCE // len(rows)))):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), AT_ONCE):
                x, y = rows[order[i : i + AT_ONCE]], labels[order[i : i + AT_ONCE]]
                best, at = self.ready().pooled(x, True)
                hidden = np.maximum(best + self.bias, 0)
                z = hidden @ self.dense + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.dense.T) * (hidden > 0)
                grads = []
                for j, f in enumerate(self.filters):
                    g, own = np.zeros_like(f), slice(j * FILTERS, (j + 1) * FILTERS)
                    for k in range(len(f)):
                        np.add.at(g[k], (x[np.arange(len(x))[:, None], at[:, own] + k], np.arange(FILTERS)[None]), back[:, own])
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, (m, v) in zip(parameters, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self.ready()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: the highest mean of the windows' log-odds, and its mean share in them."""
        found = [windows(t) if has_letter(t) else None for t in texts]
        some = [x for x in found if x is not None]
        odds = self.log_odds(np.concatenate(some)) if some and self.languages else None
        out, at = [], 0
        for x in found:
            if x is None or odds is None:
                out.append((UNKNOWN, 0.0))
                continue
            own = odds[at : at + len(x)]
            at += len(x)
            best = int(own.mean(axis=0, dtype=np.float64).argmax())
            out.append((self.languages[best], float(min(1.0, np.exp(own[:, best], dtype=np.float64).mean()))))
        return out


def all_windows(text: str | None) -> np.ndarray:
    """Windows of a text end to end; none if it has no letter."""
    return windows(text) if has_letter(text) else np.zeros((0, WINDOW), np.uint8)


def fitted(rows: list[np.ndarray], languages: list[str]) -> Network:
    """A network from texts' windows and languages."""
    names = sorted(set(languages))
    network = Network.new(names)
    labels = np.repeat([names.index(lang) for lang in languages], [len(r) for r in rows]) if rows else np.zeros(0, int)
    return network.train(np.concatenate(rows), labels) if len(labels) else network.ready()


def learn(labelled: DataFrame, docs_each: int = FIT_DOCS) -> Network:
    """A network from `labelled` (doc_id, text, lang), null languages left out.

    Of each language so many documents are expected to be drawn, by a hash of their id, or all if it has fewer. Of
    these, in the order of the hash, whole documents are taken until one would pass FIT_BYTES; longer ones are passed
    over. All windows of these come to the driver.
    """
    known = labelled.filter("lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == F.lit(lang)) & (draw < F.lit(int(1_000_000 * min(1.0, docs_each / n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, i, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()], pa.string()), pa.array([i.as_py()], pa.string()), pa.array([all_windows(t.as_py()).tobytes()], pa.binary())], ["lang", "id", "w"])

    prepare(labelled.sparkSession)
    drawn = known.filter(chosen).select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), draw.alias("draw"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.xxhash64("text").alias("t"), "text")
    room, taken = {lang: FIT_BYTES for lang in counts}, []
    for r in sorted(drawn.select("lang", "draw", "id", "t", "size").collect(), key=tuple):
        if r["size"] <= room[r["lang"]]:
            room[r["lang"]] -= r["size"]
            taken.append((r["lang"], r["id"], r["t"]))
    spark = labelled.sparkSession
    own = spark.createDataFrame(sorted(set(taken), key=str), "lang string, id string, t long")
    texts = drawn.join(F.broadcast(own), ["lang", "id", "t"], "left_semi").select("lang", "id", "text")
    got = sorted((r["lang"], r["id"], bytes(r["w"])) for r in texts.mapInArrow(run, "lang string, id string, w binary").toLocalIterator())
    order = np.random.default_rng(7).permutation(len(got))
    return fitted([np.frombuffer(got[i][2], np.uint8).reshape(-1, WINDOW) for i in order], [got[i][0] for i in order])


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs` (doc_id, text), from the whole text alone.

    A text that is null or has no letter is `und` with score 0, as is every text if the network has no language.
    Repeated rows stay, an empty table gives an empty result; other columns are not read.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
