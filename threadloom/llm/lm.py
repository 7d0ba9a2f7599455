"""Scores of texts by a recurrent language model and by a unigram base, both learned from a table's own texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .recurrent import CLASS_WORDS, CLASSES, Model

#: Most frequent words that tasks hold with their counts; all others' counts are joined.
HELD_WORDS = 100_000
#: Training tokens of a shard, about. A shard trains one copy of the network, so the copies' quality is that of so many
#: tokens at any size of the input, and the number of copies grows with it.
SHARD_TOKENS = 4_000_000
#: Parts in which copies' weights are summed.
SUM_PARTS = 64
#: Distinct words that a task counts before it passes them on; texts and bytes that are scored side by side.
COUNTED_AT_ONCE, TEXTS_AT_ONCE, BYTES_AT_ONCE = 200_000, 2000, 8_000_000
#: Bins of a doubling of counts, by which the count of the HELD_WORDS-th word is bounded.
BINS = 16


def split(text: bytes | None) -> list[bytes]:
    """Words of a text between ASCII white space, ASCII letters in lower case."""
    return text.lower().split() if text else []


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts of the column `text`. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                counted.update(split(t.as_py()))
                if len(counted) > COUNTED_AT_ONCE:
                    yield batch(counted)
                    counted = Counter()
        yield batch(counted)

    def batch(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())], ["word", "c"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words by falling count, and sums over all training tokens, ends of texts with them."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int

    @property
    def modelled(self) -> int:
        """Words that are symbols of the network."""
        return min(len(self.words), CLASSES * CLASS_WORDS)

    @property
    def other_tokens(self) -> int:
        return self.tokens - self.ends - int(self.counts[: self.modelled].sum())

    @property
    def other_distinct(self) -> int:
        return self.distinct - (self.ends > 0) - self.modelled

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def unknown(self, c: np.ndarray) -> np.ndarray:
        """Share of a word with count c among the words that aren't symbols."""
        return np.log10((c + 1) / (self.other_tokens + self.other_distinct + 1))


def lexicon(counts: DataFrame, ends: int, held: int = HELD_WORDS) -> Lexicon:
    """Sums and the words from a count on that at most `held` words reach. counts (word, c) is stored already."""
    bins = {r["b"]: r for r in counts.groupBy(F.floor(F.log2("c") * BINS).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.min("c").alias("least")).collect()}
    least, room = None, held
    for b in sorted(bins, reverse=True):
        room -= bins[b]["n"]
        if room < 0:
            break
        least = bins[b]["least"]
    top = [] if least is None else counts.filter(F.col("c") >= least).toLocalIterator()
    found = sorted(((-r["c"], bytes(r["word"])) for r in top))
    return Lexicon([w for _, w in found], np.array([-c for c, _ in found], np.int64), ends, sum(r["c"] for r in bins.values()) + ends, sum(r["n"] for r in bins.values()) + (ends > 0))


def trained(texts: DataFrame, known: Lexicon) -> Model:
    """The network after one pass over all `texts` (doc_id, text), in shards; each trains a copy, and copies are averaged.

    Shards and the order within them follow from hashes of ids and texts alone, so that the model doesn't depend on
    how the rows were partitioned. A table's row counts as often as a copy used it: copies that never saw a word leave
    it alone. Weighted sums are made on the executors, part by part; the driver gets one model.
    """
    # Add-one counts of what is no symbol: training texts hold fewer unknown words than texts to come.
    model = Model.new(known.counts[: known.modelled].astype(float), known.ends, known.other_tokens + known.other_distinct + 1)
    model.unknown_weight = 1 + (known.other_distinct + 1) / max(known.other_tokens, 1)
    shared = texts.sparkSession.sparkContext.broadcast((model, known))
    shards = max(1, round(known.tokens / SHARD_TOKENS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        look = symbols_of(known, model)
        for b in batches:
            found = [look(split(t.as_py())).astype("<u2").tobytes() for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["shard", "h", "symbols"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for b in batches for x in b.column(2)]
        if seen:
            model = shared.value[0]
            used = model.train(np.concatenate(seen))
            sums = [table.reshape(len(table), -1) * n[:, None] for table, n in zip(model.tables(), used, strict=True)]
            yield packed(np.concatenate([x.reshape(-1) for x in (*sums, *used)]))

    def packed(flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(SUM_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(flat, SUM_PARTS)], pa.binary())], ["part", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(v.as_py())
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "v"])

    h = F.xxhash64("doc_id", "text")
    rows = texts.select("doc_id", F.col("text").cast("string")).select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), "text")
    dealt = rows.mapInArrow(read, "shard int, h bigint, symbols binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("h", "symbols")
    parts = dealt.mapInArrow(train, "part int, v binary").repartition("part").mapInArrow(total, "part int, v binary").collect()
    if parts:
        flat = np.concatenate([np.frombuffer(r["v"]) for r in sorted(parts)])
        tables = model.tables()
        used, first = flat[sum(t.size for t in tables) :], 0
        for table in tables:
            n = np.repeat(used[: len(table)], table.size // len(table))
            own = n > 0
            table.reshape(-1)[own] = flat[first : first + table.size][own] / n[own]
            used, first = used[len(table) :], first + table.size
    return model


def symbols_of(known: Lexicon, model: Model):
    """A function from words to symbols, END last."""
    table = {w: i for i, w in enumerate(known.words[: known.modelled])}
    return lambda words: np.fromiter(chain(map(table.get, words, repeat(model.unknown)), (model.end,)), np.int64, len(words) + 1)


def scores(docs: DataFrame, learns: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_elsewhere, elsewhere) of every row of `docs`.

    Reads (doc_id, text). A text's tokens are its words and one end; null texts have the end alone. Rows for which
    `learns` holds (a null doesn't) are counted and train the network, all of them. base_score: sum of log10 of add-one
    probabilities. n_elsewhere: tokens that the training rows hold more often than this row brought them there, which
    tells what the corpus knows of a text from what the text itself put in; elsewhere: its share of the tokens. score: log10 probability by the network, in which a word that is no symbol takes its part of the
    unknown symbol by its count. Words beyond the HELD_WORDS most frequent get their counts by a join; whole texts
    are scored.

    Rows of one id and one text have one score. An empty table gives an empty result; if no row learns, all words
    are unknown. Other columns are read by `learns` alone.
    """
    spark = prepare(docs.sparkSession)
    learning = docs.filter(learns)
    counts = stored(word_counts(learning))
    known = lexicon(counts, learning.count())
    model = trained(learning, known)
    shared = spark.sparkContext.broadcast((known, model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        table = {w: i for i, w in enumerate(known.words)}
        base, part = known.base(known.counts), np.where(np.arange(len(known.counts)) < known.modelled, 0.0, known.unknown(known.counts))
        base_end = float(known.base(np.array([known.ends]))[0])
        ids: list = []
        hashes: list = []
        texts: list = []
        learned: list = []
        size = 0

        def scored() -> pa.RecordBatch:
            symbols, rows = [], []
            for t, own in zip(texts, learned, strict=True):
                words = split(t)
                at = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
                missing = at < 0
                rare = Counter(words[i] for i in np.nonzero(missing)[0])
                held = at[~missing]
                again = len(held)
                if own and again and len(held) >= known.counts[-1]:
                    distinct, times = np.unique(held, return_counts=True)
                    again -= int(times[known.counts[distinct] <= times].sum())
                rows.append((len(words) + 1, len(held) + (known.ends > 0), base[held].sum() + base_end, part[held].sum(), rare, again + (known.ends > own)))
                symbols.append(np.append(np.where((at >= 0) & (at < known.modelled), at, model.unknown), model.end))
            odds = model.score(symbols) / np.log(10) + np.array([r[3] for r in rows])
            rare_kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            out = [
                pa.array(ids, id_type), pa.array(hashes, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.float64()), pa.array(odds, pa.float64()), pa.array([r[5] for r in rows], pa.int64()), pa.array(learned, pa.bool_()), pa.array([[{"word": w, "n": n} for w, n in r[4].items()] for r in rows], rare_kind),
            ]
            ids.clear(), hashes.clear(), texts.clear(), learned.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "h", "n_tokens", "n_known", "base_score", "score", "n_elsewhere", "learned", "rare"])

        for b in batches:
            id_type = b.column(0).type
            for i, h, own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()), strict=True):
                ids.append(i)
                hashes.append(h)
                learned.append(own)
                texts.append(t.as_py())
                size += len(texts[-1] or b"")
                if len(texts) >= TEXTS_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield scored()
                    size = 0
        if texts:
            yield scored()

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.coalesce(learns, F.lit(False)).alias("learned"), text.alias("text"))
    sums = ("n_tokens", "n_known", "base_score", "score", "n_elsewhere")
    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, h bigint, n_tokens bigint, n_known bigint, base_score double, score double, n_elsewhere bigint, learned boolean, rare array<struct<word:binary,n:bigint>>"))
    rare = rows.select("doc_id", "h", "learned", F.explode("rare").alias("r")).select("doc_id", "h", "learned", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    of_rare = rare.join(counts, "word", "left").select(
        "doc_id", "h", F.lit(0).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("n_tokens"),
        F.when(c > 0, n).otherwise(0).alias("n_known"),
        (n * F.log10((c + 1) / F.lit(float(known.tokens + known.distinct + 1)))).alias("base_score"),
        (n * F.log10((c + 1) / F.lit(float(known.other_tokens + known.other_distinct + 1)))).alias("score"),
        F.when(c > F.when(F.col("learned"), n).otherwise(0), n).otherwise(0).alias("n_elsewhere"),
    )
    of_rows = rows.select("doc_id", "h", F.lit(1).cast("bigint").alias("copies"), *sums)
    # Copies of a row bring their rare words as often as themselves, so sums over copies are shared by them.
    both = of_rows.unionByName(of_rare).groupBy("doc_id", "h").agg(*[F.sum(x).alias(x) for x in ("copies", *sums)])
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    of = {x: F.col(x) / F.col("copies") for x in sums}
    return each.select(
        "doc_id", *[of[x].cast("bigint").alias(x) for x in ("n_tokens", "n_known")], F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        *[of[x].alias(x) for x in ("base_score", "score")], of["n_elsewhere"].cast("bigint").alias("n_elsewhere"), (of["n_elsewhere"] / of["n_tokens"]).alias("elsewhere"),
    )
