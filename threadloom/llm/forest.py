"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import prepare, stored

#: Trees; bits of a hash string; prefixes are counted for the whole table up to so many bits, or fewer for few rows.
TREES, BITS, COUNTED = 8, 32, 16
#: Rows of a counted prefix, about.
PREFIX_ROWS = 64
#: Rows from which the hash functions' thresholds are taken; queries on which the ascent is tried against all rows.
FIT_ROWS, TRIED = 4096, 96
#: Share of the true neighbours that the tried queries must find.
AIM = 0.95


class Hashes:
    """A string of BITS bits for each tree: on which side of random planes, through the sample's median, a vector lies."""

    def __init__(self, fit: np.ndarray, largest: float) -> None:
        self.largest = largest
        rng = np.random.default_rng(11)
        self.planes = rng.normal(size=(fit.shape[1] + 1, TREES * BITS))
        self.cuts = np.median(blocks.augmented(fit, largest) @ self.planes, axis=0)

    def _bits(self, x: np.ndarray) -> np.ndarray:
        bits = (x @ self.planes > self.cuts).reshape(len(x), TREES, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._bits(blocks.augmented(x, self.largest))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """A query's length doesn't change the order of inner products, so it is set to the largest."""
        return self._bits(np.c_[q * (self.largest / np.sqrt((q * q).sum(axis=1, keepdims=True))), np.zeros(len(q))])


def levels(hashes: np.ndarray, below: np.ndarray, wanted: int) -> np.ndarray:
    """Each query's length of prefix: the longest at which all its trees together hold `wanted` rows, else 0.

    All trees of a query ascend together. below: sums of the counted bins up to each, a row a tree.
    """
    out, counted = np.zeros(len(hashes), np.int64), (below.shape[1] - 1).bit_length() - 1
    for level in range(1, counted + 1):
        first = (hashes >> (BITS - level)) << (counted - level)
        t = np.arange(TREES)
        held = (below[t, first + (1 << (counted - level))] - below[t, first]).sum(axis=1)
        out[held >= wanted] = level
    return out


def tried(rows: DataFrame, queries: DataFrame, hashes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash strings of TRIED queries, and for each and each of its true k nearest, the longest prefix they share.

    Every row is held against these few queries; each task passes on its k best for each.
    """
    got = queries.orderBy(F.md5(F.concat(F.lit("tried"), F.col("vec_id").cast("string"))), "vec_id").limit(TRIED).collect()
    ids, q = np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got], float)
    strings = hashes.value.of_queries(q)

    def run(b: pa.RecordBatch) -> dict:
        own, x = b.column(0).to_numpy(), blocks.matrix(b.column(1)).astype(float)
        s = q @ x.T
        s[ids[:, None] == own[None]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        differ = (hashes.value.of_rows(x)[top] ^ strings[:, None, :]).min(axis=2)
        n = top.shape[1]
        return {"query_id": pa.array(np.repeat(np.arange(len(ids)), n)), "vec_id": pa.array(own[top].reshape(-1)), "score": pa.array(np.take_along_axis(s, top, 1).reshape(-1)), "differ": pa.array(differ.reshape(-1))}

    found = blocks.per_batch(rows, run, "query_id bigint, vec_id bigint, score double, differ bigint").filter("score > double('-inf')")
    order = blocks.W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "differ").collect()
    shared = [(r["query_id"], BITS - int(r["differ"]).bit_length()) for r in near]
    return strings, np.array(shared, np.int64).reshape(-1, 2)


def candidates_wanted(strings: np.ndarray, shared: np.ndarray, below: np.ndarray, k: int) -> int:
    """The fewest rows a query's trees must hold, doubling from 4 k, for the tried queries to find AIM of the truth."""
    wanted, everything = 4 * k, int(below[:, -1].sum())
    while wanted < everything:
        if (shared[:, 1] >= levels(strings, below, wanted)[shared[:, 0]]).mean() >= AIM:
            return wanted
        wanted = int(wanted * 1.25)
    return everything + 1  # no level holds as many: all queries ascend to the root


def neighbours(vectors: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): k near rows, by inner product, for each row of `vectors` for which `asks` holds.

    Each of TREES trees is a sorted array of all rows' hash strings, in blocks. A query descends to the rows that
    share its prefix, in all trees, and ascends in all together until they hold enough rows; how many are enough is
    tried on a few queries against all rows. All rows of the prefix are scored on the original vectors.

    Candidates are all rows but those of the query's own id. Vectors that are null, zero, of another than the usual
    length or hold nulls or values that are not finite take no part. Equal vectors are all found: only copies behind
    the k + 1 smallest ids are left out, which no result can hold. Queries with fewer candidates return these. An
    empty table gives an empty result; columns other than key and vector are read by `asks` alone.
    """
    spark = prepare(vectors.sparkSession)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    all_rows = stored(blocks.usable(vectors, key, vector, F.col("v"), True))
    queries = all_rows.withColumnRenamed("vec_id", key).filter(asks).withColumnRenamed(key, "vec_id")
    rows = stored(blocks.first_copies(all_rows, k))
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    hashes = spark.sparkContext.broadcast(Hashes(blocks.sample(rows, FIT_ROWS, "fit"), float(np.sqrt(top)) * (1 + 1e-12)))

    def strings(b: pa.RecordBatch) -> dict:
        h = hashes.value.of_rows(blocks.matrix(b.column(1)).astype(float))
        n = len(h)
        take = np.repeat(np.arange(n), TREES)
        return {"tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), "h": pa.array(h.reshape(-1)), "vec_id": b.column(0).take(pa.array(take)), "v": b.column(1).take(pa.array(take))}

    kind = rows.schema["v"].dataType.simpleString()
    spread = blocks.per_batch(rows, strings, f"tree int, h bigint, vec_id bigint, v {kind}")
    counted = min(COUNTED, max(4, (rows.count() // PREFIX_ROWS).bit_length()))
    counts = blocks.histogram(spread.select(F.col("tree").alias("g"), F.shiftright("h", BITS - counted).alias("b")), (TREES, 1 << counted))
    below = np.c_[np.zeros(TREES, np.int64), counts.cumsum(axis=1)]
    wanted = candidates_wanted(*tried(rows, queries, hashes, k), below, k)
    cut = blocks.Cut.of(counts)
    shared = spark.sparkContext.broadcast((below, cut))

    def place(b: pa.RecordBatch) -> dict:
        cut = shared.value[1]
        tree, h, ids = (b.column(i).to_numpy() for i in range(3))
        bins = h >> (BITS - counted)
        return {"block": pa.array(cut.base[tree, bins] + (ids * 2654435761 % 4294967296) % cut.spread[tree, bins]), "h": b.column(1), "vec_id": b.column(2), "v": b.column(3)}

    def visit(b: pa.RecordBatch) -> dict:
        below, cut = shared.value
        h = hashes.value.of_queries(blocks.matrix(b.column(1)).astype(float))
        level = levels(h, below, wanted)
        rows_at, block, lo, hi = [], [], [], []
        for i in range(len(h)):
            for t in range(TREES):
                depth = BITS - level[i]
                start = int(h[i, t] >> depth << depth)
                end = start + (1 << int(depth))
                first, last = start >> (BITS - counted), (end - 1) >> (BITS - counted)
                if below[t, last + 1] > below[t, first]:
                    full = first + np.nonzero(np.diff(below[t, first : last + 2]))[0]
                    for x in range(cut.base[t, full[0]], cut.base[t, full[-1]] + cut.spread[t, full[-1]]):
                        rows_at.append(i)
                        block.append(x)
                        lo.append(start)
                        hi.append(end)
                if level[i] == 0:
                    break  # at the root one tree holds all rows
        take = pa.array(rows_at, pa.int64())
        return {"block": pa.array(block, pa.int64()), "query_id": b.column(0).take(take), "qv": b.column(1).take(take), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "least": pa.array(np.full(len(block), -np.inf))}

    placed = blocks.per_batch(spread, place, f"block bigint, h bigint, vec_id bigint, v {kind}")
    visits = stored(blocks.per_batch(queries.select("vec_id", "v").distinct(), visit, f"block bigint, query_id bigint, qv {kind}, lo bigint, hi bigint, least double"))
    return blocks.best(blocks.block_scores(placed, visits, cut.blocks, k), k)

