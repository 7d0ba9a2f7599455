"""Exact top-k search by pivot distances: rows lie in annuli around pivots, of which triangle inequalities rule out most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import prepare, stored

#: Pivots; rows that they are chosen from; bins of distance around each.
PIVOTS, FIT_ROWS, BINS = 16, 2048, 512
#: Blocks that a query visits in the first round, and how many times as many in each round after it.
FIRST, FACTOR = 4, 16
#: Rows of a block, about.
ROWS = 4096


def chosen_pivots(fit: np.ndarray, n: int) -> np.ndarray:
    """Points of the sample far from each other: first the one nearest the mean, then the farthest from all before."""
    at = [int(((fit - fit.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    gap = ((fit - fit[at[0]]) ** 2).sum(axis=1)
    while len(at) < n and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((fit - fit[at[-1]]) ** 2).sum(axis=1))
    return fit[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, square))


def top_products(vectors: DataFrame, asks: Column, value: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product, for each row for which `asks` holds.

    `value` makes integers of the components of column `v`. A component more gives all rows one norm, so that the
    largest product is the nearest point. Each row is keyed by its nearest pivot and its distance to it; annuli of
    about ROWS rows are blocks. A query visits blocks in the order of the least distance that the triangle
    inequality leaves for their rows, in rounds, until that passes the distance of its k-th best. Nothing that could
    be in the result is left out.

    Candidates are all rows but those of the query's own id. Vectors that are null, of another than the usual length
    or hold nulls or values that are not finite take no part; zero vectors do. Of equal vectors, only copies behind
    the k + 1 smallest ids are left out, which no result can hold. Queries with fewer candidates return these. An
    empty table gives an empty result; columns other than key and vector are read by `asks` alone.
    """
    spark = prepare(vectors.sparkSession)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    all_rows = stored(blocks.usable(vectors, key, vector, value, False))
    queries = all_rows.withColumnRenamed("vec_id", key).filter(asks).withColumnRenamed(key, "vec_id").distinct()
    rows = stored(blocks.first_copies(all_rows, k))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(norm)).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    largest = float(np.sqrt(top))
    pivots = chosen_pivots(blocks.augmented(blocks.sample(rows, FIT_ROWS, "pivots"), largest), PIVOTS)
    reach = 2 * largest + 1e-9
    basis = spark.sparkContext.broadcast((pivots, largest, reach))

    def keys(b: pa.RecordBatch) -> dict:
        pivots, largest, reach = basis.value
        d = distances(blocks.augmented(blocks.matrix(b.column(1)).astype(float), largest), pivots)
        g = d.argmin(axis=1)
        near = d[np.arange(len(d)), g]
        return {"g": pa.array(g.astype(np.int32)), "b": pa.array(np.minimum(BINS - 1, near / reach * BINS).astype(np.int64)), "d": pa.array(near), "vec_id": b.column(0), "v": b.column(1)}

    keyed = stored(blocks.per_batch(rows, keys, "g int, b bigint, d double, vec_id bigint, v array<bigint>"))
    counts = blocks.histogram(keyed, (len(pivots), BINS))
    cut = blocks.Cut.of(counts, max(ROWS, int(counts.sum()) // 8192))
    # A row for each bin that holds rows, PIVOTS * BINS at most.
    cells = [(int(g), int(b), int(cut.base[g, b]), int(cut.spread[g, b])) for g, b in np.argwhere(counts > 0)]
    found_in = F.broadcast(spark.createDataFrame(cells, "g int, b bigint, base bigint, spread bigint"))
    block = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("spread"))
    placed = keyed.join(found_in, ["g", "b"]).select(block.alias("block"), "d", F.lit(0).cast("bigint").alias("h"), "vec_id", "v")
    inner, outer, pivot_of = np.full(cut.blocks, np.inf), np.full(cut.blocks, -np.inf), np.zeros(cut.blocks, np.int64)
    owner = np.repeat(np.arange(len(pivots)), BINS).reshape(counts.shape)
    for g, b in np.argwhere(counts > 0):
        pivot_of[cut.base[g, b] : cut.base[g, b] + cut.spread[g, b]] = owner[g, b]
    for r in placed.groupBy("block").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).toLocalIterator():
        inner[r["block"]], outer[r["block"]] = r["lo"], r["hi"]
    annuli = spark.sparkContext.broadcast((inner, outer, pivot_of))
    found = None
    asked = queries.withColumn("least", F.lit(None).cast("bigint"))
    seen = 0
    width = FIRST
    while True:
        visits = stored(blocks.per_batch(asked, ring_visits(basis, annuli, seen, width), "block bigint, query_id bigint, qv array<bigint>, lo bigint, hi bigint, least bigint"))
        seen, width = seen + width, width * FACTOR
        if found is not None and not visits.limit(1).count():
            # Bounds don't fall along a query's order, so the rounds after one without visits have none either.
            break
        got = blocks.block_scores(placed.drop("d"), visits, cut.blocks, k)
        found = stored(blocks.best(got if found is None else found.drop("rank").unionByName(got), k))
        if seen >= cut.blocks:
            break
        kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        asked = queries.join(kth, "vec_id", "left")
    return found


def ring_visits(basis, annuli, seen: int, width: int):
    """Visits of the next `width` blocks in each query's order, without those that can't hold any of its k best."""

    def run(b: pa.RecordBatch) -> dict:
        (pivots, largest, _), (inner, outer, pivot_of) = basis.value, annuli.value
        q = blocks.matrix(b.column(1)).astype(float)
        square = (q * q).sum(axis=1)
        d = distances(np.c_[q, np.zeros(len(q))], pivots)[:, pivot_of]
        bound = np.maximum(0, np.maximum(d - outer, inner - d))
        # Products within rounding of the bound are visited too.
        highest = (largest**2 + square[:, None] - bound**2) / 2 + 1e-6 * (largest**2 + square[:, None] + 1)
        least = np.array([-(2**62) if x is None else x for x in b.column(2).to_pylist()], np.int64)
        order = np.lexsort((np.abs(d - (inner + outer) / 2), bound), axis=1)[:, seen : seen + width]
        at, rank = np.nonzero((np.take_along_axis(highest, order, 1) >= least[:, None]) & np.isfinite(np.take_along_axis(bound, order, 1)))
        take = pa.array(at)
        n = len(at)
        return {"block": pa.array(order[at, rank].astype(np.int64)), "query_id": b.column(0).take(take), "qv": b.column(1).take(take), "lo": pa.array(np.zeros(n, np.int64)), "hi": pa.array(np.ones(n, np.int64)), "least": pa.array(least[at])}

    return run


def scaled_floor(by: float = 64.0) -> Column:
    """Components of `v` times `by`, rounded down, as longs."""
    return F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(by)).cast("bigint"))
