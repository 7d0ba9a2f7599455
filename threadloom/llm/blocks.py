"""Searches over blocks of vectors: rows lie in blocks of bounded size, queries visit blocks, tasks score one block each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, stored

#: Rows of a block, about; queries that meet a block in one task, about.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Queries scored at a time within a task.
TILE = 256


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(df: DataFrame, key: str, vector: str, value: Column, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows whose vector takes part: not null, all components there and finite, of the usual length.

    The usual length is the most common one among these rows (of several, the shortest).
    """
    v = F.col("v")
    there = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(there)
    if nonzero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0)).select("vec_id", value.alias("v"))


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each group of equal vectors, the rows with the k + 1 smallest ids: no query's k best hold another one."""
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")


@dataclass
class Cut:
    """Bins, a row a tree or pivot, in sorted order, as blocks: each bin's first block and how many it is spread over."""

    base: np.ndarray
    spread: np.ndarray
    blocks: int

    @classmethod
    def of(cls, counts: np.ndarray, rows: int = BLOCK_ROWS) -> Cut:
        base, spread, n = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64), 0
        for g in range(counts.shape[0]):
            held = 0
            for b, c in enumerate(counts[g]):
                if c > rows or held + c > rows:
                    n, held = n + (held > 0), 0
                base[g, b] = n
                if c > rows:
                    spread[g, b] = -(-int(c) // rows)
                    n += spread[g, b]
                else:
                    held += c
            n += held > 0
            base[g, counts[g].cumsum() == 0] = base[g].min()
        return cls(np.minimum(base, max(n - 1, 0)), spread, max(n, 1))


def block_scores(rows: DataFrame, visits: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block that a query visits, its k best candidates.

    rows (block, h, vec_id, v) lie in blocks; visits (block, query_id, qv, lo, hi, least) ask for a block's rows with
    lo <= h < hi, in the order of h, and a score of at least `least`. Scores are inner products, exact for integers.
    Queries that meet a block are dealt to tasks of about QUERY_ROWS.
    """
    spark = rows.sparkSession
    chunks = np.ones(blocks, np.int32)
    for r in visits.groupBy("block").agg(F.count("*").alias("n")).toLocalIterator():
        chunks[r["block"]] = -(-r["n"] // QUERY_ROWS)
    kind = rows.schema["v"].dataType.elementType.simpleString()
    score_type = "bigint" if kind == "bigint" else "double"
    if chunks.max(initial=1) > 1:
        shared = spark.createDataFrame([(int(b), int(c)) for b, c in enumerate(chunks)], "block bigint, chunks int")
        rows = join_small(rows, shared, ["block"], "inner", blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        visits = join_small(visits, shared, ["block"], "inner", blocks).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")
    else:
        rows, visits = rows.withColumn("chunk", F.lit(0)), visits.withColumn("chunk", F.lit(0))

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and asked.num_rows:
            h, ids, x = data["h"].to_numpy(), data["vec_id"].to_numpy(), matrix(data["v"])
            order = np.lexsort((ids, h))
            h, ids, x = h[order], ids[order], x[order]
            lo, hi = np.searchsorted(h, asked["lo"].to_numpy()), np.searchsorted(h, asked["hi"].to_numpy())
            own, least, q = asked["query_id"].to_numpy(), asked["least"].to_numpy(), matrix(asked["qv"])
            x, q = exact(x, q)
            for at in range(0, len(own), TILE):
                s = q[at : at + TILE] @ x.T
                for i in range(len(s)):
                    a, b = lo[at + i], hi[at + i]
                    if a < b:
                        got, who = s[i, a:b], ids[a:b]
                        keep = np.nonzero((got >= least[at + i]) & (who != own[at + i]))[0]
                        if len(keep) > k:
                            floor = np.partition(got[keep], len(keep) - k)[len(keep) - k]
                            keep = keep[got[keep] >= floor]
                            keep = keep[np.lexsort((who[keep], -got[keep]))[:k]]
                        found.append((np.full(len(keep), own[at + i]), who[keep], got[keep]))
        a, b, c = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.int64 if score_type == "bigint" else np.float64))})

    return rows.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(run, f"query_id bigint, vec_id bigint, score {score_type}")


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles, in which products of integers are exact, or as they are if these could be too large."""
    if x.dtype.kind == "i" and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2**53:
        return x.astype(np.int64), q.astype(np.int64)
    return x.astype(np.float64), q.astype(np.float64)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def histogram(pairs: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Counts of (g, b); as many rows as the shape has cells at most."""
    out = np.zeros(shape, np.int64)
    for r in pairs.groupBy("g", "b").agg(F.count("*").alias("n")).toLocalIterator():
        out[r["g"], r["b"]] = r["n"]
    return out


def sample(rows: DataFrame, most: int, seed: str) -> np.ndarray:
    """The vectors of the rows that come first in hashed order, as doubles."""
    got = rows.orderBy(F.md5(F.concat(F.lit(seed), F.col("vec_id").cast("string"))), "vec_id").limit(most).select("v").collect()
    return np.array([r["v"] for r in got], float)


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """With a component more that gives all the norm `largest`: then the largest inner product is the nearest point."""
    return np.c_[x, np.sqrt(np.maximum(0, largest**2 - (x * x).sum(axis=1)))]


def per_batch(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of a function from a batch to columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = run(b)
                yield pa.RecordBatch.from_arrays(list(got.values()), list(got))

    return df.mapInArrow(each, schema)


__all__ = ["Cut", "augmented", "best", "block_scores", "first_copies", "histogram", "matrix", "per_batch", "sample", "stored", "usable"]
