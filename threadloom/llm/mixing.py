"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, same, stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's hash that name its slice of a source; a hot source is cut into so many slices.
SLICE_DIGITS = 3
#: Ranges that the queue is sorted into at a time, and rows of one that are summed in order.
RANGES, SUMMED_ROWS = 64, 10_000
#: The total order of the queue's entries: virtual finish time, then ties.
ORDER = ("finish", "h", "doc_id", "size", "rank", "turn")


def word_count(text: str = "text") -> Column:
    """Words of a text: runs of other characters than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, rank, target) for each source of `sizes` (source, size).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words. No target passes
    `most` times its source's words; what is above goes to the others by weight. One row for each source is sorted
    in one place, documents are not.
    """
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_room = W.orderBy("room", "rank")
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    # The level at which the sources from this one on share what is left once all with less room are full.
    # It rises as long as sources fill up and falls after that, so its highest value holds for all that don't.
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("step", left / F.sum("weight").over(by_room.rowsBetween(W.currentRow, W.unboundedFollowing)))
    each = each.withColumn("level", F.max("step").over(whole))
    return each.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, repeats), a row for each row.

    Each source is a queue of its documents in hashed order, `most` times over. A document's virtual finish time is
    its source's words up to and with it, divided by the source's target. All entries are sorted by it over ranges,
    and the mix ends before the entry that would pass the budget. A hot source is summed in slices.

    Rows with the same id, source and size are one entry and share its fate. Null ids, sources and texts are values
    like others; a text without words is taken 0 times. An empty table gives an empty result. Other columns of `docs`
    are not read.
    """
    slim = stored(docs.select("doc_id", "source", word_count().alias("size")))
    sources = stored(source_targets(slim, weights, share, most))
    units = slim.filter("size > 0").groupBy("source", "doc_id", "size").agg(F.sum("size").alias("words"))
    units = units.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    units = stored(join_small(units, sources, ["source"]).drop("source"))

    slices = units.groupBy("rank", "slice").agg(F.sum("words").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("rank").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select("rank", "slice", F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = F.sum("words").over(W.partitionBy("rank", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    queued = stored(units.join(slices, ["rank", "slice"]).withColumn("served", F.col("offset") + inside))

    def entries(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(most)])))
        return each.withColumn("finish", (F.col("served") + F.col("source_size") * F.col("turn")) / F.col("target"))

    end = queue_end(entries(queued).select(*ORDER, "words"), slim, share)
    taken = entries(queued).filter(end).groupBy(F.col("rank").alias("u_rank"), F.col("doc_id").alias("u_id"), F.col("size").alias("u_size")).agg(F.count("*").alias("repeats"))
    rows = join_small(slim, sources, ["source"])
    rows = rows.join(taken, (F.col("rank") == F.col("u_rank")) & same(F.col("doc_id"), F.col("u_id")) & (F.col("size") == F.col("u_size")), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("repeats", F.lit(0)).alias("repeats"))


def queue_end(entries: DataFrame, sizes: DataFrame, share: float) -> Column:
    """Condition for an entry to come before the first that passes the budget of `share` times all words.

    Entries are dealt to sorted ranges; the ranges' totals tell in which one the budget ends, and that range is dealt
    to ranges again, until it is short enough to be summed row by row.
    """
    budget, before, rows = float(share) * (sizes.agg(F.sum("size")).first()[0] or 0), 0, entries
    while True:
        ranged = stored(rows.repartitionByRange(RANGES, *ORDER).withColumn("part", F.spark_partition_id()))
        totals = sorted((r["part"], r["words"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect())
        for part, words, n in totals:
            if before + words > budget:
                break
            before += words
        else:
            return F.lit(True)
        rows = ranged.filter(F.col("part") == part).drop("part")
        if n <= SUMMED_ROWS or len(totals) == 1:
            break
    upto = F.lit(before) + F.sum("words").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow))
    first = rows.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy(*ORDER).first()
    # Nulls come first in the order, and so they do in a comparison of structs.
    return F.struct(*ORDER) < F.struct(*[F.lit(first[c]).cast(entries.schema[c].dataType).alias(c) for c in ORDER])


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: each document's row, with its columns, as often as the mix takes it.

    Documents without words aren't taken. Rows with the same id, source and size are taken alike.
    """
    fate = mix_sources(docs, weights, share, most).filter("repeats > 0").groupBy("doc_id", "source", "size").agg(F.max("repeats").alias("__repeats"))
    fate = fate.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__fate_size"), "__repeats")
    rows = docs.withColumn("__size", word_count())
    rows = rows.join(fate, same(F.col("doc_id"), F.col("__id")) & same(F.col("source"), F.col("__source")) & (F.col("__size") == F.col("__fate_size")))
    return rows.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__repeats")))).select(*docs.columns)
