"""Merging what files say into tables: order-independent, repeatable, and without loops over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable


def first_identity(rows: DataFrame, order: list[str], key: str = "event_id", identity: tuple[str, ...] = ("actor", "type", "text"), origin: str = "origin_session_id") -> DataFrame:
    """Rows with `kept`: whether each agrees with the first row of its key on its identity and on the first origin.

    The first row fixes what an event is; a later one of another identity, or of another known origin, is a conflict.
    """
    w = W.partitionBy(key).orderBy(*order)
    all_before = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.first(c).over(all_before))
    rows = rows.withColumn("__same", same)
    held = F.first(F.when(F.col("__same"), F.col(origin)), ignorenulls=True).over(all_before)
    return rows.withColumn("kept", F.col("__same") & (F.col(origin).isNull() | F.col(origin).eqNullSafe(held))).drop("__same")


def merge_events(rows: DataFrame, order: list[str], key: str = "event_id", origin: str = "origin_session_id", identity: tuple[str, ...] = ("actor", "type", "text")) -> DataFrame:
    """One row an event: the last kept row, with the first known origin."""
    kept = first_identity(rows, order, key, identity, origin).filter("kept").drop("kept")
    whole = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = kept.withColumn("__origin", F.first(origin, ignorenulls=True).over(whole)).withColumn("__last", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    return kept.filter("__last = 1").withColumn(origin, F.col("__origin")).drop("__origin", "__last")


STRUCTURE = ("ts", "actor", "type", "tool_call_event_id")


def ranked_identity(rows: DataFrame, key: str = "event_id", structure: tuple[str, ...] = STRUCTURE, origin: str = "origin_session_id") -> DataFrame:
    """Rows with `kept`: whether each agrees with the first row of its key on its structure and on the first origin.

    rows: key, structure, origin (null in an inherited copy), accepted (1: stands in the table already), revision,
    head_digest, digest. First are accepted rows, then the lowest by revision and digests. What was accepted thus
    stays; a copy of another structure or of another known origin is refused, and so is its place.
    """
    order = F.struct(F.when(F.col("accepted") == 1, 0).otherwise(1), "revision", "head_digest", "digest")
    shape = F.struct(*structure)
    first = rows.groupBy(key).agg(F.min_by(shape, order).alias("__shape"))
    rows = rows.join(first, key).withColumn("__same", shape.eqNullSafe(F.col("__shape"))).drop("__shape")
    held = rows.filter("__same").filter(F.col(origin).isNotNull()).groupBy(key).agg(F.min_by(origin, order).alias("__held"))
    kept = F.col("__same") & (F.col(origin).isNull() | F.col(origin).eqNullSafe(F.col("__held")))
    return rows.join(held, key, "left").withColumn("kept", kept).drop("__same", "__held")


def merge_ranked(rows: DataFrame, key: str = "event_id", structure: tuple[str, ...] = STRUCTURE, origin: str = "origin_session_id") -> DataFrame:
    """One row an event of those that `ranked_identity` keeps: authored before inherited, then the newest revision, then the least digest."""
    authored = F.col(origin).isNotNull()
    order = W.partitionBy(key).orderBy(F.desc(authored), F.when(authored, F.col("revision")).desc_nulls_last(), F.when(authored, F.col("head_digest")).desc_nulls_last(), "digest")
    kept = ranked_identity(rows, key, structure, origin).filter("kept").drop("kept")
    return kept.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__n = 1").drop("__n")


def heads(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, revision, digest): the highest rank of each session, by revision, then digest."""
    return rows.filter("revision > 0 AND digest RLIKE '^[0-9a-f]{64}$'").groupBy(key).agg(F.max(F.struct("revision", "digest")).alias("h")).select(key, "h.revision", "h.digest")


def advancing(candidates: DataFrame, accepted: DataFrame, key: str = "session_id") -> DataFrame:
    """Candidate heads that rank above what was accepted."""
    old = accepted.select(key, F.struct("revision", "digest").alias("__old"))
    return candidates.join(old, key, "left").filter(F.col("__old").isNull() | (F.struct("revision", "digest") > F.col("__old"))).drop("__old")


def complete_revisions(segments: DataFrame) -> DataFrame:
    """Segments (session_id, revision, digest, previous) whose chain reaches back to a first one without a gap.

    Pointers to earlier segments double their reach each round, and a segment is complete if what it points to is; so
    rounds grow with the logarithm of the longest chain. Each round is stored.
    """
    own = ["session_id", "revision", "digest"]
    rows = segments.select(*own, "previous").distinct()
    complete = durable(rows.filter("previous IS NULL AND revision = 1").select(*own).distinct())
    back = rows.filter("previous IS NOT NULL").select(*own, (F.col("revision") - 1).alias("to_revision"), F.col("previous").alias("to_digest"))
    n = complete.count()
    while n:
        reached = complete.select("session_id", F.col("revision").alias("to_revision"), F.col("digest").alias("to_digest"))
        more = back.join(reached, ["session_id", "to_revision", "to_digest"], "left_semi").select(*own).join(complete, own, "left_anti").distinct()
        more = durable(more)
        n = more.count()
        if n:
            complete = durable(complete.unionByName(more))
            far = back.select("session_id", F.col("revision").alias("to_revision"), F.col("digest").alias("to_digest"), F.col("to_revision").alias("r"), F.col("to_digest").alias("d"))
            back = durable(back.join(far, ["session_id", "to_revision", "to_digest"]).select(*own, F.col("r").alias("to_revision"), F.col("d").alias("to_digest")).distinct())
    return complete


def replace_placements(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """The table after sessions in `new` were parsed again: their rows replaced as a whole, others kept."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def placement_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, event_id, change): what a new parse of sessions adds, changes and removes."""
    keys = ["session_id", "event_id"]
    parsed = new.select("session_id").distinct()
    before = old.join(parsed, "session_id", "left_semi").select(*keys, F.struct("seq", "parent_event_id", "live", "inherited").alias("before"))
    after = new.select(*keys, F.struct("seq", "parent_event_id", "live", "inherited").alias("after"))
    both = before.join(after, keys, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(*keys, F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"))


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that are new or differ from what was taken in last."""
    known = state.select("path", F.struct("mtime", "size").alias("__known"))
    return listing.join(known, "path", "left").filter(~F.struct("mtime", "size").eqNullSafe(F.col("__known"))).drop("__known")


def duplicate_sessions(rows: DataFrame) -> DataFrame:
    """(session_id, places): sessions that come from more than one machine or source root."""
    return rows.groupBy("session_id").agg(F.countDistinct("machine", "root").alias("places")).filter("places > 1")


def backfill_winners(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """The best archived copy of each session that isn't live: the latest, then the most records, ids and bytes.

    decision says what the choice rests on: the only copy, copies alike in content, a superset of all ids, or time.
    """
    rows = candidates.join(live.select("session_id"), "session_id", "left_anti")
    order = ["max_ts", "records", "uuid_count", "size", "archive", "name"]
    own = W.partitionBy("session_id")
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("contents", F.size(F.collect_set("content_sha").over(own)))
    rows = rows.withColumn("all_ids", F.size(F.array_distinct(F.flatten(F.collect_list("uuids").over(own)))))
    best = latest(rows, "session_id", order)
    decision = F.when(F.col("n") == 1, "only-candidate").when(F.col("contents") == 1, "exact-duplicate").when(F.size(F.array_distinct("uuids")) == F.col("all_ids"), "uuid-superset").otherwise("latest-structured-timestamp")
    return best.withColumn("decision", decision).drop("contents", "all_ids")
