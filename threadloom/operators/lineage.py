"""Lineage of sessions: ancestors by jumps that double, children and siblings in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import durable
from .corpus import Corpus

DEEPEST = 100


def ancestors(sessions: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(session_id, ancestor_id, depth, missing) up the parents, DEEPEST at most, to a missing one or a cycle.

    All sessions climb together. Jumps along the parents double their reach each round, so there are as many rounds
    as the logarithm of the greatest depth; each is stored. In a cycle the way ends before it comes back to a session.
    """
    start = sessions if of is None else sessions.join(of.select("session_id"), "session_id", "left_semi")
    jumps = sessions.filter("parent_session_id IS NOT NULL AND parent_session_id <> session_id").select("session_id", F.col("parent_session_id").alias("up"))
    found = start.select("session_id", F.col("session_id").alias("at"), F.lit(0).alias("depth"))
    reach = 1
    while reach <= DEEPEST:
        step = jumps.select(F.col("session_id").alias("at"), "up")
        more = found.join(step, "at").select("session_id", F.col("up").alias("at"), (F.col("depth") + reach).alias("depth")).filter(F.col("depth") <= DEEPEST)
        more = durable(more)
        if not more.limit(1).count():
            break
        found = durable(found.unionByName(more).groupBy("session_id", "at").agg(F.min("depth").alias("depth")))
        reach *= 2
        if reach <= DEEPEST:
            jumps = durable(jumps.join(jumps.select(F.col("session_id").alias("up"), F.col("up").alias("far")), "up").select("session_id", F.col("far").alias("up")))
    known = sessions.select(F.col("session_id").alias("at"), F.lit(True).alias("known"))
    return found.filter("depth > 0").join(known, "at", "left").select("session_id", F.col("at").alias("ancestor_id"), "depth", F.col("known").isNull().alias("missing"))


def in_order(rows: DataFrame, by: str) -> DataFrame:
    """Rows with `nth` and `total` among those of one parent, by when they began."""
    begun = F.coalesce(X.millis(F.col("created_at")), X.millis(F.col("started_at")), X.millis(F.col("ended_at")), F.lit(0))
    order = W.partitionBy(by).orderBy(begun, "session_id")
    return rows.withColumn("nth", F.row_number().over(order)).withColumn("total", F.count("*").over(W.partitionBy(by)))


def children(sessions: DataFrame, of: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(parent_session_id, session_id, nth, total, relation, title) of the sessions that came from others; `limit`: so many of a parent."""
    rows = sessions.filter("parent_session_id IS NOT NULL")
    if of is not None:
        rows = rows.join(of.select(F.col("session_id").alias("parent_session_id")), "parent_session_id", "left_semi")
    found = in_order(rows, "parent_session_id")
    found = found if limit is None else found.filter(F.col("nth") <= limit)
    return found.select("parent_session_id", "session_id", "nth", "total", "relation", "title")


def siblings(sessions: DataFrame, of: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(session_id, sibling_id, nth, total): other children of a session's parent, in order; `limit`: so many of a session.

    Children are put in order once a parent; a session's own place tells its siblings' numbers. With a limit only the
    first children of a parent meet its others, so pairs grow with the rows and not with their square.
    """
    me = sessions if of is None else sessions.join(of.select("session_id"), "session_id", "left_semi")
    ordered = durable(in_order(sessions.filter("parent_session_id IS NOT NULL"), "parent_session_id").select("session_id", "parent_session_id", "nth", "total"))
    first = ordered if limit is None else ordered.filter(F.col("nth") <= limit + 1)
    mine = ordered.join(me.select("session_id"), "session_id", "left_semi").select(F.col("session_id").alias("me"), "parent_session_id", F.col("nth").alias("own"))
    pairs = mine.join(first, "parent_session_id").filter("session_id <> me")
    nth = F.col("nth") - F.when(F.col("nth") > F.col("own"), 1).otherwise(0)
    pairs = pairs.withColumn("n", nth)
    pairs = pairs if limit is None else pairs.filter(F.col("n") <= limit)
    return pairs.select(F.col("me").alias("session_id"), F.col("session_id").alias("sibling_id"), F.col("n").alias("nth"), (F.col("total") - 1).alias("total"))


def latest_user(corpus: Corpus, look_back: int = 20) -> DataFrame:
    """(session_id, seq, ts, text) of each session's last clean user message among its last few by time."""
    rows = corpus.placements.filter("live = 1").join(corpus.events.filter("actor = 'user' AND type = 'message'").select("event_id", "ts", "text"), "event_id")
    order = W.partitionBy("session_id").orderBy(F.desc(X.millis(F.col("ts"))), F.desc("seq"))
    near = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= look_back).filter(~X.synthetic_in_turns(F.col("text")))
    return near.groupBy("session_id").agg(F.min_by(F.struct("seq", "event_id", "ts", "text"), "n").alias("u")).select("session_id", "u.*")


def summary(corpus: Corpus) -> DataFrame:
    """Sessions with the relation that holds: sub-agents by structure too, and their last clean user message."""
    agents = corpus.subagents().withColumn("agent", F.lit(True))
    last = latest_user(corpus).select("session_id", F.col("seq").alias("last_user_seq"), F.col("ts").alias("last_user_ts"), F.col("text").alias("last_user_text"))
    out = corpus.sessions.join(agents, "session_id", "left").join(last, "session_id", "left")
    return out.withColumn("stored_relation", F.col("relation")).withColumn("relation", F.when(F.col("agent"), F.lit("subagent")).otherwise(F.col("relation"))).drop("agent")
