"""Browsing: newest human messages, sessions by their latest message, lists of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import Corpus, Scope, session_predicate, user_messages


def userlog(corpus: Corpus, scope: Scope | None = None, limit: int = 50) -> DataFrame:
    """The newest clean user messages, by time as written, session and place; a negative limit gives all."""
    rows = corpus.with_origin(user_messages(corpus, scope or Scope()))
    rows = rows.select("ts", "source", "session_id", "seq", "event_id", "cwd", "title", "hidden_at", "hidden_reason", "origin", "text", F.length("text").alias("chars"))
    ordered = rows.orderBy(F.desc("ts"), F.desc("session_id"), F.desc("seq"))
    return ordered if limit < 0 else ordered.limit(limit)


def recent(corpus: Corpus, scope: Scope | None = None, limit: int = 30) -> DataFrame:
    """Sessions by their latest clean user message, with counts of such messages and of all live events.

    Counts are made for the sessions shown alone. The latest message of each is found within the shuffle by session,
    before which each task keeps its own latest.
    """
    messages = user_messages(corpus, scope or Scope())
    newest = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq")))
    top = messages.withColumn("n", newest).filter("n = 1").drop("n")
    top = top.orderBy(F.desc("ts"), F.desc("session_id"))
    top = corpus.with_origin(top if limit < 0 else top.limit(limit))
    shown = top.select("session_id")
    users = messages.join(shown, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("user_msg_count"))
    live = corpus.placements.filter("live = 1").join(shown, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("live_event_count"))
    out = top.join(users, "session_id", "left").join(live, "session_id", "left")
    return out.select(
        F.col("ts").alias("last_user_ts"), "source", "session_id", F.col("seq").alias("last_user_seq"), F.col("event_id").alias("last_user_event_id"), "cwd", "title",
        F.col("text").alias("last_user_text"), F.col("origin").alias("last_user_origin"), "hidden_at", "hidden_reason", F.length("text").alias("last_user_chars"),
        F.coalesce("user_msg_count", F.lit(0)).alias("user_msg_count"), F.coalesce("live_event_count", F.lit(0)).alias("live_event_count"),
    ).orderBy(F.desc("last_user_ts"), F.desc("session_id"))


def list_sessions(corpus: Corpus, scope: Scope | None = None, limit: int = 30) -> DataFrame:
    """Sessions by start, newest first, with their live events; sessions without any count 0."""
    sessions = corpus.sessions.filter(session_predicate(scope or Scope()))
    live = corpus.placements.filter("live = 1").groupBy("session_id").agg(F.count("*").alias("n"))
    out = sessions.join(live, "session_id", "left").select("started_at", F.coalesce("n", F.lit(0)).alias("n"), "source", "session_id", "cwd", "title", "hidden_at")
    ordered = out.orderBy(F.desc("started_at"), F.desc("session_id"))
    return ordered if limit < 0 else ordered.limit(limit)


def hidden_sessions(corpus: Corpus, scope: Scope | None = None, limit: int = 50) -> DataFrame:
    scope = scope or Scope()
    scope.only_hidden = True
    out = corpus.sessions.filter(session_predicate(scope)).select("session_id", "source", "machine", "cwd", "started_at", "hidden_at", "hidden_reason", "title")
    ordered = out.orderBy(F.desc("hidden_at"), "session_id")
    return ordered if limit < 0 else ordered.limit(limit)


def apply_visibility(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions with the latest of each one's entries in the log of hiding and showing; the log outlives rebuilds."""
    last = log.groupBy("session_id").agg(F.max_by(F.struct("hidden_at", "hidden_reason"), "changed").alias("v"))
    return sessions.drop("hidden_at", "hidden_reason").join(last, "session_id", "left").select("*", F.col("v.hidden_at").alias("hidden_at"), F.col("v.hidden_reason").alias("hidden_reason")).drop("v")
