"""Turns: a user message and what follows up to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import Corpus


def is_tool() -> Column:
    return F.col("type").isin("tool_call", "tool_result") | (F.col("actor") == "tool")


def turn_rows(corpus: Corpus, sessions: DataFrame | None = None, include_all: bool = False) -> DataFrame:
    """Placements with content and origin, of some sessions or all; live ones, or all."""
    placements = corpus.placements if include_all else corpus.placements.filter("live = 1")
    if sessions is not None:
        placements = placements.join(sessions.select("session_id"), "session_id", "left_semi")
    rows = placements.join(corpus.events.select("event_id", "ts", "actor", "type", "text", "refs"), "event_id")
    return corpus.with_origin(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with turn_index; synthetic user messages are left out, what comes before the first user is a turn too."""
    user = (F.col("actor") == "user") & (F.col("type") == "message")
    order = W.partitionBy("session_id").orderBy("seq", "event_id")
    kept = rows.filter(~(user & X.synthetic_in_turns(F.col("text"))))
    kept = kept.withColumn("is_user", user).withColumn("block", F.sum(user.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = F.min("block").over(W.partitionBy("session_id"))
    return kept.withColumn("turn_index", F.col("block") - first).drop("block")


def build_turns(rows: DataFrame, user_chars: int = 0, agent_chars: int = 300, tool_chars: int = 80, show_tools: bool = False) -> DataFrame:
    """A row for each turn of each session, its events as an array in order."""
    tool = is_tool()
    text = F.when(tool, X.preview(F.col("text"), tool_chars)).otherwise(X.preview(F.col("text"), agent_chars))
    event = F.struct("seq", "event_id", "ts", "actor", "type", "live", "inherited", text.alias("preview"))
    shown = ~F.col("is_user") & (F.lit(show_tools) | ~tool)
    of_user = lambda c: F.max(F.when(F.col("is_user"), F.col(c)))
    out = numbered(rows).groupBy("session_id", "turn_index").agg(
        F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), of_user("ts").alias("ts"), of_user("seq").alias("user_seq"), of_user("event_id").alias("user_event_id"),
        of_user("text").alias("user_text"), of_user("live").alias("user_live"), of_user("inherited").alias("user_inherited"), of_user("origin").alias("user_origin"),
        F.count_if(~F.col("is_user") & tool & F.lit(not show_tools)).alias("hidden_tool_events"),
        F.array_sort(F.collect_list(F.when(shown, event))).alias("events"),
    )
    return out if not user_chars else out.withColumn("user_text", X.preview(F.col("user_text"), user_chars))


def window(turns: DataFrame, around_seq: int | None = None, context_turns: int = 2, limit: int = 50) -> DataFrame:
    """Of each session, the first turns, or those around the one that holds a place.

    The target is the first turn that holds the place, else the first that starts behind it, else the last.
    """
    every = W.partitionBy("session_id")
    if around_seq is None:
        if limit == 0:
            return turns
        return turns.filter(F.col("turn_index") < limit) if limit > 0 else turns.withColumn("__n", F.count("*").over(every)).filter(F.col("turn_index") < F.col("__n") + limit).drop("__n")
    holds = F.min(F.when(F.lit(around_seq).between(F.col("seq_start"), F.col("seq_end")), F.col("turn_index"))).over(every)
    behind = F.min(F.when(F.col("seq_start") >= around_seq, F.col("turn_index"))).over(every)
    target = F.coalesce(holds, behind, F.max("turn_index").over(every))
    return turns.withColumn("__target", target).filter(F.abs(F.col("turn_index") - F.col("__target")) <= context_turns).drop("__target")


def nth(turns: DataFrame, n: int) -> DataFrame:
    """One turn of each session; negative numbers count from the end; no row where there is none."""
    if n >= 0:
        return turns.filter(F.col("turn_index") == n)
    return turns.withColumn("__n", F.count("*").over(W.partitionBy("session_id"))).filter(F.col("turn_index") == F.col("__n") + n).drop("__n")


def show(corpus: Corpus, sessions: DataFrame, include_all: bool = False) -> DataFrame:
    """A session's lines: place, actor, preview, first command or files, origin and whether rolled back."""
    rows = turn_rows(corpus, sessions, include_all)
    files = F.array_join(F.slice(F.coalesce("refs.files", F.array()), 1, 3), ", ")
    return rows.select("session_id", "seq", "actor", "type", X.preview(F.col("text"), 160).alias("preview"), F.coalesce(F.get("refs.commands", F.lit(0)), F.nullif(files, F.lit("")), F.lit("")).alias("detail"), "origin", (F.col("live") == 0).alias("rolled_back")).orderBy("session_id", "seq")


def nearest_user(rows: DataFrame, look_back: int = 5) -> DataFrame:
    """Rows with `nearest`: the last clean user message up to each, within the last few user messages.

    One window over each session's order stands in for a search from each row.
    """
    user = (F.col("actor") == "user") & (F.col("type") == "message")
    order = W.partitionBy("session_id").orderBy("seq", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.sum(user.cast("int")).over(order)
    message = F.struct(F.col("__n").alias("n"), "seq", "event_id", "ts", "text", "live", "inherited")
    marked = rows.withColumn("__n", n)
    marked = marked.withColumn("__last", F.last(F.when(user & ~X.synthetic_in_turns(F.col("text")), message), ignorenulls=True).over(order))
    return marked.withColumn("nearest", F.when(F.col("__last.n") > F.col("__n") - look_back, F.col("__last").dropFields("n"))).drop("__n", "__last")
