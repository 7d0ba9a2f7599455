"""Transcripts as forests: parents bridged over records that show nothing, tips, live branches, and rollbacks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable


def bridged_parents(records: DataFrame, rounds: int = 24) -> DataFrame:
    """(session_id, record_id, parent_id): the nearest ancestor that shows something; null at a root, a gap or a cycle.

    records: session_id, record_id, parent_id, emits. Pointers of silent records double their reach each round, so
    rounds grow with the logarithm of a run of silent records; the number of rounds is a bound against cycles.
    """
    silent = records.filter("NOT emits").select("session_id", F.col("record_id").alias("via"), F.col("parent_id").alias("up"))
    for _ in range(rounds):
        step = silent.select("session_id", F.col("via").alias("up"), F.lit(True).alias("silent"), F.col("up").alias("next"))
        jumped = silent.join(step, ["session_id", "up"], "left")
        moved = jumped.filter("silent").limit(1).count()
        up = F.when(F.col("silent"), F.when(F.col("next") != F.col("via"), F.col("next"))).otherwise(F.col("up"))
        silent = durable(jumped.select("session_id", "via", up.alias("up")))
        if not moved:
            break
    own = records.filter("emits").select("session_id", "record_id", F.col("parent_id").alias("via"))
    over = own.join(silent.withColumn("silent", F.lit(True)), ["session_id", "via"], "left").withColumn("target", F.when(F.col("silent"), F.col("up")).otherwise(F.col("via")))
    emitting = records.filter("emits").select("session_id", F.col("record_id").alias("target"), F.lit(True).alias("shown"))
    return over.join(emitting, ["session_id", "target"], "left").select("session_id", "record_id", F.when(F.col("shown"), F.col("target")).alias("parent_id"))


def tips(events: DataFrame) -> DataFrame:
    """(session_id, tip): the childless event with the last time, then line; of a session where all have children, the last event."""
    parents = events.filter("parent_id IS NOT NULL").select("session_id", F.col("parent_id").alias("event_id")).distinct().withColumn("has_child", F.lit(True))
    rows = events.join(parents, ["session_id", "event_id"], "left").withColumn("leaf", F.col("has_child").isNull())
    return rows.groupBy("session_id").agg(F.max_by("event_id", F.struct("leaf", "ts", "line")).alias("tip"))


def live_events(events: DataFrame) -> DataFrame:
    """(session_id, event_id) on the path from each session's tip to its root; parents must come before their children."""
    before = events.select("session_id", F.col("event_id").alias("parent_id"), F.col("line").alias("parent_line"))
    ordered = events.join(before, ["session_id", "parent_id"], "left").withColumn("up", F.when(F.col("parent_line") < F.col("line"), F.col("parent_id")))
    return on_the_way(tips(events), ordered.select("session_id", "event_id", "up"))


def live_by_pointers(events: DataFrame) -> DataFrame:
    """As live_events where parents are known to come before their children."""
    return on_the_way(tips(events), events.select("session_id", "event_id", F.col("parent_id").alias("up")))


def on_the_way(tip: DataFrame, jumps: DataFrame) -> DataFrame:
    """(session_id, event_id) from tips (session_id, tip) along jumps (session_id, event_id, up), tips included.

    Jumps double their reach each round, so rounds grow with the logarithm of the longest way. Each round is stored.
    """
    keys = ["session_id", "event_id"]
    jumps = durable(jumps.filter("up IS NOT NULL"))
    marked = durable(tip.select("session_id", F.col("tip").alias("event_id")))
    while True:
        more = marked.join(jumps, keys).select("session_id", F.col("up").alias("event_id"))
        more = durable(more.distinct().join(marked, keys, "left_anti"))
        if not more.limit(1).count():
            return marked
        marked = durable(marked.unionByName(more))
        far = jumps.select("session_id", F.col("event_id").alias("up"), F.col("up").alias("far"))
        jumps = durable(jumps.join(far, ["session_id", "up"]).select(*keys, F.col("far").alias("up")))


def places(events: DataFrame) -> DataFrame:
    """Events with seq: their rank by line and place within the line."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("line", "idx")) - 1)


@dataclass
class _Turn:
    before: str | None
    events: list


def fold_rollbacks(steps: Iterable[tuple[str, str | None, int]]) -> tuple[list[tuple[str, str | None, bool]], str | None]:
    """Events with parents and whether they stay live, and the tip, of (kind, event, n) in order.

    `start` begins a turn, `event` adds to it (and begins one where there is none), `back` takes back the last n
    turns. It is a fold: what a step does depends on all before it.
    """
    stack: list[_Turn] = []
    parents: dict[str, str | None] = {}
    dead: set[str] = set()
    tip: str | None = None
    for kind, event, n in steps:
        if kind == "back":
            for _ in range(min(max(n, 0), len(stack))):
                turn = stack.pop()
                dead.update(turn.events)
                tip = turn.before
            continue
        if kind == "start" or not stack:
            stack.append(_Turn(tip, []))
        parents[event] = tip
        stack[-1].events.append(event)
        tip = event
    return [(e, p, e not in dead) for e, p in parents.items()], tip


def rollback_forest(steps: DataFrame) -> DataFrame:
    """(session_id, event_id, parent_event_id, live, is_tip) of steps (session_id, line, kind, event_id, n).

    One session is one task's group, as one log file is.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        rows, tip = fold_rollbacks(zip(pdf["kind"], pdf["event_id"], pdf["n"].fillna(1).astype(int), strict=True))
        sid = pdf["session_id"].iloc[0]
        return pd.DataFrame([(sid, e, p, int(live), e == tip) for e, p, live in rows], columns=["session_id", "event_id", "parent_event_id", "live", "is_tip"])

    return steps.groupBy("session_id").applyInPandas(run, "session_id string, event_id string, parent_event_id string, live int, is_tip boolean")
