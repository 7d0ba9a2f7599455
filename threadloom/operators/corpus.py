"""The canonical tables together, and the predicates that queries over them share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NOT_HUMAN, SOURCES


@dataclass
class Corpus:
    """sessions carry hidden_at and hidden_reason; origins has a row only where an event isn't a human's."""

    sessions: DataFrame
    events: DataFrame
    placements: DataFrame
    origins: DataFrame

    def transcript(self) -> DataFrame:
        """Placements with their content, the raw record left behind."""
        return self.placements.join(self.events.select("event_id", "ts", "actor", "type", "text", "refs", "tool_call_event_id"), "event_id")

    def with_origin(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.origins.select("session_id", "event_id", "origin"), ["session_id", "event_id"], "left")

    def subagents(self) -> DataFrame:
        """Sessions that an agent started: by their relation, or by the call in the event that they branch off at."""
        stated = self.sessions.filter("relation = 'subagent'").select("session_id")
        branched = self.sessions.filter("branch_point_event_id IS NOT NULL").select("session_id", F.col("branch_point_event_id").alias("event_id"))
        record = F.from_json("raw", "id string, timestamp string, message struct<content:array<struct<type:string,id:string,name:string>>>")
        calls = branched.join(self.events.select("event_id", record.alias("r")), "event_id")
        calls = calls.select("session_id", "event_id", "r.id", "r.timestamp", F.posexplode("r.message.content").alias("at", "block"))
        call_id = F.concat(F.lit("pi:"), "id", F.lit(":"), "timestamp", F.lit(":"), F.coalesce(F.col("block.id"), F.concat(F.lit("b"), F.col("at").cast("string"))))
        own = calls.filter((F.col("block.type") == "toolCall") & (F.col("block.name") == "subagent") & (call_id == F.col("event_id")))
        return stated.union(own.select("session_id")).distinct()


@dataclass
class Scope:
    """Which sessions and messages a query looks at."""

    source: str | None = None
    cwd: str | None = None
    since: str | None = None
    after: str | None = None
    before: str | None = None
    exclude_recent: str | None = None
    min_chars: int = 0
    max_chars: int = 0
    query: str | None = None
    origin: str = "human"
    include_hidden: bool = False
    only_hidden: bool = False
    include_inherited: bool = False
    include_subagents: bool = False
    only_session: str | None = None
    exclude_sessions: tuple[str, ...] = ()


def visible(scope: Scope) -> Column:
    if scope.only_hidden:
        return F.col("hidden_at").isNotNull()
    return F.lit(True) if scope.include_hidden else F.col("hidden_at").isNull()


def by_origin(rows: DataFrame, corpus: Corpus, origin: str) -> DataFrame:
    """Rows of (session_id, event_id) by verdict. No verdict means a human."""
    keys = ["session_id", "event_id"]
    if origin == "all":
        return rows
    if origin == "human":
        return rows.join(corpus.origins.filter(F.col("origin").isin(*NOT_HUMAN)).select(*keys), keys, "left_anti")
    return rows.join(corpus.origins.filter(F.col("origin") == origin.replace("-", "_")).select(*keys), keys, "left_semi")


def session_predicate(scope: Scope) -> Column:
    out = visible(scope)
    if scope.source:
        out = out & (F.col("source") == scope.source)
    if scope.cwd:
        out = out & X.contains(F.col("cwd"), scope.cwd)
    if scope.only_session is not None:
        out = out & (F.col("session_id") == scope.only_session)
    for s in scope.exclude_sessions:
        out = out & (F.col("session_id") != s)
    return out


def message_predicate(scope: Scope) -> Column:
    """Conditions on a placement's time, length and text."""
    out = F.lit(True)
    if not scope.include_inherited and scope.only_session is None:
        out = out & (F.col("inherited") == 0)
    for value, compare in ((scope.since, "ge"), (scope.after, "ge"), (scope.before, "lt"), (scope.exclude_recent, "lt")):
        if value:
            at = X.literal_millis(X.cutoff(value))
            out = out & (X.millis(F.col("ts")) >= at if compare == "ge" else X.millis(F.col("ts")) < at)
    size = F.length(F.coalesce("text", F.lit("")))
    if scope.min_chars:
        out = out & (size >= scope.min_chars)
    if scope.max_chars:
        out = out & (size <= scope.max_chars)
    if scope.query:
        out = out & X.contains(F.col("text"), scope.query.lower())
    return out


def sessions_in(corpus: Corpus, scope: Scope) -> DataFrame:
    chosen = corpus.sessions.filter(session_predicate(scope))
    return chosen if scope.include_subagents else chosen.join(corpus.subagents(), "session_id", "left_anti")


def user_messages(corpus: Corpus, scope: Scope) -> DataFrame:
    """Clean user messages in scope, joined to their sessions' columns.

    Conditions reach the scans of events and placements before any join.
    """
    events = corpus.events.select("event_id", "ts", "actor", "type", "text").filter("actor = 'user' AND type = 'message' AND length(text) > 0").filter(~X.synthetic(F.col("text")))
    rows = corpus.placements.filter("live = 1").join(events, "event_id").filter(message_predicate(scope))
    rows = rows.join(sessions_in(corpus, scope).select("session_id", "source", "cwd", "title", "hidden_at", "hidden_reason"), "session_id")
    return by_origin(rows, corpus, scope.origin)


def match_session(ident: str) -> Column:
    """Sessions whose id is, or begins with, what was typed, with or without its source."""
    out = X.like(F.col("session_id"), ident + "%")
    for s in SOURCES:
        out = out | X.like(F.col("session_id"), f"{s}:{ident}%")
    return out


def resolve(sessions: DataFrame, ident: str) -> DataFrame:
    """(session_id) of the one session meant: the exact id, else the first that matches; no row if none does."""
    ident = (ident or "").strip()
    found = sessions.filter((F.col("session_id") == ident) | (match_session(ident) if ident else F.lit(False)))
    return found.orderBy(F.col("session_id") != ident, "session_id").limit(1).select("session_id")


class Ambiguous(ValueError):
    """More than one session matches."""


def resolve_unique(sessions: DataFrame, ident: str) -> str | None:
    """The one id that is meant or matches; None if none does."""
    ident = (ident or "").strip()
    found = [r.session_id for r in sessions.filter((F.col("session_id") == ident) | (match_session(ident) if ident else F.lit(False))).select("session_id").orderBy("session_id").limit(21).collect()]
    if ident in found:
        return ident
    if len(found) > 1:
        raise Ambiguous(f"{ident} matches {'20+' if len(found) > 20 else len(found)} sessions: {', '.join(found[:10])}")
    return found[0] if found else None
