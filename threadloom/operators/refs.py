"""References: files, commands and commits of a session, and who touched a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import turns
from .corpus import Corpus, Scope, message_predicate, sessions_in


def _strings(x: Column) -> Column:
    return F.filter(F.coalesce(x, F.array()), lambda v: v.isNotNull() & (v != ""))


def references(rows: DataFrame) -> DataFrame:
    """(session_id, kind, value, seq, event_id, ...) for each file, command and commit of each row, each once."""
    commands = _strings(F.col("refs.commands"))
    found = F.array_distinct(F.concat(X.commits(F.array_join(commands, "\n")), X.commits(F.col("text"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in (("file", F.array_distinct(_strings(F.col("refs.files")))), ("command", F.array_distinct(commands)), ("commit", found))])
    each = rows.select("session_id", "seq", "event_id", "ts", "actor", "type", X.preview(F.col("text"), 180).alias("preview"), F.explode(kinds).alias("k"))
    return each.select("session_id", "k.kind", F.explode("k.values").alias("value"), "seq", "event_id", "ts", "actor", "type", "preview")


def refs(corpus: Corpus, sessions: DataFrame | None = None, around_seq: int | None = None, context_turns: int = 2, include_all: bool = False) -> DataFrame:
    """A row for each value of a session with its evidence in order; of the turns around a place if one is given."""
    rows = turns.turn_rows(corpus, sessions, include_all)
    if around_seq is not None:
        chosen = turns.window(turns.build_turns(rows), around_seq, context_turns, 0)
        span = chosen.groupBy("session_id").agg(F.min("seq_start").alias("lo"), F.max("seq_end").alias("hi"))
        rows = rows.join(span, "session_id").filter(F.col("seq").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    evidence = F.struct("seq", "event_id", "ts", "actor", "type", "preview")
    out = references(rows).groupBy("session_id", "kind", "value").agg(F.array_sort(F.collect_list(evidence)).alias("events"))
    return out.withColumn("n_events", F.size("events")).withColumn("first_seq", F.col("events")[0]["seq"])


def commit_hints(found: DataFrame, most: int = 3) -> DataFrame:
    """(session_id, commit, files): relative files that share an event with a commit."""
    at = lambda kind, name: found.filter(F.col("kind") == kind).select("session_id", F.col("value").alias(name), F.explode("events.event_id").alias("event_id"))
    files = at("file", "file").filter(~F.col("file").rlike("^[/~]"))
    shared = at("commit", "commit").join(files, ["session_id", "event_id"]).groupBy("session_id", "commit").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return shared.withColumn("files", F.slice("files", 1, most))


def path_matches(file: Column, query: str, cwd: Column, mode: str, home: str = "/root") -> Column:
    """Whether a file is meant by a path: by its last part, as a folder above it, or whole."""
    q = F.lit(query)
    f, bare = X.path_bare(file, home), X.path_bare(q, home)
    if mode == "basename":
        return X.path_basename(file, home) == X.path_basename(q, home)
    under, asked = X.path_in(file, cwd, home), X.path_in(q, cwd, home)
    there = (f != "") & (bare != "")
    anchored = F.coalesce(cwd, F.lit("")) != ""
    if mode == "prefix":
        return there & ((f == bare) | f.startswith(F.concat(bare, F.lit("/"))) | (anchored & ((under == asked) | under.startswith(F.concat(asked, F.lit("/"))))))
    relative = ~X.path_norm(q, home).startswith("/") & F.contains(bare, F.lit("/"))
    return there & ((f == bare) | (anchored & (under == asked)) | (relative & f.endswith(F.concat(F.lit("/"), bare))))


def touched(corpus: Corpus, path: str, mode: str = "path", scope: Scope | None = None, include_all: bool = False, limit: int = 50, home: str = "/root") -> DataFrame:
    """Placements whose structured file references match a path, newest first, with the user message before each.

    Events without matching references are left before the join to placements: by the last part of a path where the
    match implies it.
    """
    scope = scope or Scope(origin="all")
    files = corpus.events.select("event_id", "ts", "actor", "type", "text", F.posexplode(F.array_distinct(_strings(F.col("refs.files")))).alias("at", "file"))
    if mode != "prefix":
        files = files.filter(X.path_basename(F.col("file"), home) == X.path_basename(F.lit(path), home))
    placements = corpus.placements if include_all else corpus.placements.filter("live = 1")
    sessions = sessions_in(corpus, scope).select("session_id", "source", "cwd", "title", "hidden_at", "hidden_reason")
    hits = placements.join(files, "event_id").filter(message_predicate(scope)).join(sessions, "session_id")
    hits = hits.filter(path_matches(F.col("file"), path, F.col("cwd"), mode, home))
    ordered = hits.orderBy(F.desc(X.millis(F.col("ts"))), F.desc("session_id"), F.desc("seq"), "at")
    top = ordered.limit(limit) if limit else ordered
    rows = turns.turn_rows(corpus, top.select("session_id").distinct(), include_all)
    near = turns.nearest_user(rows).select("session_id", "event_id", "nearest")
    suffix = F.when(F.col("live") == 0, F.lit(" --all")).otherwise(F.lit(""))
    call = lambda verb, more: F.concat(F.lit(f"{verb} "), "session_id", F.lit(" --around-seq "), F.col("seq").cast("string"), F.lit(more), suffix)
    return top.join(near, ["session_id", "event_id"], "left").select(
        "ts", "source", "session_id", "seq", "event_id", "cwd", "title", "actor", "type", "live", "inherited", "hidden_at", "hidden_reason", "file", "at",
        X.preview(F.col("text"), 240).alias("preview"), "nearest", call("turns", "").alias("expand_command"), call("refs", " --context-turns 0").alias("refs_command"),
    ).orderBy(F.desc(X.millis(F.col("ts"))), F.desc("session_id"), F.desc("seq"), "at")
