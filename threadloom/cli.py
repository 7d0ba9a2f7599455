"""Commands over a store: each runs one operator and prints its rows, as text or as JSON."""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema
from .operators import browse, grep, lineage, merge, refs, search, turns
from .operators.corpus import Ambiguous, Scope, resolve, resolve_unique
from .session import local_session
from .sources import control, editor, pool
from .streaming.store import Store


def scoped(p: argparse.ArgumentParser, *names: str) -> None:
    """Adds those of the shared flags that a command knows."""
    kinds = {"source": str, "cwd": str, "since": str, "after": str, "before": str, "exclude-recent": str, "query": str, "only-session": str}
    for n in names:
        if n in kinds:
            p.add_argument(f"--{n}")
        elif n in ("min-chars", "max-chars"):
            p.add_argument(f"--{n}", type=int, default=0)
        elif n == "exclude-session":
            p.add_argument("--exclude-session", action="append", default=[])
        elif n == "origin":
            p.add_argument("--origin", choices=("human", "master-control", "unknown", "all"), default="human")
        else:
            p.add_argument(f"--{n}", action="store_true")


def scope_of(a: argparse.Namespace) -> Scope:
    given = {k: v for k, v in vars(a).items() if k in Scope.__dataclass_fields__ and v not in (None, [])}
    return Scope(**given, exclude_sessions=tuple(getattr(a, "exclude_session", ())))


HIDDEN = ("include-hidden", "only-hidden")
READ = ("source", "cwd", "include-inherited", "include-subagents", *HIDDEN)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    p.add_argument("--store", default="threadloom-store")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, limit: int | None, *flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if limit is not None:
            c.add_argument("--limit", type=int, default=limit)
        scoped(c, *flags)
        return c

    command("recent", 30, *READ, "since", "min-chars", "max-chars", "origin")
    command("userlog", 50, *READ, "since", "query", "min-chars", "max-chars", "origin")
    command("list", 30, *HIDDEN)
    command("hidden", 50, "source", "cwd")
    s = command("search", 20, *READ, "after", "before", "exclude-session", "only-session", "exclude-recent", "origin")
    s.add_argument("text")
    s.add_argument("--actor", choices=schema.ACTORS)
    s.add_argument("--type", choices=schema.TYPES)
    t = command("touched", 50, *READ, "after", "before", "exclude-session", "only-session", "exclude-recent", "all")
    t.add_argument("path")
    mode = t.add_mutually_exclusive_group()
    mode.add_argument("--basename", action="store_true")
    mode.add_argument("--prefix", action="store_true")
    for name in ("turns", "show", "refs", "lineage"):
        c = command(name, 50 if name in ("turns", "lineage") else None, "all")
        c.add_argument("session")
        if name in ("turns", "refs"):
            c.add_argument("--around-seq", type=int)
            c.add_argument("--context-turns", type=int, default=2)
        if name == "turns":
            c.add_argument("--turn", type=int)
            c.add_argument("--user-chars", type=int, default=500)
            c.add_argument("--agent-chars", type=int, default=300)
            c.add_argument("--tool-chars", type=int, default=80)
            c.add_argument("--show-tools", action="store_true")
    for name in ("hide", "unhide"):
        c = command(name, None)
        c.add_argument("sessions", nargs="+")
        if name == "hide":
            c.add_argument("--reason", required=True)
    g = command("grep", None)
    g.add_argument("pattern")
    g.add_argument("paths", nargs="+")
    how = g.add_mutually_exclusive_group()
    how.add_argument("-l", dest="mode", action="store_const", const="files", default="lines")
    how.add_argument("-c", dest="mode", action="store_const", const="counts")
    r = command("refresh", None)
    r.add_argument("source", choices=tuple(s for s in schema.SOURCES if s != "cursor"))
    r.add_argument("root")
    r.add_argument("--machine")
    pooled = command("ingest-pool", None)
    pooled.add_argument("--pool", required=True)
    pooled.add_argument("--local", action="append", default=[])
    pooled.add_argument("--include-local", action="store_true")
    for name in ("collect", "sweep"):
        c = command(name, None)
        c.add_argument("source", choices=tuple(s for s in schema.SOURCES if s != "cursor"))
        c.add_argument("root")
        c.add_argument("--pool", required=True)
        c.add_argument("--machine", required=True)
    b = command("backfill", None)
    b.add_argument("archives", nargs="+")
    b.add_argument("--pool", required=True)
    b.add_argument("--machine", default="backfill")
    b.add_argument("--dry-run", action="store_true")
    o = command("origins", None)
    o.add_argument("--log")
    o.add_argument("--session-field", default="session_id")
    o.add_argument("--previous-field", default="previous")
    x = command("export", None)
    x.add_argument("database")
    x.add_argument("root")
    command("index", None)
    command("schema", None)
    q = command("sql", None)
    q.add_argument("statement")
    return p


def result(a: argparse.Namespace, store: Store) -> DataFrame | dict:
    c = store.corpus()
    if a.command in ("recent", "userlog"):
        return getattr(browse, a.command)(c, scope_of(a), a.limit)
    if a.command == "list":
        return browse.list_sessions(c, scope_of(a), a.limit)
    if a.command == "hidden":
        return browse.hidden_sessions(c, scope_of(a), a.limit)
    if a.command == "search":
        return search.with_snippets(search.search(c, a.text, scope_of(a), a.actor, a.type, a.limit, store.search_tables(a.text)), a.text)
    if a.command == "touched":
        return refs.touched(c, a.path, "basename" if a.basename else "prefix" if a.prefix else "path", scope_of(a), a.all, a.limit)
    if a.command == "grep":
        return grep.grep(grep.lines(store.spark, a.paths), a.pattern, a.mode)
    if a.command == "refresh":
        return store.refresh(a.source, a.root, a.machine)
    if a.command == "ingest-pool":
        return store.refresh_pool(a.pool, set(a.local), a.include_local)
    if a.command in ("collect", "sweep"):
        done = pool.collect(a.source, a.root, a.pool, a.machine)
        if a.command == "sweep":
            store.void_mark()
            done |= store.refresh(a.source, a.root, a.machine)
            store.mark_fresh()
        return done
    if a.command == "backfill":
        best = merge.backfill_winners(pool.candidates(store.spark, a.archives).filter("NOT legacy_subagent"), c.sessions)
        return best.select("session_id", "archive", "name", "decision", "n") if a.dry_run else {"restored": pool.restore(best, a.pool, a.machine)}
    if a.command == "origins":
        sent = control.mux_submissions(control.mux_entries(store.spark, a.log, a.session_field, a.previous_field)) if a.log else None
        return {"origins": store.rebuild_origins(sent)}
    if a.command == "index":
        store.build_index()
        return {"indexed": store.generation()}
    if a.command == "export":
        return editor.export(store.spark, a.database, a.root, {}, time.time()) | store.refresh_archive(a.root)
    if a.command == "sql":
        for name in ("sessions", "events", "placements", "origins"):
            getattr(c, name).createOrReplaceTempView(name)
        c.transcript().createOrReplaceTempView("transcript")
        return store.spark.sql(a.statement)
    if a.command in ("hide", "unhide"):
        found = [resolve_unique(c.sessions, s) for s in a.sessions]
        if None in found:
            raise LookupError(f"no session {a.sessions[found.index(None)]}")
        store.hide(found, getattr(a, "reason", None), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        return {a.command: found}
    own = resolve(c.sessions, a.session)
    if own.count() == 0:
        raise LookupError(f"no session {a.session}")
    if a.command == "show":
        return turns.show(c, own, a.all)
    if a.command == "refs":
        return refs.refs(c, own, a.around_seq, a.context_turns, a.all)
    if a.command == "lineage":
        sid = own.first()[0]
        up = lineage.ancestors(c.sessions, own).select(F.lit("ancestor").alias("kind"), F.col("ancestor_id").alias("session_id"), "depth")
        down = lineage.children(c.sessions, own, a.limit).select(F.lit("child").alias("kind"), "session_id", F.col("nth").alias("depth"))
        beside = lineage.siblings(c.sessions, own, a.limit).select(F.lit("sibling").alias("kind"), F.col("sibling_id").alias("session_id"), F.col("nth").alias("depth"))
        return up.union(down).union(beside).withColumn("of", F.lit(sid))
    built = turns.build_turns(turns.turn_rows(c, own, a.all), a.user_chars, a.agent_chars, a.tool_chars, a.show_tools)
    if a.turn is not None:
        one = turns.nth(built, a.turn)
        if not a.json and one.count() == 0:
            raise LookupError(f"no turn {a.turn}")
        return one
    return turns.window(built, a.around_seq, a.context_turns, a.limit).orderBy("turn_index")


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "turns" and a.turn is not None and a.around_seq is not None:
        p.error("--turn and --around-seq exclude each other")
    if a.command == "schema":
        print(schema.ddl())
        return 0
    try:
        out = result(a, Store(local_session(), a.store))
    except (LookupError, Ambiguous) as e:
        print(e, file=sys.stderr)
        return 1
    except search.QueryError as e:
        print(e, file=sys.stderr)
        return 2
    if isinstance(out, dict):
        print(json.dumps(out))
        return 0
    for r in out.toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str) if a.json else "  ".join(str(v) for v in r if v is not None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
