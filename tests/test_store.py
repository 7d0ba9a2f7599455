"""Stores refreshed from logs, the pool, backups, the editor's store and its archive."""

import hashlib
import json
import os
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.test_formats import assistant, user
from threadloom import cli
from threadloom.operators import merge
from threadloom.operators.corpus import Ambiguous, resolve_unique
from threadloom.sources import control, editor, logs, pool
from threadloom.streaming.store import Store, follow


def write(root, name, *records):
    path = root / "projects" / "p" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, records)) + "\n")
    return path


def live(store):
    return {(r.event_id, r.live) for r in store.table("placements").collect()}


def test_refresh_takes_changes_alone(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "logs"
    first = write(root, "S.jsonl", user("u1", None, "hello there"), assistant("a1", "u1", {"type": "text", "text": "old"}))
    write(root, "E.jsonl", {"type": "summary"})
    stats = store.refresh("claude", str(root), "m")
    assert (stats["changed"], stats["sessions"], stats["events"], stats["skipped"]) == (2, 1, 2, 1)
    assert store.refresh("claude", str(root), "m")["changed"] == 0
    before = store.generation()
    write(root, "S.jsonl", user("u1", None, "hello there"), assistant("a1", "u1", {"type": "text", "text": "old"}), assistant("a2", "u1", {"type": "text", "text": "new"}, ts="2026-01-01T01:00:00Z"))
    assert store.refresh("claude", str(root), "m")["changed"] == 1 and store.generation() != before
    assert live(store) == {("claude:u1", 1), ("claude:a1", 0), ("claude:a2", 1)}
    os.remove(first)
    assert store.refresh("claude", str(root), "m")["changed"] == 0 and len(live(store)) == 3
    untouched = store._manifest()["tables"]["events"]
    write(root, "T.jsonl", user("v1", None, "another") | {"sessionId": "T"})
    assert store.refresh("claude", str(root), "m")["changed"] == 1
    assert sum(untouched[b] == p for b, p in store._manifest()["tables"]["events"].items() if b in untouched) >= len(untouched) - 1
    store.hide(["claude:S"], "done", "2026-02-01T00:00:00Z")
    assert {r.session_id: r.hidden_reason for r in store.corpus().sessions.collect()} == {"claude:S": "done", "claude:T": None}
    store.hide(["claude:S"], None, "2026-02-02T00:00:00Z")
    assert {r.hidden_at for r in store.corpus().sessions.collect()} == {None}


def test_fresh_until_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.is_fresh()
    store.publish({})
    store.mark_fresh(1000.0)
    assert store.is_fresh(1500.0) and not store.is_fresh(1600.0) and not store.is_fresh(999.0)
    store.publish({})
    assert not store.is_fresh(1500.0)
    store.mark_fresh(1000.0)
    store.void_mark()
    assert not store.is_fresh(1500.0)


def test_conflicting_copies_and_order(spark, tmp_path):
    root = tmp_path / "logs"
    write(root, "A.jsonl", user("u1", None, "first", sessionId="A"), user("x", "u1", "a"))
    write(root, "B.jsonl", user("u1", None, "other", sessionId="B") | {"sessionId": "B"}, user("y", "u1", "b") | {"sessionId": "B"})
    results = []
    for seed in (1, 2):
        paths = logs.discover("claude", str(root))
        random.Random(seed).shuffle(paths)
        files = spark.createDataFrame([(p, open(p).read()) for p in paths], "path string, value string")
        sessions, events, placements = logs.canonical(logs.parse(files, "claude", "m"))
        results.append((sorted(r.session_id for r in sessions.collect()), sorted((r.event_id, r.text) for r in events.collect()), sorted((r.session_id, r.event_id) for r in placements.collect())))
    assert results[0] == results[1]
    assert ("claude:u1", "first") in results[0][1] and ("claude:B", "claude:u1") not in results[0][2]


def test_stream_of_new_logs(spark, tmp_path):
    write(tmp_path, "S.jsonl", user("u1", None, "hi"))
    seen = []
    query = follow(spark, str(tmp_path / "projects" / "p"), "claude", lambda df, n: seen.extend(r.kind for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert sorted(seen) == ["event", "placement", "session"]


def test_pool_never_shrinks(tmp_path):
    root, target = tmp_path / "logs", tmp_path / "pool"
    path = write(root, "S.jsonl", user("u1", None, "hello"), user("u2", "u1", "more"))
    assert pool.collect("claude", str(root), str(target), "m1")["new"] == 1
    assert pool.collect("claude", str(root), str(target), "m1")["unchanged"] == 1
    path.write_text("{}\n")
    assert pool.collect("claude", str(root), str(target), "m1")["shrunk"] == 1
    roots, skipped = logs.pool_roots(str(target), {"m2"})
    assert [(m, s) for m, s, _ in roots] == [("m1", "claude")] and not skipped
    assert logs.pool_roots(str(target), {"m1"})[0] == []
    assert logs.machine_of(f"{target}/raw/m1/claude/projects/p/S.jsonl", "claude") == "m1"
    with pytest.raises(ValueError):
        pool.collect("claude", str(root), str(target), "../m")


def test_backups(spark, tmp_path):
    rows = [user("u1", None, "a"), user("u2", "u1", "b", ts="2026-01-02T00:00:00Z")]
    archives = []
    for n, records in (("1", rows[:1]), ("2", rows)):
        path = tmp_path / f"{n}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(".claude/projects/p/S.jsonl", "\n".join(map(json.dumps, records)))
            z.writestr("../.claude/projects/p/evil.jsonl", "{}")
        archives.append(str(path))
    best = merge.backfill_winners(pool.candidates(spark, archives), spark.createDataFrame([("claude:other",)], "session_id string"))
    row = best.first()
    assert (row.session_id, row.archive, row.decision) == ("claude:S", archives[1], "uuid-superset")
    done = pool.restore(best, str(tmp_path / "pool"), "m")
    assert len(done) == 1 and open(done[0]["path"]).read().count("\n") == 1


def composer(*bubbles, **more):
    return {"_v": 3, "createdAt": 1767225600000, "conversation": list(bubbles), "modelConfig": "SECRET"} | more


def test_projection_lets_allowed_fields_out_alone():
    b = {"bubbleId": "a", "type": 2, "text": "SECRET", "isThought": True, "createdAt": 1767225600001, "thinking": "SECRET", "toolFormerData": {"name": "t", "toolCallId": "c", "params": {"x": 1}, "blob": "SECRET", "toolIndex": True}}
    made = editor.snapshot("C", composer(b, {"bubbleId": "u", "type": 1, "text": "hi", "timingInfo": {"clientEndTime": 1767225600002}}), {})
    assert "SECRET" not in json.dumps(made) and made["order"][0]["payload"]["toolFormerData"] == {"name": "t", "toolCallId": "c", "params": {"x": 1}}
    assert made["order"][1]["createdAt"] == 1767225600002
    for bad in (composer(b | {"isThought": 1}), composer(b, queueItems=["x"]), composer(b, status="none"), composer(b, _v=14), {"_v": 3}, composer(b, fullConversationHeadersOnly=[])):
        with pytest.raises(editor.Unreadable):
            editor.snapshot("C", bad, {})


def test_archive_of_revisions(spark, tmp_path):
    texts = ["one", "two", "one"]
    previous, parts = None, []
    for n in range(1, 4):
        made = editor.snapshot("C", composer(*[{"bubbleId": str(i), "type": 1, "text": t, "createdAt": 1767225600000 + i} for i, t in enumerate(texts[:n])]), {})
        part = editor.segment(made, previous)
        assert len(part["payloads"]) == 1
        parts.append(part)
        editor.publish(str(tmp_path), part)
        editor.publish(str(tmp_path), part)
        known = (previous or {"payloads": {}})["payloads"] | part["payloads"]
        previous = {"revision": n, "digest": part["snapshotDigest"], "payloads": known}
        assert editor.segment(made, previous) is None
    assert editor.rebuilt(random.sample(parts, 3))["revision"] == 3
    assert editor.rebuilt([parts[0], parts[2]])["revision"] == 1
    broken = json.loads(json.dumps(parts[1]))
    next(iter(broken["payloads"].values()))["text"] = "changed"
    assert editor.rebuilt([parts[0], broken, parts[2]])["revision"] == 1
    row = editor.heads(spark, str(tmp_path)).first()
    assert (row.session_id, row.revision) == ("cursor:C", 3)
    kinds = {r.kind: r["count"] for r in editor.parse_heads(editor.heads(spark, str(tmp_path))).groupBy("kind").count().collect()}
    assert kinds == {"session": 1, "event": 3, "placement": 3}


def test_editor_store_as_a_table(spark, tmp_path):
    path = tmp_path / "s.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
        for i in range(3):
            c.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"bubbleId:C:{i}", json.dumps({"bubbleId": str(i), "type": 1, "text": "x"})))
        c.execute("INSERT INTO cursorDiskKV VALUES ('composerData:C', ?)", (json.dumps({"_v": 3, "fullConversationHeadersOnly": [{"bubbleId": str(i)} for i in range(3)]}),))
        c.execute("INSERT INTO cursorDiskKV VALUES ('composerData:D', ?)", (json.dumps({"_v": 3, "status": "none", "conversation": []}),))
    found = {r.session_id: r for r in editor.snapshots(editor.keys(spark, str(path))).collect()}
    assert len(json.loads(found["C"].snapshot)["order"]) == 3 and found["D"].problem == "draft"


def test_control_log(spark, tmp_path):
    sha = hashlib.sha256(b"do it").hexdigest()
    entries = [
        {"kind": "mux.send_submitted", "event_id": "1", "data": {"send_id": "s1", "session_id": "pi:A", "submitted_at": "2026-01-01T00:00:00Z", "payload": {"sha256": sha}}},
        {"kind": "mux.launch_prompt_submitted", "event_id": "2", "data": {"launch_id": "L", "submitted_at": "2026-01-01T00:00:00Z", "payload": {"sha256": sha}}},
        {"kind": "mux.pane_discovered", "event_id": "3", "data": {"session_id": "pi:B", "previous": {"launch_id": "L"}}},
        {"kind": "mux.send_submitted", "event_id": "4", "data": {"send_id": "s2", "session_id": "pi:A", "payload": {"sha256": sha}}},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, entries)))
    got = control.mux_submissions(control.mux_entries(spark, str(path)))
    assert sorted(r.session_id for r in got.collect()) == ["pi:A", "pi:B"]


def test_agents_prompts(spark):
    raw = {"payload": {"type": "mcp_tool_call_end", "invocation": {"tool": "codex-reply", "arguments": {"threadId": "T", "prompt": "go"}}, "duration": {"secs": 2, "nanos": 0}}}
    events = spark.createDataFrame([("e", "2026-01-01T00:00:10Z", json.dumps(raw))], "event_id string, ts string, raw string")
    row = control.agent_submissions(events).first()
    assert (row.session_id, row.sha256, row["at"]) == ("codex:T", hashlib.sha256(b"go").hexdigest(), 1767225608000)


def test_commands(spark, tmp_path, capsys):
    root = tmp_path / "logs"
    write(root, "S.jsonl", user("u1", None, "find the café"), assistant("a1", "u1", {"type": "text", "text": "here it is"}), user("u2", "a1", "<command-name>x"), user("u3", "u2", "thanks"))
    write(root, "T.jsonl", user("v1", None, "other") | {"sessionId": "S2"})
    at = ["--store", str(tmp_path / "store")]

    def run(*args):
        code = cli.main([*at, "--json", *args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("refresh", "claude", str(root), "--machine", "m")[1][0]["sessions"] == 2
    code, rows = run("userlog")
    assert code == 0 and {r["text"] for r in rows} == {"find the café", "thanks", "other"}
    assert [r["snippet"] for r in run("search", "CAFE")[1]] == ["find the [café]"]
    assert run("index")[0] == 0 and Store(spark, str(tmp_path / "store")).search_tables("cafe") is not None
    assert [r["snippet"] for r in run("search", "caf* OR thanks")[1]] == ["[thanks]", "find the [café]"]
    assert [r["snippet"] for r in run("search", "CAFE")[1]] == ["find the [café]"]
    assert [r["turn_index"] for r in run("turns", "claude:S", "--turn", "-1")[1]] == [1]
    assert run("turns", "claude:S", "--turn", "9")[0] == 0
    assert cli.main([*at, "turns", "claude:S", "--turn", "9"]) == 1
    assert run("show", "nothing")[0] == 1 and run("search", "a-b")[0] == 2
    assert run("hide", "claude:S2", "missing", "--reason", "r")[0] == 1 and len(run("list")[1]) == 2
    assert run("hide", "claude:S2", "--reason", "r")[0] == 0 and len(run("list")[1]) == 1
    assert [r["session_id"] for r in run("hidden")[1]] == ["claude:S2"]
    assert run("sql", "SELECT count(*) AS n FROM transcript")[1] == [{"n": 5}]
    with pytest.raises(SystemExit) as e:
        cli.main([*at, "turns", "S", "--turn", "1", "--around-seq", "2"])
    assert e.value.code == 2
    assert cli.main(["schema"]) == 0 and "CREATE TABLE sessions" in capsys.readouterr().out


def test_ambiguous_prefix(spark):
    sessions = spark.createDataFrame([("pi:ab1",), ("pi:ab2",), ("codex:ab1",)], "session_id string")
    assert resolve_unique(sessions, "pi:ab1") == "pi:ab1" and resolve_unique(sessions, "zz") is None
    with pytest.raises(Ambiguous):
        resolve_unique(sessions, "ab1")
    assert resolve_unique(sessions.filter(F.col("session_id") != "codex:ab1"), "ab1") == "pi:ab1"


def test_export_archive_and_origins(spark, tmp_path):
    path, root = tmp_path / "s.db", tmp_path / "archive"
    store = Store(spark, str(tmp_path / "store"))

    def save(**texts):
        with sqlite3.connect(path) as c:
            c.execute("CREATE TABLE IF NOT EXISTS cursorDiskKV (key TEXT PRIMARY KEY, value TEXT)")
            put = lambda k, v: c.execute("INSERT OR REPLACE INTO cursorDiskKV VALUES (?, ?)", (k, json.dumps(v)))
            put("composerData:P", {"_v": 3, "createdAt": 1767225600000, "fullConversationHeadersOnly": [{"bubbleId": b} for b in texts]})
            for n, (b, t) in enumerate(texts.items()):
                call = {"toolFormerData": {"name": "task", "toolCallId": "k", "additionalData": {"subagentComposerId": "K"}}} if b == "b" else {}
                put(f"bubbleId:P:{b}", {"bubbleId": b, "type": 2 if call else 1, "text": t, "createdAt": 1767225600001 + n, "isSimulatedMsg": b == "c"} | call)
            put("composerData:K", {"_v": 3, "createdAt": 1767225600005, "subagentInfo": {"parentComposerId": "P", "toolCallId": "k"}, "conversation": [{"bubbleId": "x", "type": 1, "text": "do", "createdAt": 1767225600006}]})

    save(a="hi", b="")
    state = {}
    assert editor.export(spark, str(path), str(root), state, 0.0)["published"] == 2
    assert editor.export(spark, str(path), str(root), state, 0.0)["unchanged"] == 2
    assert store.refresh_archive(str(root)) == {"heads": 2, "sessions": 2, "refused": 0}
    assert store.refresh_archive(str(root))["heads"] == 0
    save(a="hi", b="", c="made up")
    assert editor.export(spark, str(path), str(root), state, 0.0)["published"] == 1
    assert store.refresh_archive(str(root))["heads"] == 1 and len(live(store)) == 4
    made = editor.snapshots(editor.keys(spark, str(path))).select("session_id", "snapshot")
    assert [(r.session_id, r.bubble_id) for r in editor.spawns(made).collect()] == [("K", "b")]
    assert json.loads(editor.with_spawns(made).filter("session_id = 'K'").first().snapshot)["session"]["subagentInfo"]["spawnBubbleId"] == "b"
    assert store.rebuild_origins() == 2
    verdicts = {r.event_id.split(":")[1]: r.origin for r in store.table("origins").collect()}
    assert verdicts == {"c": "master_control", "x": "master_control"}
    assert [editor.retry_after("active", n) for n in (1, 2, 9)] == [60, 120, 3600] and editor.retry_after("draft", 1) == 86_400


def test_pool_roots_become_one_store(spark, tmp_path, capsys):
    for m in ("m1", "m2"):
        root = tmp_path / m
        write(root, "S.jsonl", user("u1", None, "hello"))
        assert pool.collect("claude", str(root), str(tmp_path / "pool"), m)["new"] == 1
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "ingest-pool", "--pool", str(tmp_path / "pool"), "--local", "m3"]) == 0
    assert json.loads(capsys.readouterr().out)["duplicate_sessions"] == 1
    assert cli.main([*store, "sweep", "claude", str(tmp_path / "m1"), "--pool", str(tmp_path / "pool"), "--machine", "m1"]) == 0
    assert Store(spark, str(tmp_path / "store")).is_fresh()


def test_titles_of_a_side_table(spark, tmp_path):
    from tests.test_formats import META, message

    log = tmp_path / "sessions" / "2026" / "01" / "01" / "rollout-x.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text("\n".join(map(json.dumps, (META, message("q")))))
    (tmp_path / "session_index.jsonl").write_text("\n".join(map(json.dumps, ({"id": "U", "thread_name": "old"}, {"id": "U", "thread_name": "Named"}))))
    store = Store(spark, str(tmp_path / "store"))
    assert store.refresh("codex", str(tmp_path), "m")["sessions"] == 1
    assert store.corpus().sessions.first().title == "Named"
