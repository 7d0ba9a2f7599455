"""Operators on small corpora written for the case."""

import json
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import browse, forest, grep, lineage, merge, provenance, refs, search, turns
from threadloom.operators.corpus import Corpus, Scope, resolve

SESSION = "session_id string, source string, machine string, cwd string, repo string, created_at string, started_at string, ended_at string, parent_session_id string, relation string, branch_point_event_id string, title string, hidden_at string, hidden_reason string"
EVENT = "event_id string, ts string, actor string, type string, text string, refs struct<files:array<string>,commands:array<string>>, tool_call_event_id string, raw string"
PLACE = "session_id string, event_id string, seq int, parent_event_id string, live int, inherited int"


def session(sid="pi:S", **more):
    row = dict.fromkeys((c.split()[0] for c in SESSION.split(", "))) | {"session_id": sid, "source": sid.split(":")[0], "cwd": "/work"} | more
    return tuple(row.values())


class Build:
    """Rows of a corpus, an event at a time."""

    def __init__(self):
        self.sessions, self.events, self.places, self.origins = [session()], [], [], []

    def add(self, text, actor="user", kind=None, sid="pi:S", ts=None, live=1, inherited=0, files=(), commands=(), raw=None, eid=None):
        n = sum(p[0] == sid for p in self.places)
        eid = eid or f"{sid}:{n}"
        kind = kind or ("tool_result" if actor == "tool" else "message")
        if not any(e[0] == eid for e in self.events):
            self.events.append((eid, ts or f"2026-01-01T00:{n:02d}:00Z", actor, kind, text, (list(files), list(commands)), None, raw))
        self.places.append((sid, eid, n, None, live, inherited))
        return eid

    def corpus(self, spark):
        make = spark.createDataFrame
        return Corpus(make(self.sessions, SESSION), make(self.events, EVENT), make(self.places, PLACE), make(self.origins, "session_id string, event_id string, origin string"))


@pytest.fixture
def build():
    return Build()


def texts(df):
    return [r.text for r in df.collect()]


# --- browsing --------------------------------------------------------------------------------------------------------


def test_userlog_leaves_out_what_clients_wrote_and_what_is_dead(spark, build):
    for t in ("<COMMAND-NAME>x", "<task-notification>", " <command-name>kept", "", None):
        build.add(t)
    build.add("dead", live=0)
    build.add("copied", inherited=1)
    build.add("real")
    c = build.corpus(spark)
    assert texts(browse.userlog(c)) == ["real", " <command-name>kept"]
    assert texts(browse.userlog(c, Scope(include_inherited=True)))[1] == "copied"
    assert texts(browse.userlog(c, Scope(only_session="pi:S")))[1] == "copied"


def test_recent_ranks_by_clean_user_messages(spark, build):
    build.sessions.append(session("pi:T"))
    build.add("early", ts="2026-01-01T00:00:00Z")
    build.add("late answer", actor="assistant", ts="2026-01-01T09:00:00Z")
    build.add("later", sid="pi:T", ts="2026-01-01T05:00:00Z")
    build.add("same time", sid="pi:T", ts="2026-01-01T05:00:00Z")
    build.add("<command-name>newest", sid="pi:T", ts="2026-01-01T08:00:00Z")
    c = build.corpus(spark)
    rows = browse.recent(c).collect()
    assert [(r.session_id, r.last_user_text, r.user_msg_count, r.live_event_count) for r in rows] == [("pi:T", "same time", 2, 3), ("pi:S", "early", 1, 2)]
    assert browse.recent(c, limit=0).count() == 0 and browse.recent(c, limit=-1).count() == 2


def test_subagents_by_structure_not_wording(spark, build):
    call = {"id": "9", "timestamp": "t", "message": {"content": [{"type": "text"}, {"type": "toolCall", "id": "c", "name": "subagent"}]}}
    build.add("call", actor="assistant", eid="pi:9:t:c", raw=json.dumps(call))
    build.add("you are a subagent")
    build.sessions += [session("pi:K", relation="branch", branch_point_event_id="pi:9:t:c"), session("pi:R", relation="subagent")]
    build.add("kid", sid="pi:K")
    build.add("other", sid="pi:R")
    c = build.corpus(spark)
    assert texts(browse.userlog(c)) == ["you are a subagent"]
    assert set(texts(browse.userlog(c, Scope(include_subagents=True)))) == {"you are a subagent", "kid", "other"}
    assert {r.session_id: r.relation for r in lineage.summary(c).collect()}["pi:K"] == "subagent"


def test_wildcards_fractions_and_relative_times(spark, build):
    build.add("a_b", ts="2026-01-01T00:00:00.001Z")
    build.add("axb", ts="2026-01-01T00:00:00Z")
    build.add("É%", ts="2026-01-01T00:00:01Z")
    c = build.corpus(spark)
    assert set(texts(browse.userlog(c, Scope(query="A_B")))) == {"a_b", "axb"}
    assert texts(browse.userlog(c, Scope(after="2026-01-01T00:00:00.001Z", before="2026-01-01T00:00:01Z"))) == ["a_b"]
    assert texts(browse.userlog(c, Scope(since="nonsense"))) == []
    assert X.cutoff("2d", datetime(2026, 1, 3, tzinfo=UTC)) == "2026-01-01T00:00:00Z" and X.cutoff(" 2026 ") == "2026" and X.cutoff("") is None


def test_resolve_takes_bare_prefixes(spark, build):
    build.sessions += [session("codex:GRAND"), session("pi:GRANDER")]
    c = build.corpus(spark)
    assert resolve(c.sessions, "grand").first().session_id == "codex:GRAND"
    assert resolve(c.sessions, "pi:S").first().session_id == "pi:S" and resolve(c.sessions, " ").count() == 0


# --- turns and references --------------------------------------------------------------------------------------------


def test_turns_and_windows(spark, build):
    build.add("before", actor="assistant")
    build.add("q1")
    build.add("run", actor="assistant", kind="tool_call")
    build.add("out", actor="tool")
    build.add("  <command-name>x")
    build.add("a1", actor="assistant")
    build.add("dead", live=0)
    build.add("q2")
    c = build.corpus(spark)
    got = [(r.turn_index, r.seq_start, r.seq_end, r.user_text, r.hidden_tool_events, [e.preview for e in r["events"]]) for r in turns.build_turns(turns.turn_rows(c)).orderBy("turn_index").collect()]
    assert got == [(0, 0, 0, None, 0, ["before"]), (1, 1, 5, "q1", 2, ["a1"]), (2, 7, 7, "q2", 0, [])]
    built = turns.build_turns(turns.turn_rows(c))
    at = lambda df: sorted(r.turn_index for r in df.collect())
    assert at(turns.window(built, 3, 0)) == [1] and at(turns.window(built, 6, 0)) == [2] and at(turns.window(built, 99, 1)) == [1, 2]
    assert at(turns.window(built, None, limit=-1)) == [0, 1] and at(turns.window(built, None, limit=0)) == [0, 1, 2]
    assert at(turns.nth(built, -1)) == [2] and at(turns.nth(built, 7)) == []
    assert at(turns.window(turns.build_turns(turns.turn_rows(c, include_all=True)), 6, 0)) == [2]


def test_refs_commits_and_hints(spark, build):
    build.add("see abc1234g and 1234567 and ABC1234, abc1234", files=["src/a.py", "src/a.py", "/x"], commands=["git show deadbeef1"])
    found = refs.refs(build.corpus(spark))
    by = {(r.kind, r.value) for r in found.collect()}
    assert by == {("file", "src/a.py"), ("file", "/x"), ("command", "git show deadbeef1"), ("commit", "deadbeef1"), ("commit", "abc1234")}
    assert {r.commit: r["files"] for r in refs.commit_hints(found).collect()} == {"deadbeef1": ["src/a.py"], "abc1234": ["src/a.py"]}


@pytest.mark.parametrize(
    ("file", "query", "cwd", "mode", "hit"),
    [
        ("src/a.py", "/work/src/a.py", "/work", "path", True), ("src/a.py", "/other/src/a.py", "/work", "path", False), ("/deep/src/a.py", "src/a.py", None, "path", True), ("/deep/src/a.py", "a.py", None, "path", False),
        ("./src//a.py", "./src//a.py", None, "path", True), ("~/a", "/root/a", None, "path", True), ("src\\a.py", "src/a.py", None, "path", True), ("src/a.py", "/work/src", "/work", "prefix", True), ("srcs/a.py", "src", None, "prefix", False),
        ("src/a.py", "x/a.py/", None, "basename", True), ("", "", "/work", "path", False),
    ],
)
def test_path_matching(spark, file, query, cwd, mode, hit):
    df = spark.createDataFrame([(file, cwd)], "file string, cwd string")
    assert df.select(refs.path_matches(F.col("file"), query, F.col("cwd"), mode)).first()[0] is hit


def test_touched_shows_dead_rows_on_request(spark, build):
    build.add("please edit a.py")
    build.add("edit", actor="assistant", kind="tool_call", files=["a.py"])
    build.add("undone", actor="assistant", kind="tool_call", files=["a.py"], live=0)
    c = build.corpus(spark)
    (row,) = refs.touched(c, "/work/a.py").collect()
    assert row.nearest.text == "please edit a.py" and row.expand_command == "turns pi:S --around-seq 1"
    rows = refs.touched(c, "/work/a.py", include_all=True).collect()
    assert rows[0].refs_command == "refs pi:S --around-seq 2 --context-turns 0 --all" and len(rows) == 2


# --- lineage ---------------------------------------------------------------------------------------------------------


def test_ancestors_end_at_missing_parents_and_cycles(spark):
    rows = [("a", "b"), ("b", "gone"), ("x", "y"), ("y", "x"), ("z", "z")] + [(f"n{i}", f"n{i + 1}") for i in range(120)]
    got = {}
    for r in lineage.ancestors(spark.createDataFrame(rows, "session_id string, parent_session_id string")).collect():
        got.setdefault(r.session_id, []).append((r.depth, r.ancestor_id, r.missing))
    assert sorted(got["a"]) == [(1, "b", False), (2, "gone", True)] and sorted(got["x"]) == [(1, "y", False)] and "z" not in got
    assert max(got["n0"])[0] == 100


# --- search ----------------------------------------------------------------------------------------------------------


def ranks(spark, rows, query):
    df = spark.createDataFrame(list(enumerate(rows)), "event_id long, text string")
    return {r.event_id: r["rank"] for r in search.ranked(*search.index(df), query).collect()}


def test_rank_constants(spark):
    rows = ["cat dog", "cat cat", "a b", "c d", "e f"]
    got = ranks(spark, rows, "cat")
    assert got[0] == pytest.approx(-math.log(3.5 / 2.5)) and got[1] == pytest.approx(-math.log(3.5 / 2.5) * 1.375)
    assert ranks(spark, rows + [None] * 5, "cat")[0] < got[0]


def test_query_language(spark):
    rows = ["Éclair café", "foo_bar baz", "one two three four five", "two one", "three x one"]
    hits = lambda q: sorted(ranks(spark, rows, q))
    assert hits("eclair") == [0] and hits("caf*") == [0] and hits("bar") == [1] and hits("foo_bar") == [1]
    assert hits('"one two"') == [2] and hits("one + two") == [2] and hits("one two") == [2, 3] and hits("one NOT two") == [4]
    assert hits("NEAR(one three, 1)") == [2, 4] and hits("NEAR(one three, 0)") == [] and hits("^two") == [3] and hits("text:baz") == [1]
    assert hits("(two OR x) AND one") == [2, 3, 4] and hits('"thr"*') == [2, 4] and hits("absent") == []
    for bad in ("file-name", "a AND", '"open', "(a", "col:x", "", "NEAR(a"):
        with pytest.raises(search.QueryError):
            search.Parser(bad).parse()


def test_snippets():
    body = " ".join(f"w{i}" for i in range(30)) + " Café time " + " ".join(f"v{i}" for i in range(30))
    got = search.snippet(body, "cafe time", 4)
    assert "[Café time]" in got and got.startswith("…") and got.endswith("…")
    assert search.snippet("plain", "zz") == "plain" and search.snippet(None, "zz") == ""


def test_search_by_actor_and_origin(spark, build):
    build.add("find me")
    build.origins.append(("pi:S", build.add("find me too"), "master_control"))
    build.add("find me assistant", actor="assistant")
    c = build.corpus(spark)
    assert set(texts(search.search(c, "find"))) == {"find me", "find me assistant"}
    assert set(texts(search.search(c, "find", actor="user"))) == {"find me"}
    assert set(texts(search.search(c, "find", Scope(origin="master-control")))) == {"find me too"}
    assert texts(search.search(c, "find", Scope(origin="unknown"), actor="assistant")) == []
    assert len(texts(search.search(c, "find", Scope(origin="all")))) == 3 and len(texts(search.search(c, "find", limit=1))) == 1


# --- provenance ------------------------------------------------------------------------------------------------------


def test_matching_is_one_to_one_and_spreads(spark, build):
    build.sessions.append(session("pi:T"))
    one = build.add("do it", ts="2026-01-01T00:00:10Z")
    build.add("do it", sid="pi:T", eid=one, inherited=1)
    twice = build.add("again", ts="2026-01-01T00:01:00Z")
    late = build.add("late", ts="2026-01-01T01:00:00Z")
    odd = build.add("odd", ts="no time")
    c = build.corpus(spark)
    sent = spark.createDataFrame([("a", "pi:S", "do it", "2026-01-01T00:00:12Z"), ("b", "pi:S", "again", "2026-01-01T00:00:59Z"), ("c", "pi:S", "again", "2026-01-01T00:00:58Z"), ("d", "pi:S", "late", "2026-01-01T00:00:00Z"), ("e", "pi:S", "odd", "2026-01-01T00:00:00Z")], "evidence_id string, session_id string, t string, ts string")
    sent = sent.select("evidence_id", "session_id", F.sha2("t", 256).alias("sha256"), X.millis(F.col("ts")).alias("at"))
    found = provenance.verdicts(provenance.candidates(sent, provenance.user_messages(c.placements, c.events), provenance.LATE["mux"]))
    got = {r.event_id: r.origin for r in found.collect()}
    assert got == {one: "master_control", twice: "unknown", odd: "unknown"} and late not in got
    assert {r.session_id for r in provenance.spread(found, c.placements).filter(F.col("event_id") == one).collect()} == {"pi:S", "pi:T"}


def test_flags_count_as_flags_alone(spark, build):
    cases = {"true": {"isSimulatedMsg": True}, "text": {"isSimulatedMsg": "true"}, "one": {"isSimulatedMsg": 1}, "reason": {"isSimulatedMsg": False, "simulatedMsgReason": 3}, "zero": {"isSimulatedMsg": False, "simulatedMsgReason": 0}, "plan": {"isPlanExecution": True}, "spawn": {"subagentSpawnTaskToolCallId": " x "}, "blank": {"subagentSpawnTaskToolCallId": " "}}
    ids = {name: build.add(name, raw=json.dumps(raw)) for name, raw in cases.items()}
    build.sessions.append(session("pi:K", relation="subagent"))
    first = build.add("kick", sid="pi:K", raw="{}")
    build.add("more", sid="pi:K", raw="{}")
    c = build.corpus(spark)
    got = {r.event_id: r.origin for r in provenance.flag_evidence(c.placements, c.events, c.sessions).collect()}
    assert got == {ids["true"]: "master_control", ids["reason"]: "unknown", ids["plan"]: "master_control", ids["spawn"]: "master_control", first: "master_control"}


def test_stronger_evidence_counts(spark):
    rows = [("s", "e", "mux", "1", "unknown", "r"), ("s", "e", "mcp", "2", "master_control", "r"), ("s", "f", "mux", "3", "unknown", "r")]
    got = provenance.effective(spark.createDataFrame(rows, "session_id string, event_id string, evidence_kind string, evidence_id string, origin string, reason string"))
    assert {(r.event_id, r.origin) for r in got.collect()} == {("e", "master_control"), ("f", "unknown")}


# --- merging and forests ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_merges_do_not_depend_on_arrival(spark, seed):
    rows = [("e", n, "a", "m", t, o) for n, t, o in ((1, "x", None), (2, "y", "s1"), (3, "x", "s2"), (4, "x", "s3"), (5, "x", None))]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "event_id string, n int, actor string, type string, text string, origin_session_id string").repartition(3)
    (row,) = merge.merge_events(df, ["n"]).collect()
    assert (row.n, row.text, row.origin_session_id) == (5, "x", "s2")
    assert {r.n for r in merge.first_identity(df, ["n"]).filter("kept").collect()} == {1, 3, 5}
    ranked = [("e", "t", *r) for r in ((None, 0, 9, "h", "b"), ("s", 0, 1, "h", "z"), ("s", 0, 2, "h", "y"))] + [("i", "t", None, 0, *r) for r in ((1, "h", "q"), (2, "h", "p"))]
    ranked += [("c", "v", "s", 1, 0, "", "old"), ("c", "u", "s", 0, 5, "h", "new"), ("o", "t", "s", 1, 0, "", "old"), ("o", "t", "x", 0, 3, "h", "a"), ("o", "t", "s", 0, 2, "h", "b"), ("n", "u", None, 0, 2, "h", "b"), ("n", "t", None, 0, 1, "h", "a")]
    random.Random(seed).shuffle(ranked)
    rows = spark.createDataFrame(ranked, "event_id string, ts string, origin_session_id string, accepted int, revision int, head_digest string, digest string").selectExpr("*", "'a' AS actor", "'m' AS type", "cast(NULL AS string) AS tool_call_event_id").repartition(3)
    assert {r.event_id: r.digest for r in merge.merge_ranked(rows).collect()} == {"e": "y", "i": "p", "c": "old", "o": "b", "n": "a"}
    assert {(r.event_id, r.digest) for r in merge.ranked_identity(rows).filter("NOT kept").collect()} == {("c", "new"), ("o", "a"), ("n", "b")}


def test_heads_need_a_revision_and_a_digest(spark):
    a, b = "a" * 64, "b" * 64
    rows = [("s", 1, b), ("s", 2, a), ("t", 0, a), ("t", 1, "A" * 64), ("u", 1, a), ("u", 1, b)]
    df = spark.createDataFrame(rows, "session_id string, revision long, digest string")
    assert {(r.session_id, r.revision, r.digest) for r in merge.heads(df).collect()} == {("s", 2, a), ("u", 1, b)}
    assert merge.advancing(merge.heads(df), merge.heads(df.filter("session_id = 's'"))).count() == 1


def test_bridges_over_long_runs_and_cycles(spark):
    rows = [("s", "r0", None, True)] + [("s", f"r{i}", f"r{i - 1}", False) for i in range(1, 40)] + [("s", "end", "r39", True), ("s", "lost", "gone", True), ("s", "c", "d", False), ("s", "d", "c", False), ("s", "in", "c", True)]
    got = {r.record_id: r.parent_id for r in forest.bridged_parents(spark.createDataFrame(rows, "session_id string, record_id string, parent_id string, emits boolean")).collect()}
    assert got == {"r0": None, "end": "r0", "lost": None, "in": None}


def test_fold_of_rollbacks():
    rows, tip = forest.fold_rollbacks([("event", "p", 0), ("start", "a", 0), ("event", "b", 0), ("start", "c", 0), ("back", None, 2), ("start", "d", 0), ("back", None, 0)])
    assert rows == [("p", None, True), ("a", "p", False), ("b", "a", False), ("c", "b", False), ("d", "p", True)] and tip == "d"
    assert forest.fold_rollbacks([("start", "a", 0), ("back", None, 9)])[1] is None


def test_grep_of_files(spark, tmp_path):
    (tmp_path / "file-history").mkdir()
    (tmp_path / "a.jsonl").write_text("one needle\ntwo\nneedle\n")
    (tmp_path / "file-history" / "b.jsonl").write_text("needle\n")
    rows = grep.lines(spark, [str(tmp_path)])
    assert grep.grep(rows, "needle").count() == 2 and grep.grep(rows, "needle", "files").count() == 1
    assert [r.n for r in grep.grep(rows, "needle", "counts").collect()] == [2]
