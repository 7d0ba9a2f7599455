"""Formats on logs written for the case, and what holds of every parsed log."""

import json
import random

import pytest

from threadloom.sources import formats
from threadloom.sources.jsonl import parse_lines


def log(*records):
    return parse_lines("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def sound(parsed):
    """Ids are unique and named by source, places are a permutation, parents lie within, live ones hang on live ones."""
    items, places = parsed.items, parsed.placements()
    ids = [i.event_id for i in items]
    assert len(set(ids)) == len(ids) and all(i.startswith(parsed.session.source + ":") for i in ids)
    assert sorted(p["seq"] for p in places) == list(range(len(items)))
    by_id = {i.event_id: i for i in items}
    assert all(i.parent is None or i.parent in by_id for i in items)
    assert all(by_id[i.parent].live for i in items if i.live and i.parent)
    tip = parsed.session.tip_event_id
    assert tip is None or by_id[tip].live
    for i in items:
        met, at = set(), i.event_id
        while at:
            assert at not in met
            met.add(at)
            at = by_id[at].parent
    return by_id


def user(uuid, parent, text, ts="2026-01-01T00:00:00Z", **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "sessionId": "S", "cwd": "/w", "timestamp": ts, "message": {"role": "user", "content": text}} | more


def assistant(uuid, parent, *blocks, ts="2026-01-01T00:00:01Z", **more):
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "sessionId": "S", "timestamp": ts, "message": {"role": "assistant", "content": list(blocks)}} | more


def test_claude_tools_branches_and_side_chains():
    use = lambda i, cmd: {"type": "tool_use", "id": i, "name": "Bash", "input": {"command": cmd}}
    result = lambda u, p, i, ts: user(u, p, [{"type": "tool_result", "tool_use_id": i, "content": [{"type": "text", "text": "ok"}]}], ts)
    parsed = formats.claude(
        log(
            user("u1", None, "hi"), "not json", "", assistant("a1", "u1", {"type": "text", "text": "run"}, use("c1", "ls"), use("c2", "pwd")),
            result("r1", "a1", "c1", "2026-01-01T00:00:02Z"), result("r2", "a1", "c2", "2026-01-01T00:00:03Z"), user("s", None, "side", isSidechain=True), user("u1", None, "hi"),
            {"type": "ai-title", "aiTitle": "T", "timestamp": "2026-01-01T00:00:04Z"},
        ), "x.jsonl")
    by_id = sound(parsed)
    assert parsed.session.session_id == "claude:S" and parsed.session.title == "T" and parsed.session.cwd == "/w"
    assert [i.event_id for i in parsed.items] == ["claude:u1", "claude:a1:b0", "claude:a1:c1", "claude:a1:c2", "claude:r1", "claude:r2"]
    assert by_id["claude:a1:c1"].text == "Bash: ls" and by_id["claude:a1:c1"].commands == ["ls"]
    assert by_id["claude:r1"].call_event == "claude:a1:c1" and by_id["claude:r1"].live and by_id["claude:r2"].live
    assert parsed.session.tip_event_id == "claude:r2"


def test_claude_abandoned_branch_is_dead():
    parsed = formats.claude(log(user("u1", None, "a"), assistant("a1", "u1", {"type": "text", "text": "old"}), {"type": "system", "uuid": "x", "parentUuid": "u1"}, assistant("a2", "x", {"type": "text", "text": "new"}, ts="2026-01-01T00:09:00Z")), "S.jsonl")
    by_id = sound(parsed)
    assert not by_id["claude:a1"].live and by_id["claude:a2"].live and by_id["claude:a2"].parent == "claude:u1"


def test_claude_parent_further_on_falls_back():
    parsed = formats.claude(log(user("u1", "a1", "a"), assistant("a1", "u1", {"type": "text", "text": "b"})), "S.jsonl")
    assert [i.parent for i in parsed.items] == [None, "claude:u1"]
    assert formats.claude(log({"type": "summary"}), "S.jsonl") is None


def message(text, kind="user_message", t="event_msg"):
    return {"type": t, "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": kind, "message": text} if t == "event_msg" else {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": text}]}}


def back(n=None):
    return {"type": "event_msg", "payload": {"type": "thread_rolled_back"} | ({} if n is None else {"num_turns": n})}


META = {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "U", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "git": {"branch": "main"}, "forked_from_id": "P", "agent_role": "r"}}


def test_codex_rollbacks():
    whole = formats.codex(log(META, message("q"), message("a", t="response_item"), back(5)), "rollout-x.jsonl")
    sound(whole)
    assert whole.session.tip_event_id is None and not any(i.live for i in whole.items)
    part = formats.codex(log(META, message("q1"), message("a1", t="response_item"), message("q2"), back("x"), message("q3"), back(-1)), "rollout-x.jsonl")
    by_id = sound(part)
    assert [i.live for i in part.items] == [True, True, False, True] and by_id["codex:U:5"].parent == "codex:U:2"
    assert (part.session.relation, part.session.parent_session_id, part.session.repo) == ("subagent", "codex:P", "main")


def test_codex_calls_patches_and_replies():
    call = {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "call_id": "c", "input": "*** Begin\n*** Update File: a.py\n"}}
    end = {"type": "event_msg", "payload": {"type": "patch_apply_end", "call_id": "c", "changes": {"/w/a.py": {}, "a.py": {}}}}
    out = {"type": "response_item", "payload": {"type": "custom_tool_call_output", "call_id": "c", "output": "done"}}
    mcp = lambda c: {"type": "event_msg", "payload": {"type": "mcp_tool_call_end", "call_id": c, "invocation": {"server": "s", "tool": "t"}, "result": {"Ok": {"content": [{"type": "text", "text": "r"}]}}}}
    shell = {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "d", "arguments": json.dumps({"command": ["ls", "-l"]})}}
    parsed = formats.codex(log(META, call, end, out, mcp("c"), shell, mcp("d"), {"type": "response_item", "payload": "drift"}), "r.jsonl")
    sound(parsed)
    assert [i.text for i in parsed.items] == ["apply_patch: a.py", "done", "shell: ls -l", "[mcp s.t]\nr"]
    assert parsed.items[0].files == ["a.py", "/w/a.py"] and parsed.items[2].commands == ["ls -l"]
    assert parsed.items[1].call_event == parsed.items[0].event_id and parsed.items[3].call_event == parsed.items[2].event_id


def test_codex_agents_open_turns():
    meta = {"type": "inter_agent_communication_metadata", "payload": {"trigger_turn": True}}
    said = {"type": "response_item", "payload": {"type": "agent_message", "author": "a", "recipient": "b", "content": []}}
    parsed = formats.codex(log(META, message("q"), meta, said, back(1)), "r.jsonl")
    sound(parsed)
    assert [i.live for i in parsed.items] == [True, False] and parsed.items[1].actor == "assistant"
    assert parsed.items[1].extra["inter_agent"] == {"author": "a", "recipient": "b", "trigger_turn": True}


def pi_message(i, parent, role, *content, ts="2026-01-02T00:00:00Z"):
    return {"type": "message", "id": i, "parentId": parent, "timestamp": ts, "message": {"role": role, "content": list(content)}}


TEXT = {"type": "text", "text": "t"}


def test_pi_copied_beginning_and_subagent():
    call = {"type": "toolCall", "id": "c", "name": "subagent", "arguments": {}}
    old = "2026-01-01T00:00:00Z"
    parsed = formats.pi(
        log({"type": "session", "id": "S", "timestamp": "2026-01-02T00:00:00Z", "cwd": "/w", "parentSession": "/x/1_P.jsonl"}, pi_message("1", None, "user", TEXT, ts=old), pi_message("2", "1", "assistant", TEXT, call, ts=old), {"type": "model", "id": "m", "parentId": "2"}, pi_message("3", "m", "user", TEXT)), "1_S.jsonl"
    )
    by_id = sound(parsed)
    s = parsed.session
    assert (s.session_id, s.parent_session_id, s.relation) == ("pi:S", "pi:P", "subagent")
    assert s.branch_point_event_id == s.spawn_event_id == f"pi:2:{old}:c"
    assert by_id["pi:3:2026-01-02T00:00:00Z"].parent == f"pi:2:{old}:c"
    assert [e["origin_session_id"] for e in parsed.events()] == [None, None, None, "pi:S"]


def test_pi_images_blocks_and_missing_ids():
    lost = {"type": "message", "timestamp": "t", "message": {"role": "user", "content": [TEXT, TEXT]}}
    parsed = formats.pi(log(lost, pi_message("r", "gone", "toolResult", {"type": "image"}), {"type": "message", "message": 3}), "1_Z.jsonl")
    sound(parsed)
    assert [i.event_id for i in parsed.items] == ["pi:L0:t:t0", "pi:L0:t:t1", "pi:r:2026-01-02T00:00:00Z"]
    assert parsed.items[2].text == "[image]" and parsed.items[2].parent is None


def bubble(i, kind, at, **payload):
    return {"bubbleId": i, "type": kind, "createdAt": at, "payload": {"bubbleId": i, "type": kind} | payload}


def snapshot(*order, **session):
    return {"projectionVersion": 1, "composerId": "C", "session": {"composerId": "C", "createdAt": 1767225600000} | session, "order": list(order)}


def test_cursor_bubbles():
    tool = {"name": "read_file_v2", "toolCallId": "c", "params": json.dumps({"targetFile": "a.py"}), "status": "completed", "result": json.dumps({"contents": "x"})}
    parsed = formats.cursor(snapshot(bubble("o/1", 1, 1767225500000, text="old"), bubble("b", 2, 1767225600001, text=" ", toolFormerData=tool), bubble("h", 2, None, text="hidden", isThought=True), name="N", subagentInfo={"parentComposerId": "P"}))
    sound(parsed)
    assert [i.event_id for i in parsed.items] == ["cursor:o%2F1:1767225500000:message", "cursor:b:1767225600001:call", "cursor:b:1767225600001:result"]
    assert [i.text for i in parsed.items] == ["old", "read_file_v2: a.py", "x"] and parsed.items[0].inherited
    assert (parsed.session.relation, parsed.session.title, parsed.session.branch_point_event_id) == ("subagent", "N", parsed.items[0].event_id)


@pytest.mark.parametrize("bad", [{"projectionVersion": True}, {"composerId": "D"}, {"order": [bubble("a", 1, None), bubble("a", 1, None)]}, {"order": [bubble("a", 3, None)]}, {"order": [bubble("a", 1, 1767225600001, text="x"), bubble("b", 1, 1767225500000, text="y")]}])
def test_cursor_fails_closed(bad):
    with pytest.raises(formats.Unreadable):
        formats.cursor(snapshot() | bad)


@pytest.mark.parametrize("seed", range(12))
def test_any_claude_log_is_sound(seed):
    rng = random.Random(seed)
    records = []
    for n in range(30):
        parent = f"n{rng.randrange(0, 34)}" if n else None
        ts = f"2026-01-01T00:{rng.randrange(60):02d}:00Z"
        records.append(rng.choice([user(f"n{n}", parent, "q", ts), assistant(f"n{n}", parent, {"type": "text", "text": "a"}, {"type": "thinking"}, ts=ts), {"type": "system", "uuid": f"n{n}", "parentUuid": parent}]))
    parsed = formats.claude(log(*records), "S.jsonl")
    if parsed:
        sound(parsed)


def test_codex_texts_of_calls_replies_and_agents():
    call = formats.codex_call
    assert call("function_call", "shell", {"arguments": '{"command": ["ls", "-l", 3]}'}).text == "shell: ls -l 3"
    assert call("function_call", "exec_command", {"arguments": {"cmd": "pwd", "command": "x"}}).commands == ["pwd"]
    assert call("function_call", "read", {"arguments": '{"path": "a/b", "n": 1}'}).files == ["a/b"]
    assert call("function_call", "read", {"arguments": "{broken"}).text == "read"
    patch = "*** Begin Patch\n*** Add File: a.py\n+x\n*** Update File: b.py\n*** Delete File: c\n*** Add File: d\n"
    for made in (call("custom_tool_call", "apply_patch", {"input": patch}), call("function_call", "apply_patch", {"arguments": {"input": patch}})):
        assert made.text == "apply_patch: a.py, b.py, c" and made.files == ["a.py", "b.py", "c", "d"]
    assert call("custom_tool_call", "note", {"input": "y" * 200}).text == "note: " + "y" * 160
    assert formats.server_reply({"Ok": {"content": [{"text": "a"}, {"image": 1}, {"text": "b"}]}}) == "a\nb"
    assert formats.server_reply({"Err": "no"}) == '{"Err": "no"}' and formats.server_reply(None) == "" and formats.server_reply("plain") == "plain"
    assert formats.told({"content": [{"text": "go"}, {"text": " on"}]}) == "go on"
    assert formats.told({"content": " ", "author": "a", "recipient": "b"}) == "[inter-agent message: a -> b]" and formats.told({}) == "[inter-agent message]"
    assert [formats.turns_back(x) for x in (None, 0, "x", 3, "2", 2.7, -1, True)] == [1, 1, 1, 3, 2, 2, -1, 1]
