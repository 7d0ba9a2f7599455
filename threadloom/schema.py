"""Tables of the canonical model: content (events) apart from placement (where a session shows it), and sessions."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_AGENTS = T.StructType([T.StructField("author", _S), T.StructField("recipient", _S), T.StructField("trigger_turn", T.BooleanType())])
_REFS = T.StructType([T.StructField("files", T.ArrayType(_S)), T.StructField("commands", T.ArrayType(_S)), T.StructField("inter_agent", _AGENTS)])


def _table(text: str) -> T.StructType:
    kinds = {"s": _S, "i": T.IntegerType(), "l": T.LongType(), "r": _REFS}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in text.split())])


SESSIONS = _table("session_id:s source:s machine:s cwd:s repo:s created_at:s started_at:s ended_at:s parent_session_id:s relation:s spawn_event_id:s branch_point_event_id:s tip_event_id:s title:s")
EVENTS = _table("event_id:s origin_session_id:s ts:s actor:s type:s text:s refs:r tool_call_event_id:s raw:s")
PLACEMENTS = _table("session_id:s event_id:s seq:i parent_event_id:s live:i inherited:i")
ORIGINS = _table("session_id:s event_id:s origin:s")
VISIBILITY = _table("session_id:s hidden_at:s hidden_reason:s changed:l")

# The domains of enumerated columns.
SOURCES = ("claude", "codex", "pi", "cursor")
ACTORS = ("user", "assistant", "tool")
TYPES = ("message", "tool_call", "tool_result")
NOT_HUMAN = ("master_control", "unknown")


def ddl() -> str:
    """The tables as SQL text."""
    tables = {"sessions": SESSIONS, "events": EVENTS, "session_events": PLACEMENTS, "event_origins": ORIGINS, "visibility": VISIBILITY}
    return "\n".join(f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in t.fields)});" for name, t in tables.items())
