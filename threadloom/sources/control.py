"""Submissions by control planes: from a multiplexer's log, and from tool calls between agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import jsonl

# Kinds of the log's entries behind their prefix, and the tools that one agent reaches another by.
SENT, LAUNCHED, FOUND = "send_submitted", "launch_prompt_submitted", "pane_discovered"
REPLY_TOOLS, START_TOOL, INPUT_TOOL = ("codex-reply", "codex_reply"), "codex", "send_input"


def _at(path: str):  # noqa: ANN202
    return F.get_json_object("value", path)


def mux_entries(spark: SparkSession, path: str, session_field: str = "session_id", previous_field: str = "previous") -> DataFrame:
    """The log's entries with what links them: launch ids lie in several places, or with the attempt that is named.

    Kinds are taken without their prefix; the fields that hold a session and a launch's forerunner are the log's own.
    """
    rows = jsonl.records(spark, [path]).select(
        "line", _at("$.event_id").alias("entry_id"), F.element_at(F.split(_at("$.kind"), "[.]"), -1).alias("kind"), _at("$.data.send_id").alias("send_id"), _at(f"$.data.{session_field}").alias("session_id"),
        F.coalesce(_at("$.data.submitted_at"), _at("$.data.attempted_at")).alias("submitted_at"), _at("$.data.payload.sha256").alias("sha256"),
        F.coalesce(_at("$.data.launch_id"), _at("$.data.launch_correlation.launch_id"), _at(f"$.data.{previous_field}.launch_id")).alias("launch_id"), _at("$.data.attempt_event_id").alias("attempt_id"),
    )
    tries = rows.select(F.col("entry_id").alias("attempt_id"), F.col("launch_id").alias("attempt_launch"))
    return rows.join(tries, "attempt_id", "left").withColumn("launch_id", F.coalesce("launch_id", "attempt_launch")).drop("attempt_launch")


def mux_submissions(entries: DataFrame) -> DataFrame:
    """(evidence_id, session_id, sha256, at) of what was sent; launches find their session if it is the only one."""
    from ..operators.provenance import launch_index

    index = launch_index(entries.filter(F.col("kind") == FOUND)).select("launch_id", F.col("session_id").alias("launched"))
    sent = entries.filter(F.col("kind").isin(SENT, LAUNCHED) & F.col("sha256").isNotNull() & F.col("submitted_at").isNotNull()).join(index, "launch_id", "left")
    sent = sent.withColumn("session_id", F.coalesce("session_id", "launched")).filter("session_id IS NOT NULL")
    return sent.select(F.concat_ws(":", "kind", F.coalesce("send_id", "launch_id"), "submitted_at").alias("evidence_id"), "session_id", "sha256", X.millis(F.col("submitted_at")).alias("at")).distinct()


def agent_submissions(events: DataFrame) -> DataFrame:
    """(evidence_id, session_id, sha256, at) of prompts that one agent's tools sent to another, from events' raw records.

    A tool server's call was submitted when it ended, less how long it took.
    """
    get = lambda p: F.get_json_object("raw", p)
    tool = get("$.payload.invocation.tool")
    prompt = F.coalesce(get("$.payload.invocation.arguments.prompt"), get("$.payload.invocation.arguments.message"))
    started = F.coalesce(get("$.payload.result.Ok.structuredContent.threadId"), F.get_json_object(get("$.payload.result.Ok.content[0].text"), "$.threadId"))
    target = F.when(tool.isin(*REPLY_TOOLS), F.coalesce(get("$.payload.invocation.arguments.threadId"), get("$.payload.invocation.arguments.conversationId"))).when(tool == START_TOOL, started)
    took = F.coalesce(get("$.payload.duration.secs").cast("long"), F.lit(0)) * 1000 + F.floor(F.coalesce(get("$.payload.duration.nanos").cast("long"), F.lit(0)) / 1_000_000)
    calls = events.filter(get("$.payload.type") == "mcp_tool_call_end").select("event_id", target.alias("target"), prompt.alias("text"), (X.millis(F.col("ts")) - took).alias("at"))
    args = get("$.payload.arguments")
    inputs = events.filter((get("$.payload.type") == "function_call") & (get("$.payload.name") == INPUT_TOOL)).select(
        "event_id", F.coalesce(F.get_json_object(args, "$.id"), F.get_json_object(args, "$.agent_id"), F.get_json_object(args, "$.target")).alias("target"), F.coalesce(F.get_json_object(args, "$.message"), F.get_json_object(args, "$.prompt")).alias("text"), X.millis(F.col("ts")).alias("at")
    )
    both = calls.unionByName(inputs).filter("target <> '' AND text <> ''")
    session = F.when(F.col("target").startswith("codex:"), F.col("target")).otherwise(F.concat(F.lit("codex:"), "target"))
    return both.select(F.col("event_id").alias("evidence_id"), session.alias("session_id"), F.sha2("text", 256).alias("sha256"), "at")
