"""Who a user message came from: control submissions matched to messages one to one, verdicts, and their spread to copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# How long before and after its submission a message may appear, in milliseconds, by kind of control.
EARLY = 5_000
LATE = {"mux": 120_000, "mcp": 6 * 3_600_000}


def launch_index(links: DataFrame) -> DataFrame:
    """(launch_id, session_id) of the launches that lead to one session only."""
    return links.filter("launch_id IS NOT NULL AND session_id IS NOT NULL").groupBy("launch_id").agg(F.countDistinct("session_id").alias("n"), F.min("session_id").alias("session_id")).filter("n = 1").drop("n")


def user_messages(placements: DataFrame, events: DataFrame) -> DataFrame:
    """Live authored user messages with a text: (session_id, event_id, seq, at, sha256), at in milliseconds or null."""
    rows = events.filter("actor = 'user' AND type = 'message' AND length(text) > 0").select("event_id", X.millis(F.col("ts")).alias("at"), F.sha2("text", 256).alias("sha256"))
    return placements.filter("live = 1 AND inherited = 0").select("session_id", "event_id", "seq").join(rows, "event_id")


def candidates(submissions: DataFrame, messages: DataFrame, late: int, early: int = EARLY) -> DataFrame:
    """Pairs (evidence_id, session_id, event_id, delta) of one session and content within the interval.

    A time that can't be read keeps its pair, with a null delta. Session and hash are the join's keys, the interval
    is checked within it.
    """
    s = submissions.select("evidence_id", "session_id", "sha256", F.col("at").alias("sent"))
    pairs = messages.join(s, ["session_id", "sha256"]).withColumn("delta", F.col("at") - F.col("sent"))
    return pairs.filter(F.col("delta").isNull() | F.col("delta").between(-early, late)).select("evidence_id", "session_id", "event_id", "delta")


def verdicts(pairs: DataFrame) -> DataFrame:
    """(session_id, event_id, origin, evidence_id, reason): a pair that is alone on both sides is the control's; others are unknown."""
    per_event, per_submission = W.partitionBy("session_id", "event_id"), W.partitionBy("evidence_id")
    n = pairs.withColumn("subs", F.count("*").over(per_event)).withColumn("msgs", F.count("*").over(per_submission)).withColumn("degraded", F.max(F.col("delta").isNull()).over(per_event))
    one = (F.col("subs") == 1) & (F.col("msgs") == 1) & ~F.col("degraded")
    origin = F.when(one, F.lit("master_control")).otherwise(F.lit("unknown"))
    reason = F.when(one, F.lit("matched")).when(F.col("degraded"), F.lit("time")).otherwise(F.lit("ambiguous"))
    return n.groupBy("session_id", "event_id").agg(F.max(origin).alias("o_max"), F.min(origin).alias("origin"), F.min("evidence_id").alias("evidence_id"), F.min(reason).alias("reason")).drop("o_max")


def spread(found: DataFrame, placements: DataFrame) -> DataFrame:
    """A verdict for every placement of an event that has one, whichever session it was found in."""
    return placements.select("session_id", "event_id").join(found.drop("session_id"), "event_id").distinct()


def effective(evidence: DataFrame) -> DataFrame:
    """One verdict for each placement: the control's before unknown, then by kind, evidence and reason."""
    strength = F.when(F.col("origin") == "master_control", 2).when(F.col("origin") == "unknown", 1).otherwise(0)
    best = F.max(F.struct(strength.alias("strength"), "evidence_kind", "evidence_id", "reason", "origin")).alias("b")
    return evidence.groupBy("session_id", "event_id").agg(best).select("session_id", "event_id", "b.origin", "b.evidence_kind", "b.evidence_id", "b.reason")


def flag_evidence(placements: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Evidence in an editor's own flags on user messages; flags count as booleans and whole numbers alone.

    A sub-agent's first authored user message is the control's where no flag says so of another.
    """
    raw = F.try_parse_json("raw")

    def kind(path: str):
        return F.schema_of_variant(F.try_variant_get(raw, path, "variant"))

    def true(path: str):
        return F.coalesce((kind(path) == "BOOLEAN") & F.try_variant_get(raw, path, "boolean"), F.lit(False))

    def false(path: str):
        return F.coalesce((kind(path) == "BOOLEAN") & ~F.try_variant_get(raw, path, "boolean"), F.lit(False))

    reason_code = F.coalesce(F.when(kind("$.simulatedMsgReason") == "BIGINT", F.try_variant_get(raw, "$.simulatedMsgReason", "bigint")), F.lit(0))
    spawn = F.when(kind("$.subagentSpawnTaskToolCallId") == "STRING", F.trim(F.try_variant_get(raw, "$.subagentSpawnTaskToolCallId", "string")))
    flagged = events.filter("actor = 'user' AND type = 'message'").select(
        "event_id",
        F.when(true("$.isSimulatedMsg"), F.struct(F.lit("master_control").alias("origin"), F.lit("simulated").alias("reason")))
        .when(false("$.isSimulatedMsg") & (reason_code != 0), F.struct(F.lit("unknown").alias("origin"), F.lit("contradictory").alias("reason")))
        .when(true("$.isPlanExecution"), F.struct(F.lit("master_control").alias("origin"), F.lit("plan").alias("reason")))
        .when(F.length(spawn) > 0, F.struct(F.lit("master_control").alias("origin"), F.lit("spawn").alias("reason")))
        .alias("f"),
    )
    rows = placements.filter("inherited = 0").join(flagged, "event_id").join(sessions.select("session_id", "relation"), "session_id")
    first = F.row_number().over(W.partitionBy("session_id").orderBy("seq", "event_id")) == 1
    explicit = F.max(F.coalesce(F.col("f.reason") == "spawn", F.lit(False))).over(W.partitionBy("session_id"))
    rows = rows.withColumn("first", first).withColumn("explicit", explicit)
    kickoff = F.when((F.col("relation") == "subagent") & F.col("first") & ~F.col("explicit"), F.struct(F.lit("master_control").alias("origin"), F.lit("kickoff").alias("reason")))
    rows = rows.withColumn("v", F.coalesce("f", kickoff)).filter("v IS NOT NULL")
    return rows.select("session_id", "event_id", F.lit("flags").alias("evidence_kind"), F.col("event_id").alias("evidence_id"), "v.origin", "v.reason")
