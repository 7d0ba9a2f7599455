"""The canonical model over the test tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import Corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Conversations as sessions: parents, relations, hidden sessions, rolled-back and inherited rows by their numbers."""
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "'conv:' || conv_id AS session_id", "conv_id || ':' || turn AS event_id", "cast(turn AS int) AS seq",
        "date_format(TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int), 0), \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z' AS ts",
        "CASE role WHEN 'system' THEN 'tool' ELSE role END AS actor", "CASE role WHEN 'system' THEN 'tool_result' ELSE 'message' END AS type",
        "CASE WHEN role = 'user' AND (conv_id + turn) % 13 = 4 THEN '<command-name>' || text ELSE text END AS text",
        "CASE WHEN (conv_id + turn) % 11 = 7 THEN 0 ELSE 1 END AS live", "CASE WHEN turn = 0 AND conv_id > 0 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS inherited",
        """named_struct('files', CASE WHEN turn % 4 = 3 THEN array('src/p' || conv_id % 5 || '/f' || (conv_id + turn) % 4 || '.py', '/repo/p' || conv_id % 5 || '/README.md')
             WHEN turn % 2 = 1 THEN array('src/p' || conv_id % 5 || '/f' || (conv_id + turn) % 4 || '.py') ELSE array() END,
           'commands', CASE WHEN turn % 3 = 2 THEN array('git show ' || substr(md5(conv_id || ':' || turn), 1, 10)) ELSE array() END) AS refs""",
    )
    sessions = rows.groupBy("conv_id", "session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).selectExpr(
        "session_id", "element_at(array('claude', 'codex', 'pi', 'cursor'), cast(conv_id % 4 + 1 AS int)) AS source", "'m' || conv_id % 3 AS machine", "'/repo/p' || conv_id % 5 AS cwd",
        "cast(NULL AS string) AS repo", "started_at AS created_at", "started_at", "ended_at",
        "CASE WHEN conv_id > 0 AND conv_id % 3 = 0 THEN 'conv:' || conv_id div 3 END AS parent_session_id",
        "CASE WHEN conv_id > 0 AND conv_id % 9 = 0 THEN 'subagent' WHEN conv_id > 0 AND conv_id % 3 = 0 THEN 'branch' END AS relation",
        "cast(NULL AS string) AS branch_point_event_id", "'Conversation ' || conv_id AS title",
        "CASE WHEN conv_id % 17 = 5 THEN '2026-02-01T00:00:00Z' END AS hidden_at", "CASE WHEN conv_id % 17 = 5 THEN 'old' END AS hidden_reason",
    )
    events = rows.selectExpr("event_id", "ts", "actor", "type", "text", "refs", "cast(NULL AS string) AS tool_call_event_id", "cast(NULL AS string) AS raw")
    placements = rows.selectExpr("session_id", "event_id", "seq", "CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_event_id", "live", "inherited")
    origins = rows.filter("actor = 'user' AND (conv_id * 7 + turn) % 10 < 2").selectExpr("session_id", "event_id", "CASE WHEN (conv_id * 7 + turn) % 10 = 0 THEN 'master_control' ELSE 'unknown' END AS origin")
    return Corpus(sessions, events, placements, origins)


SQL = r"""
WITH ev AS (
  SELECT conv_id, turn, 'conv:' || conv_id AS session_id, conv_id || ':' || turn AS event_id, turn::INTEGER AS seq,
    strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER), '%Y-%m-%dT%H:%M:%SZ') AS ts,
    CASE role WHEN 'system' THEN 'tool' ELSE role END AS actor, CASE role WHEN 'system' THEN 'tool_result' ELSE 'message' END AS type,
    CASE WHEN role = 'user' AND (conv_id + turn) % 13 = 4 THEN '<command-name>' || text ELSE text END AS text,
    CASE WHEN (conv_id + turn) % 11 = 7 THEN 0 ELSE 1 END AS live, CASE WHEN turn = 0 AND conv_id > 0 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS inherited,
    CASE WHEN turn % 4 = 3 THEN ['src/p' || conv_id % 5 || '/f' || (conv_id + turn) % 4 || '.py', '/repo/p' || conv_id % 5 || '/README.md']
      WHEN turn % 2 = 1 THEN ['src/p' || conv_id % 5 || '/f' || (conv_id + turn) % 4 || '.py'] ELSE [] END AS files,
    CASE WHEN turn % 3 = 2 THEN ['git show ' || substr(md5(conv_id || ':' || turn), 1, 10)] ELSE [] END AS commands
  FROM conversations),
ses AS (
  SELECT conv_id, session_id, ['claude', 'codex', 'pi', 'cursor'][conv_id % 4 + 1] AS source, 'm' || conv_id % 3 AS machine, '/repo/p' || conv_id % 5 AS cwd,
    min(ts) AS started_at, max(ts) AS ended_at, CASE WHEN conv_id > 0 AND conv_id % 3 = 0 THEN 'conv:' || conv_id // 3 END AS parent_session_id,
    CASE WHEN conv_id > 0 AND conv_id % 9 = 0 THEN 'subagent' WHEN conv_id > 0 AND conv_id % 3 = 0 THEN 'branch' END AS relation,
    'Conversation ' || conv_id AS title, CASE WHEN conv_id % 17 = 5 THEN '2026-02-01T00:00:00Z' END AS hidden_at, CASE WHEN conv_id % 17 = 5 THEN 'old' END AS hidden_reason
  FROM ev GROUP BY conv_id, session_id),
org AS (SELECT session_id, event_id, CASE WHEN (conv_id * 7 + turn) % 10 = 0 THEN 'master_control' ELSE 'unknown' END AS origin
  FROM ev WHERE actor = 'user' AND (conv_id * 7 + turn) % 10 < 2),
um AS (
  SELECT ev.*, ses.source, ses.cwd, ses.title, ses.hidden_at, ses.hidden_reason, ses.relation, org.origin FROM ev JOIN ses USING (session_id) LEFT JOIN org USING (session_id, event_id)
  WHERE live = 1 AND actor = 'user' AND type = 'message' AND length(text) > 0
    AND NOT (lower(text) LIKE '<local-command-%' OR lower(text) LIKE '<command-name>%' OR lower(text) LIKE '<task-notification>%')),
tr AS (
  SELECT ev.*, origin, sum((actor = 'user')::INTEGER) OVER w AS block FROM ev LEFT JOIN org USING (session_id, event_id)
  WHERE live = 1 AND NOT (actor = 'user' AND starts_with(ltrim(text), '<command-name>')) WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
turns AS (
  SELECT session_id, (block - min(block) OVER (PARTITION BY session_id))::BIGINT AS turn_index, seq, event_id, ts, text, actor, type, origin FROM tr),
tg AS (
  SELECT session_id, turn_index, min(seq) AS seq_start, max(seq) AS seq_end, max(CASE WHEN actor = 'user' THEN seq END) AS user_seq, max(CASE WHEN actor = 'user' THEN ts END) AS ts,
    max(CASE WHEN actor = 'user' THEN text END) AS user_text, max(CASE WHEN actor = 'user' THEN origin END) AS user_origin,
    count(*) FILTER (actor = 'tool') AS hidden_tool_events, count(*) FILTER (actor = 'assistant') AS n_events FROM turns GROUP BY session_id, turn_index)
"""
