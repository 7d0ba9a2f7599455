"""Queries of what leads to the model: logs, merging, forests, provenance, files that changed, raw lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import forest, grep, merge, provenance
from ..sources import editor, logs
from .bridge import SQL as BRIDGE
from .bridge import corpus, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- provenance: purchases as submissions, clicks as messages, users as sessions -------------------------------------

LATE = 6 * 3_600_000
PAIRS = """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS at FROM events), s AS (SELECT * FROM e WHERE event_type = 'purchase'), m AS (SELECT * FROM e WHERE event_type = 'click'),
 p AS (SELECT s.event_id AS evidence_id, 'u' || m.user_id AS session_id, m.event_id AS event_id, m.at - s.at AS delta FROM s JOIN m USING (user_id) WHERE m.at - s.at BETWEEN -5000 AND 21600000),
 n AS (SELECT *, count(*) OVER (PARTITION BY session_id, event_id) AS subs, count(*) OVER (PARTITION BY evidence_id) AS msgs FROM p),
 v AS (SELECT session_id, event_id, CASE WHEN max(subs) = 1 AND max(msgs) = 1 THEN 'master_control' ELSE 'unknown' END AS origin, min(evidence_id) AS evidence_id FROM n GROUP BY ALL)
"""


def control_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("session_id"), F.unix_millis(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("at"), F.lit("x").alias("sha256"))
    sent = rows.filter("event_type = 'purchase'").withColumnRenamed("event_id", "evidence_id")
    return provenance.candidates(sent, rows.filter("event_type = 'click'").drop("event_type"), LATE)


query("provenance_candidates", PAIRS + "SELECT * FROM p")(control_pairs)
query("provenance_verdicts", PAIRS + "SELECT * FROM v")(lambda s, d: provenance.verdicts(control_pairs(s, d)).drop("reason"))
query("provenance_fanout", PAIRS + "SELECT 's' || k AS session_id, event_id, origin, evidence_id FROM v, (VALUES (1), (2)) x(k) WHERE event_id % k = 0")(
    lambda s, d: provenance.spread(
        provenance.verdicts(control_pairs(s, d)).drop("reason"),
        table(s, d, "events").filter("event_type = 'click'").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).filter("event_id % k = 0").select(F.concat(F.lit("s"), "k").alias("session_id"), "event_id"),
    ).select("session_id", "event_id", "origin", "evidence_id")
)
query(
    "provenance_effective",
    """SELECT o_custkey AS session_id, o_orderkey % 50 AS event_id, CASE max(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) WHEN 2 THEN 'master_control' ELSE 'unknown' END AS origin FROM orders GROUP BY ALL""",
)(
    lambda s, d: provenance.effective(
        table(s, d, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 50).alias("event_id"), F.when(F.col("o_orderstatus") == "F", "master_control").otherwise("unknown").alias("origin"), F.col("o_orderpriority").alias("evidence_kind"), F.col("o_orderkey").alias("evidence_id"), F.lit("").alias("reason"))
    ).select("session_id", "event_id", "origin")
)
query("launch_index_unique", "SELECT l_orderkey AS launch_id, min(l_suppkey) AS session_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")(
    lambda s, d: provenance.launch_index(table(s, d, "lineitem").select(F.col("l_orderkey").alias("launch_id"), F.col("l_suppkey").alias("session_id")))
)

# --- merging ---------------------------------------------------------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Documents as claims about 300 events: language and source say what an event is."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") % 300).alias("event_id"), "doc_id", F.col("lang").alias("actor"), F.lit("m").alias("type"), F.lit("t").alias("text"), F.col("n_chars"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).alias("origin_session_id")
    )


CLAIMS = """WITH c AS (SELECT doc_id % 300 AS event_id, doc_id, lang, n_chars, CASE WHEN doc_id % 4 <> 0 THEN 's' || doc_id % 7 END AS o FROM documents),
 a AS (SELECT *, lang = first_value(lang) OVER (PARTITION BY event_id ORDER BY doc_id) AS same FROM c),
 b AS (SELECT *, (SELECT x.o FROM a x WHERE x.event_id = a.event_id AND x.same AND x.o IS NOT NULL ORDER BY doc_id LIMIT 1) AS held FROM a),
 k AS (SELECT *, same AND (o IS NULL OR o = held) AS kept FROM b)
"""
query("merge_first_wins", CLAIMS + "SELECT event_id, lang AS actor, n_chars, held AS origin_session_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY doc_id DESC) AS r FROM k WHERE kept) WHERE r = 1")(
    lambda s, d: merge.merge_events(claims(s, d), ["doc_id"]).select("event_id", "actor", "n_chars", "origin_session_id")
)
query("merge_conflicts", CLAIMS + "SELECT event_id, count(*) AS conflicts FROM k WHERE NOT kept GROUP BY event_id")(lambda s, d: merge.first_identity(claims(s, d), ["doc_id"]).filter("NOT kept").groupBy("event_id").agg(F.count("*").alias("conflicts")))
RANKED = """WITH r AS (SELECT l_partkey AS event_id, CASE WHEN l_orderkey % 11 = 0 THEN 'u' ELSE 't' END AS ts, CASE WHEN l_orderkey % 2 = 1 THEN 's' || l_suppkey % 3 END AS o, (l_linenumber = 1 AND l_orderkey % 5 = 0)::INTEGER AS accepted,
  l_linenumber AS revision, md5(l_orderkey || '-' || l_suppkey) AS h, md5(l_orderkey || '/' || l_linenumber) AS digest FROM lineitem),
 f AS (SELECT event_id, arg_min(ts, (1 - accepted, revision, h, digest)) AS first_ts FROM r GROUP BY ALL), a AS (SELECT *, ts = first_ts AS same FROM r JOIN f USING (event_id)),
 g AS (SELECT event_id, arg_min(o, (1 - accepted, revision, h, digest)) AS held FROM a WHERE same AND o IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, same AND (o IS NULL OR o = held) AS kept FROM a LEFT JOIN g USING (event_id))
"""


def copies(s: SparkSession, d: str) -> DataFrame:
    """Line items as copies of events: some accepted before, some of another time, authored by one of three or inherited."""
    return table(s, d, "lineitem").selectExpr(
        "l_partkey AS event_id", "CASE WHEN l_orderkey % 11 = 0 THEN 'u' ELSE 't' END AS ts", "'a' AS actor", "'m' AS type", "cast(NULL AS string) AS tool_call_event_id", "CASE WHEN l_orderkey % 2 = 1 THEN 's' || l_suppkey % 3 END AS origin_session_id",
        "cast(l_linenumber = 1 AND l_orderkey % 5 = 0 AS int) AS accepted", "l_linenumber AS revision", "md5(l_orderkey || '-' || l_suppkey) AS head_digest", "md5(l_orderkey || '/' || l_linenumber) AS digest",
    )


query(
    "merge_authored_over_inherited",
    RANKED
    + """SELECT event_id, ts, o AS origin_session_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (o IS NOT NULL) DESC, CASE WHEN o IS NOT NULL THEN revision END DESC NULLS LAST,
      CASE WHEN o IS NOT NULL THEN h END DESC NULLS LAST, digest) AS n FROM k WHERE kept) WHERE n = 1""",
)(lambda s, d: merge.merge_ranked(copies(s, d)).select("event_id", "ts", "origin_session_id", "digest"))
query("merge_refused", RANKED + "SELECT event_id, count(*) AS refused FROM k WHERE NOT kept GROUP BY ALL")(lambda s, d: merge.ranked_identity(copies(s, d)).filter("NOT kept").groupBy("event_id").agg(F.count("*").alias("refused")))
HEADS = "SELECT o_custkey AS session_id, year(o_orderdate) AS revision, sha256(o_orderkey::VARCHAR) AS digest FROM orders"


def order_heads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").alias("session_id"), F.year("o_orderdate").alias("revision"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"))


query("head_selection", f"SELECT session_id, max(revision) AS revision, arg_max(digest, (revision, digest)) AS digest FROM ({HEADS}) GROUP BY session_id")(lambda s, d: merge.heads(order_heads(s, d)))
query(
    "head_gate",
    f"WITH h AS ({HEADS}), a AS (SELECT session_id, max((revision, digest)) AS k FROM h WHERE session_id % 2 = 0 AND revision < 1996 GROUP BY ALL) SELECT h.session_id, h.revision, h.digest FROM h LEFT JOIN a USING (session_id) WHERE k IS NULL OR (revision, digest) > k",
)(lambda s, d: merge.advancing(order_heads(s, d), merge.heads(order_heads(s, d).filter("session_id % 2 = 0 AND revision < 1996"))))
query(
    "revision_chain",
    """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS session_id, l_linenumber AS revision FROM lineitem WHERE l_linenumber % 5 <> 4),
    ok AS (SELECT * FROM s WHERE revision = 1 UNION ALL SELECT s.* FROM ok JOIN s ON s.session_id = ok.session_id AND s.revision = ok.revision + 1) SELECT session_id, max(revision) AS revision FROM ok GROUP BY ALL""",
)(
    lambda s, d: merge.complete_revisions(
        table(s, d, "lineitem").filter("l_linenumber % 5 <> 4").selectExpr("l_orderkey AS session_id", "l_linenumber AS revision", "'d' || l_linenumber AS digest", "CASE WHEN l_linenumber > 1 THEN 'd' || (l_linenumber - 1) END AS previous").distinct()
    ).groupBy("session_id").agg(F.max("revision").alias("revision"))
)
PLACED = BRIDGE + ", o AS (SELECT session_id, event_id, seq, live FROM ev), n AS (SELECT session_id, event_id, seq, CASE WHEN conv_id % 4 = 0 THEN 1 ELSE live END AS live FROM ev WHERE conv_id % 2 = 0 AND seq <> 1) "


def placed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, number = corpus(s, d).placements, F.substring("session_id", 6, 20).cast("bigint")
    new = old.filter((number % 2 == 0) & (F.col("seq") != 1)).withColumn("live", F.when(number % 4 == 0, 1).otherwise(F.col("live")))
    return old, new


query("placement_diff", PLACED + "SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN n.event_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.event_id = n.event_id WHERE n.event_id IS NULL OR o.live <> n.live")(
    lambda s, d: merge.placement_changes(*placed(s, d))
)
SQL["placement_diff"] = SQL["placement_diff"].replace("WHERE n.event_id IS NULL OR", "WHERE coalesce(o.session_id, n.session_id) IN (SELECT session_id FROM n) AND (n.event_id IS NULL OR").rstrip() + ")"
query("placement_replace", PLACED + "SELECT session_id, event_id, seq, live FROM n UNION ALL SELECT session_id, event_id, seq, live FROM o WHERE session_id NOT IN (SELECT session_id FROM n)")(lambda s, d: merge.replace_placements(*placed(s, d)).select("session_id", "event_id", "seq", "live"))
query("changed_files", "SELECT p_partkey AS path, p_size::BIGINT AS mtime, length(p_name) AS size FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")(
    lambda s, d: merge.changed_files(
        table(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("bigint").alias("mtime"), F.length("p_name").cast("bigint").alias("size")),
        table(s, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, -1).otherwise(F.col("p_size")).cast("bigint").alias("mtime"), F.length("p_name").cast("bigint").alias("size")),
    )
)
query("duplicate_sessions", "SELECT o_custkey AS session_id, count(DISTINCT o_orderstatus) AS places FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")(
    lambda s, d: merge.duplicate_sessions(table(s, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("machine"), F.lit("r").alias("root")))
)
query(
    "backfill_winner",
    """WITH c AS (SELECT o_custkey AS session_id, o_orderdate AS max_ts, o_orderkey AS name, o_orderkey % 5 AS u FROM orders WHERE o_custkey % 7 <> 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY max_ts DESC, name DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n, count(*) OVER (PARTITION BY session_id, u) AS m FROM c)
    SELECT session_id, name, CASE WHEN n = 1 THEN 'only-candidate' WHEN n = m THEN 'exact-duplicate' ELSE 'latest-structured-timestamp' END AS decision FROM w WHERE r = 1""",
)(
    lambda s, d: merge.backfill_winners(
        table(s, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("max_ts"), F.lit(1).alias("records"), F.lit(1).alias("uuid_count"), F.lit(1).alias("size"), F.lit("a").alias("archive"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 5).alias("content_sha"), F.array((F.col("o_orderkey") % 5).cast("string")).alias("uuids")),
        table(s, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("session_id")),
    ).select("session_id", "name", "decision")
)
query("sha256_identity", "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL")(
    lambda s, d: table(s, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
)

# --- forests ---------------------------------------------------------------------------------------------------------


def records(s: SparkSession, d: str) -> DataFrame:
    """Turns as records that follow each other; every third shows nothing."""
    return table(s, d, "conversations").selectExpr("'c' || conv_id AS session_id", "cast(turn AS string) AS record_id", "CASE WHEN turn > 0 THEN cast(turn - 1 AS string) END AS parent_id", "(conv_id + turn) % 3 <> 1 AS emits")


query("forest_bridged_parent", "SELECT 'c' || a.conv_id AS session_id, a.turn::VARCHAR AS record_id, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND (b.conv_id + b.turn) % 3 <> 1)::VARCHAR AS parent_id FROM conversations a WHERE (a.conv_id + a.turn) % 3 <> 1")(
    lambda s, d: forest.bridged_parents(records(s, d))
)


def tree(s: SparkSession, d: str) -> DataFrame:
    """A binary tree of turns: the parent of turn n is (n - 1) / 2."""
    return table(s, d, "conversations").selectExpr("'c' || conv_id AS session_id", "cast(turn AS string) AS event_id", "CASE WHEN turn > 0 THEN cast((turn - 1) div 2 AS string) END AS parent_id", "turn AS line", "lpad(cast(turn AS string), 4, '0') AS ts")


TREE = "WITH RECURSIVE c AS (SELECT conv_id, turn FROM conversations), l AS (SELECT conv_id, max(turn) AS tip FROM c GROUP BY ALL), up AS (SELECT conv_id, tip AS turn FROM l UNION ALL SELECT conv_id, (turn - 1) // 2 FROM up WHERE turn > 0) "
query("forest_tip", TREE + "SELECT 'c' || conv_id AS session_id, tip::VARCHAR AS tip FROM l")(lambda s, d: forest.tips(tree(s, d)))
query("forest_tip_live", TREE + "SELECT 'c' || conv_id AS session_id, turn::VARCHAR AS event_id FROM up")(lambda s, d: forest.live_events(tree(s, d)))
query("forest_live_pointers", TREE + "SELECT 'c' || conv_id AS session_id, turn::VARCHAR AS event_id FROM up")(lambda s, d: forest.live_by_pointers(tree(s, d)))
query("rollback_stack", None)(
    lambda s, d: forest.rollback_forest(
        table(s, d, "conversations").selectExpr("'c' || conv_id AS session_id", "turn AS line", "CASE WHEN turn % 5 = 4 THEN 'back' WHEN role = 'user' THEN 'start' ELSE 'event' END AS kind", "CASE WHEN turn % 5 <> 4 THEN cast(turn AS string) END AS event_id", "1 AS n")
    )
)

# --- logs made of conversations: a log a conversation, as a format writes it -----------------------------------------


def made_logs(s: SparkSession, d: str, line: str) -> DataFrame:
    rows = table(s, d, "conversations").selectExpr("conv_id", "turn", "role", "text", "'2026-01-01T00:' || lpad(cast(turn AS string), 2, '0') || ':00Z' AS ts").selectExpr("conv_id", "turn", f"{line} AS line")
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return lines.select(F.concat(F.lit("/x/"), "conv_id", F.lit(".jsonl")).alias("path"), F.array_join("l.line", "\n").alias("value"))


LINES = {
    "claude": """to_json(named_struct('type', CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END, 'uuid', conv_id || '-' || turn, 'parentUuid', CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END,
        'sessionId', cast(conv_id AS string), 'cwd', '/w', 'timestamp', ts, 'isSidechain', role = 'system', 'message', named_struct('role', role, 'content', text)))""",
    "codex": """CASE WHEN turn % 7 = 6 THEN '{"type":"event_msg","payload":{"type":"thread_rolled_back","num_turns":1}}'
        WHEN role = 'user' THEN to_json(named_struct('type', 'event_msg', 'timestamp', ts, 'payload', named_struct('type', 'user_message', 'message', text)))
        ELSE to_json(named_struct('type', 'response_item', 'timestamp', ts, 'payload', named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', text))))) END""",
    "pi": """to_json(named_struct('type', 'message', 'id', conv_id || '-' || turn, 'parentId', CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END, 'timestamp', ts,
        'message', named_struct('role', CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END, 'content', array(named_struct('type', 'text', 'text', text)))))""",
}


def adapted(s: SparkSession, d: str, source: str) -> DataFrame:
    _, events, placements = logs.canonical(logs.parse(made_logs(s, d, LINES[source]), source, "m"))
    return placements.join(events, "event_id").select("session_id", "event_id", "seq", "parent_event_id", "live", "actor", "type", "text")


CLAUDE = """WITH c AS (SELECT *, conv_id || '-' || turn AS u FROM conversations WHERE text IS NOT NULL AND role = 'user')
 SELECT 'claude:' || conv_id AS session_id, 'claude:' || u AS event_id, (row_number() OVER w - 1)::INTEGER AS seq, 'claude:' || lag(u) OVER w AS parent_event_id, 1 AS live, 'user' AS actor, 'message' AS type, text FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
query("claude_adapter", CLAUDE)(lambda s, d: adapted(s, d, "claude").filter("actor = 'user'"))
query("pi_adapter", """SELECT 'pi:' || conv_id AS session_id, 'pi:' || conv_id || '-' || turn || ':2026-01-01T00:' || lpad(turn::VARCHAR, 2, '0') || ':00Z' AS event_id, turn::INTEGER AS seq,
  CASE WHEN turn > 0 THEN 'pi:' || conv_id || '-' || (turn - 1) || ':2026-01-01T00:' || lpad((turn - 1)::VARCHAR, 2, '0') || ':00Z' END AS parent_event_id, 1 AS live, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS actor, 'message' AS type, text FROM conversations""")(lambda s, d: adapted(s, d, "pi"))
query("codex_adapter", None)(lambda s, d: adapted(s, d, "codex"))
query("cursor_adapter", None)(lambda s, d: editor.parse_heads(made_snapshots(s, d)).groupBy("kind").count())
query("jsonl_tolerant_scan", "SELECT count(*) AS n, count(DISTINCT conv_id) AS logs FROM conversations")(
    lambda s, d: made_logs(s, d, LINES["pi"]).select("path", F.posexplode(F.split("value", "\n"))).filter(F.schema_of_variant(F.try_parse_json("col")).startswith("OBJECT")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("logs"))
)


def made_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Sessions of an editor's store, made of conversations, by way of its projection."""
    c = table(s, d, "conversations")
    bubbles = c.selectExpr("'bubbleId:' || conv_id || ':' || turn AS key", "to_json(named_struct('bubbleId', cast(turn AS string), 'type', CASE role WHEN 'user' THEN 1 ELSE 2 END, 'text', text, 'createdAt', 1767225600000 + turn * 1000, 'secret', 'x')) AS value")
    heads = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).selectExpr("'composerData:' || conv_id AS key", "to_json(named_struct('_v', 3, 'createdAt', 1767225600000, 'fullConversationHeadersOnly', transform(t, x -> named_struct('bubbleId', cast(x AS string))))) AS value")
    return editor.snapshots(bubbles.union(heads)).filter("snapshot IS NOT NULL").select("session_id", "snapshot")


query("cursor_projection", "SELECT conv_id::VARCHAR AS session_id, count(*) AS bubbles, 0::BIGINT AS leaked FROM conversations GROUP BY ALL")(
    lambda s, d: made_snapshots(s, d).select("session_id", F.size(F.from_json("snapshot", "order array<struct<bubbleId:string>>")["order"]).cast("bigint").alias("bubbles"), F.instr("snapshot", "secret").cast("bigint").alias("leaked"))
)

# --- raw lines -------------------------------------------------------------------------------------------------------


def raw_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.concat(F.lit("/logs/"), "source", F.lit("/"), "doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("value"))


RAW = "SELECT '/logs/' || source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS value FROM documents"
query("grep_lines", f"SELECT path, value FROM ({RAW}) WHERE regexp_matches(value, '[Tt]oken = .[0-9a-f]+')")(lambda s, d: grep.grep(raw_lines(s, d), "[Tt]oken = .[0-9a-f]+"))
query("grep_files", f"SELECT DISTINCT path FROM ({RAW}) WHERE regexp_matches(value, 'License')")(lambda s, d: grep.grep(raw_lines(s, d), "License", "files"))
query("grep_counts", f"SELECT path, count(*) AS n FROM ({RAW}) WHERE regexp_matches(value, '[0-9]{{3}}') GROUP BY path")(lambda s, d: grep.grep(raw_lines(s, d), "[0-9]{3}", "counts"))
query("commit_tokens", "SELECT doc_id, t AS token FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z])([0-9A-Fa-f]{7,40})([^0-9A-Za-z]|$)', 2))) AS t FROM documents) WHERE regexp_matches(t, '[a-f]')")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(X.commits(F.col("text"))).alias("token"))
)
query("path_functions", "SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', ''), '[^/]*$') AS base FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", X.path_basename(F.regexp_replace("url", "[?#].*", "")).alias("base"))
)
