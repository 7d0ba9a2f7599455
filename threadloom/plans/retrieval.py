"""Queries that read the model: browsing, origins, turns, references, lineage, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browse, lineage, refs, search, turns
from ..operators.corpus import Corpus, Scope, match_session
from .bridge import SQL as BRIDGE
from .bridge import corpus, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a function of a corpus, and the SQL over the bridge's tables that states its result."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(corpus(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = BRIDGE + sql
        return f

    return keep


# --- browsing --------------------------------------------------------------------------------------------------------

LOG = "ts, source, session_id, seq, event_id, cwd, title, hidden_at, hidden_reason, origin, text, length(text) AS chars"
HUMAN, PLAIN, SHOWN, OWN = "origin IS NULL", "coalesce(relation, '') <> 'subagent'", "hidden_at IS NULL", "inherited = 0"
NEWEST = "ORDER BY ts DESC, session_id DESC, seq DESC LIMIT 50"


def log_sql(*conditions: str) -> str:
    return f"SELECT {LOG} FROM um WHERE {' AND '.join(conditions)} {NEWEST}"


for _name, _scope, _where in (
    ("default", {}, (HUMAN, PLAIN, SHOWN, OWN)),
    ("substring", {"query": "The AN"}, (HUMAN, PLAIN, SHOWN, OWN, "lower(text) LIKE '%the an%'")),
    ("length_range", {"min_chars": 40, "max_chars": 200}, (HUMAN, PLAIN, SHOWN, OWN, "length(text) BETWEEN 40 AND 200")),
    ("since", {"since": "2026-01-03T12:00:00Z"}, (HUMAN, PLAIN, SHOWN, OWN, "ts >= '2026-01-03T12:00:00Z'")),
    ("source_cwd", {"source": "pi", "cwd": "REPO/p_"}, (HUMAN, PLAIN, SHOWN, OWN, "source = 'pi' AND lower(cwd) LIKE '%repo/p_%'")),
    ("only_hidden", {"only_hidden": True}, (HUMAN, PLAIN, "hidden_at IS NOT NULL", OWN)),
    ("include_inherited", {"include_inherited": True}, (HUMAN, PLAIN, SHOWN)),
    ("include_subagents", {"include_subagents": True}, (HUMAN, SHOWN, OWN)),
    ("include_hidden", {"include_hidden": True}, (HUMAN, PLAIN, OWN)),
    ("exclude_session", {"exclude_sessions": ("conv:8", "conv:10"), "exclude_recent": "2026-01-05T00:00:00Z"}, (HUMAN, PLAIN, SHOWN, OWN, "session_id NOT IN ('conv:8', 'conv:10') AND ts < '2026-01-05T00:00:00Z'")),
):
    query(f"userlog_{_name}", log_sql(*_where))(lambda c, s=_scope: browse.userlog(c, Scope(**s)))
for _origin, _where in (("human", HUMAN), ("master_control", "origin = 'master_control'"), ("unknown", "origin = 'unknown'"), ("all", "true")):
    query(f"origin_{_origin}", log_sql(_where, PLAIN, SHOWN, OWN))(lambda c, o=_origin: browse.userlog(c, Scope(origin=o)))

query(
    "recent_sessions",
    f"""SELECT ts AS last_user_ts, source, session_id, seq AS last_user_seq, event_id AS last_user_event_id, cwd, title, text AS last_user_text, origin AS last_user_origin, hidden_at, hidden_reason,
    length(text) AS last_user_chars, n AS user_msg_count, (SELECT count(*) FROM ev WHERE ev.session_id = x.session_id AND live = 1) AS live_event_count
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM um WHERE {HUMAN} AND {PLAIN} AND {SHOWN} AND {OWN}) x
    WHERE r = 1 ORDER BY ts DESC, session_id DESC LIMIT 30""",
)(browse.recent)
query("list_sessions", "SELECT started_at, (SELECT count(*) FROM ev WHERE ev.session_id = ses.session_id AND live = 1) AS n, source, session_id, cwd, title, hidden_at FROM ses WHERE hidden_at IS NULL ORDER BY started_at DESC, session_id DESC LIMIT 30")(browse.list_sessions)
query("hidden_sessions", "SELECT session_id, source, machine, cwd, started_at, hidden_at, hidden_reason, title FROM ses WHERE hidden_at IS NOT NULL ORDER BY hidden_at DESC, session_id LIMIT 50")(browse.hidden_sessions)
query("resolve_prefix", "SELECT session_id FROM ses WHERE lower(session_id) LIKE 'conv:1%' ORDER BY session_id")(lambda c: c.sessions.filter(match_session("CONV:1")).select("session_id"))
query("visibility_latest", """, g AS (SELECT session_id, max(seq) AS m FROM ev GROUP BY session_id) SELECT g.session_id, CASE WHEN m % 2 = 1 THEN 'h' || m END AS hidden_at FROM g""")(
    lambda c: browse.apply_visibility(
        c.sessions.select("session_id", "hidden_at", "hidden_reason"),
        c.placements.select("session_id", F.when(F.col("seq") % 2 == 1, F.concat(F.lit("h"), F.col("seq").cast("string"))).alias("hidden_at"), F.lit("r").alias("hidden_reason"), F.col("seq").cast("long").alias("changed")),
    ).select("session_id", "hidden_at")
)

# --- transcripts and turns -------------------------------------------------------------------------------------------

query("transcript_view", "SELECT session_id, event_id, seq, live, inherited, ts, actor, type, text FROM ev")(lambda c: c.transcript().select("session_id", "event_id", "seq", "live", "inherited", "ts", "actor", "type", "text"))
query("show_session", """SELECT session_id, seq, actor, CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 159) || '…' END AS preview, coalesce(commands[1], nullif(array_to_string(files[1:3], ', '), ''), '') AS detail, origin, live = 0 AS rolled_back
   FROM (SELECT ev.*, origin, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ev LEFT JOIN org USING (session_id, event_id) WHERE session_id IN ('conv:3', 'conv:7'))""")(
    lambda c: turns.show(c, c.sessions.filter("session_id IN ('conv:3', 'conv:7')"), True).drop("type")
)
TURN = ["session_id", "turn_index", "seq_start", "seq_end", "ts", "user_seq", "user_text", "user_origin", "hidden_tool_events"]
TURN_SQL = ", ".join(TURN).replace("user_seq", "coalesce(user_seq, -1) AS user_seq")


def flat(df: DataFrame) -> DataFrame:
    return df.select(*TURN, F.size("events").cast("long").alias("n_events")).withColumn("user_seq", F.coalesce("user_seq", F.lit(-1)))


query("turns_build", f"SELECT {TURN_SQL}, n_events FROM tg")(lambda c: flat(turns.build_turns(turns.turn_rows(c))))
query("turns_first", f"SELECT {TURN_SQL}, n_events FROM tg WHERE turn_index < 2")(lambda c: flat(turns.window(turns.build_turns(turns.turn_rows(c)), None, 2, 2)))
query(
    "turns_window",
    f""", k AS (SELECT *, coalesce(min(CASE WHEN 3 BETWEEN seq_start AND seq_end THEN turn_index END) OVER p, min(CASE WHEN seq_start >= 3 THEN turn_index END) OVER p, max(turn_index) OVER p) AS target
    FROM tg WINDOW p AS (PARTITION BY session_id)) SELECT {TURN_SQL}, n_events FROM k WHERE abs(turn_index - target) <= 1""",
)(lambda c: flat(turns.window(turns.build_turns(turns.turn_rows(c)), 3, 1)))
query("turns_last", f", k AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM tg) SELECT {TURN_SQL}, n_events FROM k WHERE turn_index = n - 1")(lambda c: flat(turns.nth(turns.build_turns(turns.turn_rows(c)), -1)))
query("turns_hidden_tools", "SELECT session_id, turn_index, count(*) FILTER (actor <> 'user') AS n_shown FROM turns GROUP BY ALL")(
    lambda c: turns.build_turns(turns.turn_rows(c), show_tools=True).select("session_id", "turn_index", F.size("events").cast("long").alias("n_shown"))
)
query(
    "touched_nearest_user",
    """, r AS (SELECT *, sum((actor = 'user')::INTEGER) OVER w AS n FROM ev WHERE live = 1 WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT * FROM r WHERE actor = 'user' AND NOT starts_with(ltrim(text), '<command-name>'))
    SELECT session_id, seq, coalesce((SELECT max(c.seq) FROM c WHERE c.session_id = r.session_id AND c.seq <= r.seq AND c.n > r.n - 2), -1) AS nearest_seq FROM r""",
)(lambda c: turns.nearest_user(turns.turn_rows(c), 2).select("session_id", "seq", F.coalesce("nearest.seq", F.lit(-1)).alias("nearest_seq")))

# --- references ------------------------------------------------------------------------------------------------------


def one_kind(c: Corpus, kind: str) -> DataFrame:
    return refs.refs(c).filter(F.col("kind") == kind).select("session_id", "value", F.col("n_events").cast("long"), "first_seq")


query("refs_files", "SELECT session_id, value, count(*) AS n_events, min(seq) AS first_seq FROM (SELECT session_id, seq, unnest(files) AS value FROM ev WHERE live = 1) GROUP BY ALL")(lambda c: one_kind(c, "file"))
query("refs_commands", "SELECT session_id, value, count(*) AS n_events, min(seq) AS first_seq FROM (SELECT session_id, seq, unnest(commands) AS value FROM ev WHERE live = 1) GROUP BY ALL")(lambda c: one_kind(c, "command"))
query("refs_commits", """, w AS (SELECT session_id, seq, event_id, unnest(regexp_split_to_array(coalesce(text, '') || chr(10) || array_to_string(commands, chr(10)), '[^0-9A-Za-z]+')) AS v FROM ev WHERE live = 1)
   SELECT session_id, value, count(*) AS n_events, min(seq) AS first_seq FROM (SELECT DISTINCT session_id, seq, event_id, lower(v) AS value FROM w WHERE regexp_full_match(v, '[0-9a-fA-F]{7,40}') AND regexp_matches(v, '[a-fA-F]')) GROUP BY ALL""")(lambda c: one_kind(c, "commit"))
TOUCH = ["ts", "source", "session_id", "seq", "event_id", "cwd", "file", "live"]


def touch_sql(match: str) -> str:
    return f"SELECT ts, source, session_id, seq, event_id, cwd, file, live FROM (SELECT *, unnest(files) AS file FROM ev WHERE live = 1 AND inherited = 0) JOIN (SELECT session_id, source, cwd, hidden_at, relation FROM ses) USING (session_id) WHERE {SHOWN} AND {PLAIN} AND ({match}) ORDER BY ts DESC, session_id DESC, seq DESC, file LIMIT 400"


query("touched_basename", touch_sql("regexp_extract(file, '[^/]*$') = 'f2.py'"))(lambda c: refs.touched(c, "x/f2.py", "basename", limit=400).select(*TOUCH))
query("touched_prefix", touch_sql("file = 'src/p1' OR starts_with(file, 'src/p1/')"))(lambda c: refs.touched(c, "./src/p1/", "prefix", limit=400).select(*TOUCH))
query("touched_path", touch_sql("CASE WHEN starts_with(file, '/') THEN file ELSE cwd || '/' || file END = '/repo/p2/src/p2/f1.py'"))(lambda c: refs.touched(c, "/repo/p2/src/p2/f1.py", limit=400).select(*TOUCH))
query("touched_all", touch_sql("file LIKE '%/README.md'").replace("live = 1 AND ", ""))(lambda c: refs.touched(c, "README.md", "basename", include_all=True, limit=400).select(*TOUCH))

# --- lineage ---------------------------------------------------------------------------------------------------------

query("lineage_ancestors", None)(lambda c: lineage.ancestors(c.sessions).select("session_id", "ancestor_id", F.col("depth").cast("long"), "missing"))
SQL["lineage_ancestors"] = """WITH RECURSIVE s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id > 0 AND conv_id % 3 = 0 THEN conv_id // 3 END AS p FROM conversations),
    up AS (SELECT conv_id, p, 1 AS depth FROM s WHERE p IS NOT NULL UNION ALL SELECT up.conv_id, s.p, depth + 1 FROM up JOIN s ON s.conv_id = up.p WHERE s.p IS NOT NULL)
    SELECT 'conv:' || up.conv_id AS session_id, 'conv:' || up.p AS ancestor_id, depth::BIGINT AS depth, s.conv_id IS NULL AS missing FROM up LEFT JOIN s ON s.conv_id = up.p"""
query("lineage_children", "SELECT parent_session_id, session_id, row_number() OVER (PARTITION BY parent_session_id ORDER BY started_at, session_id) AS nth, count(*) OVER (PARTITION BY parent_session_id) AS total, relation FROM ses WHERE parent_session_id IS NOT NULL")(
    lambda c: lineage.children(c.sessions).select("parent_session_id", "session_id", F.col("nth").cast("long"), "total", "relation")
)
query("lineage_siblings", """, g AS (SELECT session_id, 'g' || conv_id // 4 AS parent_session_id, started_at FROM ses)
   SELECT a.session_id, b.session_id AS sibling_id, row_number() OVER (PARTITION BY a.session_id ORDER BY b.started_at, b.session_id) AS nth, count(*) OVER (PARTITION BY a.session_id) AS total
   FROM g a JOIN g b ON a.parent_session_id = b.parent_session_id AND a.session_id <> b.session_id""")(
    lambda c: lineage.siblings(c.sessions.withColumn("parent_session_id", F.concat(F.lit("g"), F.floor(F.substring("session_id", 6, 20).cast("bigint") / 4).cast("string")))).select("session_id", "sibling_id", F.col("nth").cast("long"), "total")
)
query("lineage_cycle_guard", """SELECT 'conv:' || n AS session_id, 'conv:' || (n + d) % 4 AS ancestor_id, d::BIGINT AS depth, (n + d) % 4 NOT IN (SELECT conv_id FROM conversations) AS missing
   FROM (SELECT DISTINCT conv_id AS n FROM conversations), (VALUES (1), (2), (3), (4)) x(d) WHERE d < 4 OR n >= 4""")(lambda c: lineage.ancestors(c.sessions.withColumn("parent_session_id", F.concat(F.lit("conv:"), ((F.substring("session_id", 6, 20).cast("bigint") + 1) % 4).cast("string")))).select("session_id", "ancestor_id", F.col("depth").cast("long"), "missing"))
query(
    "lineage_summary",
    """, u AS (SELECT session_id, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS r FROM ev WHERE live = 1 AND actor = 'user') WHERE r <= 20 AND NOT starts_with(ltrim(text), '<command-name>'))
    SELECT session_id, relation, max(seq) AS last_user_seq FROM ses LEFT JOIN u USING (session_id) GROUP BY ALL""",
)(lambda c: lineage.summary(c).select("session_id", "relation", "last_user_seq"))

# --- search over documents: a document is an event of its own session -----------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")


TOKENS = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM t)"""


def rank_sql(hit: str, *counts: str) -> str:
    """Ranks of the texts that match; counts: how often a text holds each phrase."""
    tf = ", ".join(f"({c})::DOUBLE AS tf{i}" for i, c in enumerate(counts))
    held = ", ".join(f"(SELECT count(*) FROM c WHERE tf{i} > 0)::DOUBLE AS h{i}" for i in range(len(counts)))
    part = " ".join(f"- greatest(1e-6::DOUBLE, ln((n - h{i} + 0.5::DOUBLE) / (h{i} + 0.5::DOUBLE))) * (tf{i} * 2.2::DOUBLE) / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))" for i in range(len(counts)))
    return f"{TOKENS}, c AS (SELECT doc_id, w, len(w) AS dl, {tf} FROM t), h AS (SELECT {held}) SELECT doc_id, round(0 {part}, 9) AS rank FROM c, h, s WHERE {hit}"


def term_count(t: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{t}'))"


def phrase_count(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(w)), lambda i: w[i] = '{a}' AND w[i + 1] = '{b}'))"


for _name, _q, _hit, _counts in (
    ("term", "sich", "tf0 > 0", [term_count("sich")]),
    ("and", "Que una", "tf0 > 0 AND tf1 > 0", [term_count("que"), term_count("una")]),
    ("or", "sich OR thand", "tf0 > 0 OR tf1 > 0", [term_count("sich"), term_count("thand")]),
    ("not", "the NOT of", "tf0 > 0 AND tf1 = 0", [term_count("the"), term_count("of")]),
    ("prefix", "élle*", "tf0 > 0", ["len(list_filter(w, lambda x: starts_with(x, 'elle')))"]),
    ("phrase", '"of the"', "tf0 > 0", [phrase_count("of", "the")]),
    ("near", "NEAR(sich auf, 3)", "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'sich' AND len(list_filter(range(greatest(1, i - 4), least(len(w), i + 4) + 1), lambda j: w[j] = 'auf')) > 0)) > 0", [term_count("sich"), term_count("auf")]),
    ("grouped", "(que OR des) una", "(tf0 > 0 OR tf1 > 0) AND tf2 > 0", [term_count("que"), term_count("des"), term_count("una")]),
    ("initial", "^the", "w[1] = 'the'", ["(w[1] = 'the')::INTEGER"]),
):
    QUERIES[f"search_{_name}"] = lambda spark, d, q=_q: search.ranked(*search.index(documents(spark, d)), q).select(F.col("event_id").alias("doc_id"), F.round("rank", 9).alias("rank"))
    SQL[f"search_{_name}"] = rank_sql(_hit, *_counts)

MATCH = "FROM ev JOIN ses USING (session_id) LEFT JOIN org USING (session_id, event_id) WHERE live = 1 AND list_contains(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), 'the')"


def hits(df: DataFrame) -> DataFrame:
    return df.select("session_id", "seq", "event_id", "actor", "origin", F.col("text"))


query("search_actor_origin", f"SELECT session_id, seq, event_id, actor, origin, text {MATCH} AND {SHOWN} AND {PLAIN} AND {OWN} AND (actor <> 'user' OR {HUMAN})")(lambda c: hits(search.search(c, "the", limit=-1)))
query("search_master_control", f"SELECT session_id, seq, event_id, actor, origin, text {MATCH} AND {SHOWN} AND {PLAIN} AND {OWN} AND actor = 'user' AND origin = 'master_control'")(lambda c: hits(search.search(c, "the", Scope(origin="master-control"), limit=-1)))
query("search_time_window", f"SELECT session_id, seq, event_id, actor, origin, text {MATCH} AND {SHOWN} AND {PLAIN} AND {OWN} AND actor = 'assistant' AND ts >= '2026-01-02T00:00:00Z' AND ts < '2026-01-03T00:00:00Z'")(
    lambda c: hits(search.search(c, "the", Scope(after="2026-01-02T00:00:00.000Z", before="2026-01-03T00:00:00Z"), actor="assistant", limit=-1))
)
query("search_exclude_session", f"SELECT session_id, seq, event_id, actor, origin, text {MATCH} AND {SHOWN} AND {PLAIN} AND {OWN} AND session_id <> 'conv:4'")(lambda c: hits(search.search(c, "the", Scope(origin="all", exclude_sessions=("conv:4",)), limit=-1)))
query("search_only_session", f"SELECT session_id, seq, event_id, actor, origin, text {MATCH} AND {SHOWN} AND {PLAIN} AND session_id = 'conv:3'")(lambda c: hits(search.search(c, "the", Scope(origin="all", only_session="conv:3"), limit=-1)))
query("search_around", f""", hit AS (SELECT session_id, seq, event_id, ts {MATCH} AND {SHOWN} AND {PLAIN} AND {OWN} AND actor = 'assistant')
    SELECT h.event_id, b.turn_index, b.user_text FROM hit h JOIN tg a ON a.session_id = h.session_id AND h.seq BETWEEN a.seq_start AND a.seq_end JOIN tg b ON b.session_id = a.session_id AND abs(a.turn_index - b.turn_index) <= 1""")(
    lambda c: _around(c)
)
query("search_snippet", None)(lambda c: search.with_snippets(search.search(c, "the OR of", limit=20), "the OR of"))


def _around(c: Corpus) -> DataFrame:
    """Turns beside each hit's own, by one join for all hits."""
    found = search.search(c, "the", Scope(origin="all"), actor="assistant", limit=-1).select("session_id", "seq", "event_id")
    each = turns.build_turns(turns.turn_rows(c, found.select("session_id").distinct())).select("session_id", "turn_index", "seq_start", "seq_end", "user_text")
    own = found.join(each.select("session_id", "seq_start", "seq_end", F.col("turn_index").alias("own")), "session_id").filter(F.col("seq").between(F.col("seq_start"), F.col("seq_end"))).select("session_id", "event_id", "own")
    return own.join(each, "session_id").filter(F.abs(F.col("turn_index") - F.col("own")) <= 1).select("event_id", "turn_index", "user_text")

