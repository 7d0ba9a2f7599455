"""A store of the canonical tables in generations, refreshed from logs that changed.

Tables lie in buckets by a hash of their key. A refresh writes the buckets that its logs touch, into a new folder, and
then a pointer file that names each table's buckets, those of older generations among them. Nothing that is written is
changed, and the pointer is replaced as a whole, so readers keep what they began with.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import browse, merge, provenance, search
from ..operators.corpus import Corpus
from ..session import durable
from ..sources import control, editor, jsonl, logs

TABLES = {
    "sessions": (schema.SESSIONS, "session_id"), "events": (schema.EVENTS, "event_id"), "placements": (schema.PLACEMENTS, "session_id"), "origins": (schema.ORIGINS, "session_id"),
    "visibility": (schema.VISIBILITY, "session_id"), "state": ("path string, mtime bigint, size bigint, source string, session_id string", "path"),
    "postings": ("term string, event_id string, tf bigint, positions array<int>", "term"), "lengths": ("event_id string, dl int", "event_id"),
}
#: Buckets of each table; those of a store stay as they were when it was begun.
BUCKETS = 64
#: Seconds for which a finished sweep stands for fresh.
FRESH = 600


@dataclass
class Store:
    """Tables below one folder, by the pointer `current`; paths are those of the session's file system."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def _write(self, name: str, text: str) -> None:
        fs, temp = self._fs(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark.sparkContext
        kind = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = context._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        target = fs.makeQualified(self._fs(f"{self.root}/{name}")[1])
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), target, how)

    def _manifest(self) -> dict:
        return json.loads(self._read("current") or json.dumps({"generation": None, "buckets": BUCKETS, "tables": {}}))

    def generation(self) -> str | None:
        return self._manifest()["generation"]

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._manifest()["buckets"])).cast("int")

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table as it is now, or those of its buckets."""
        shape, _ = TABLES[name]
        paths = [f"{self.root}/{p}" for b, p in self._manifest()["tables"].get(name, {}).items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def touched(self, rows: DataFrame, name: str) -> set[int]:
        """Buckets of a table that rows belong to."""
        return {r.b for r in rows.select(self.bucket(TABLES[name][1]).alias("b")).distinct().collect()}

    def corpus(self) -> Corpus:
        sessions = browse.apply_visibility(self.table("sessions"), self.table("visibility"))
        return Corpus(sessions, self.table("events"), self.table("placements"), self.table("origins"))

    def publish(self, changes: dict[str, DataFrame | tuple[DataFrame, set[int]]]) -> str:
        """A new generation: the given tables or buckets of tables, others as they are. Nothing is seen before all is written."""
        made, name = self._manifest(), f"g{time.time_ns():020d}"
        for t, change in changes.items():
            rows, buckets = change if isinstance(change, tuple) else (change, None)
            rows.withColumn("bucket", self.bucket(TABLES[t][1])).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{t}")
            fs, p = self._fs(f"{self.root}/{name}/{t}")
            written = {n.removeprefix("bucket="): f"{name}/{t}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("bucket=")}
            kept = {} if buckets is None else {b: q for b, q in made["tables"].get(t, {}).items() if int(b) not in buckets}
            made["tables"][t] = kept | written
        made["generation"] = name
        self._write("current", json.dumps(made))
        return name

    def refresh_pool(self, pool: str, local: set[str], include_local: bool = False) -> dict[str, int]:
        """Takes in all of a pool's roots but this machine's own, and counts sessions that came from several places."""
        roots, skipped = logs.pool_roots(pool, local, include_local)
        total = {"pool_roots": len(roots), "skipped_local_roots": len(skipped)}
        for machine, source, root in roots:
            got = self.refresh_archive(root) if source == "cursor" else self.refresh(source, root, machine)
            total |= {k: total.get(k, 0) + v for k, v in got.items()}
        places = self.table("state").filter("source <> 'cursor'").select("session_id", F.regexp_extract("path", "raw/([^/]+)/", 1).alias("machine"), "source").withColumnRenamed("source", "root")
        return total | {"duplicate_sessions": merge.duplicate_sessions(places.filter("session_id IS NOT NULL")).count()}

    def refresh(self, source: str, root: str, machine: str | None = None) -> dict[str, int]:
        """Takes in the logs below a root that are new or changed since the last time; the others are not read.

        Sessions of changed logs have their placements replaced. Logs that are gone leave what they gave.
        """
        found = [(p, int(s.st_mtime_ns // 1000), s.st_size) for p in logs.discover(source, root) for s in (os.stat(p),)]
        state = self.table("state")
        listing = self.spark.createDataFrame(found, "path string, mtime bigint, size bigint")
        changed = [r.path for r in merge.changed_files(listing, state).select("path").collect()]
        stats = {"files": len(found), "changed": len(changed), "sessions": 0, "events": 0, "skipped": 0, "errors": 0}
        if not changed:
            return stats
        files = jsonl.files(self.spark, changed)
        parsed = logs.parse(files, source, machine)
        if source == "codex" and os.path.isfile(f"{root}/session_index.jsonl"):
            parsed = logs.titled(parsed, logs.titles(self.spark, root))
        parsed = durable(parsed)
        counts = {r.kind: r["count"] for r in parsed.groupBy("kind").count().collect()}
        stats |= {"sessions": counts.get("session", 0), "events": counts.get("event", 0), "skipped": counts.get("empty", 0), "errors": counts.get("error", 0)}
        sessions, events, placements = logs.canonical(parsed)
        of_events, of_sessions = self.touched(events, "events"), self.touched(sessions, "sessions")
        known = self.table("events", of_events).select(*schema.EVENTS.names).withColumn("batch", F.lit(0))
        both = known.unionByName(events.select(*schema.EVENTS.names).withColumn("batch", F.lit(1)))
        kept = merge.first_identity(both, ["batch"]).filter("kept AND batch = 1").select("event_id")
        merged = merge.merge_events(both, ["batch"]).drop("batch")
        own = parsed.filter("kind = 'session'").select("path", F.get_json_object("body", "$.session_id").alias("session_id"))
        taken = listing.join(own, "path", "left").join(parsed.filter("kind <> 'error'").select("path").distinct(), "path", "left_semi").withColumn("source", F.lit(source))
        of_state = self.touched(taken, "state")
        old = self.table("sessions", of_sessions).join(sessions.select("session_id"), "session_id", "left_anti")
        placed = merge.replace_placements(self.table("placements", of_sessions), placements.join(kept, "event_id", "left_semi").select(*schema.PLACEMENTS.names))
        self.publish({
            "sessions": (old.unionByName(sessions.select(*schema.SESSIONS.names)), of_sessions), "events": (merged.select(*schema.EVENTS.names), of_events), "placements": (placed, of_sessions),
            "state": (self.table("state", of_state).join(taken.select("path"), "path", "left_anti").unionByName(taken.select(*state.columns)), of_state),
        })
        return stats

    def refresh_archive(self, root: str) -> dict[str, int]:
        """Takes in the editor's archived sessions whose best revision ranks above the one accepted last."""
        accepted = self.table("state").filter("source = 'cursor'").selectExpr("session_id", "mtime AS revision", "path AS digest")
        found = durable(merge.advancing(editor.heads(self.spark, root), accepted))
        parsed = durable(editor.parse_heads(found))
        _, events, _ = logs.tables(parsed)
        sessions, _, placements = logs.canonical(parsed)
        ranked = events.join(found.select(F.col("session_id").alias("path"), "revision", F.col("digest").alias("head_digest")), "path")
        ranked = ranked.withColumn("digest", F.sha2("raw", 256)).withColumn("accepted", F.lit(0)).withColumnRenamed("path", "__session")
        of_events, of_sessions = self.touched(events, "events"), self.touched(sessions, "sessions")
        old = self.table("events", of_events)
        mine = old.filter("event_id LIKE 'cursor:%'").withColumn("digest", F.sha2("raw", 256)).withColumn("accepted", F.lit(1)).withColumn("revision", F.lit(0).cast("bigint")).withColumn("head_digest", F.lit("")).withColumn("__session", F.lit(None).cast("string"))
        claims = durable(mine.unionByName(ranked))
        merged = merge.merge_ranked(claims).select(*schema.EVENTS.names)
        refused = durable(merge.ranked_identity(claims).filter("NOT kept").select(F.col("__session").alias("session_id"), "event_id").distinct())
        state = found.selectExpr("digest AS path", "revision AS mtime", "0L AS size", "'cursor' AS source", "session_id")
        ids = sessions.select("session_id")
        if ids.limit(1).count():
            self.publish({
                "sessions": (self.table("sessions", of_sessions).join(ids, "session_id", "left_anti").unionByName(sessions.select(*schema.SESSIONS.names)), of_sessions),
                "events": (old.filter("NOT event_id LIKE 'cursor:%'").unionByName(merged), of_events),
                "placements": (merge.replace_placements(self.table("placements", of_sessions), placements.join(refused, ["session_id", "event_id"], "left_anti").select(*schema.PLACEMENTS.names)), of_sessions),
                "state": self.table("state").join(state.select("session_id", "source"), ["session_id", "source"], "left_anti").unionByName(state).select("path", "mtime", "size", "source", "session_id"),
            })
        return {"heads": found.count(), "sessions": ids.count(), "refused": refused.count()}

    def build_index(self) -> None:
        """Writes the inverted index of all events' texts, postings in buckets by term."""
        postings, lengths = search.index(self.table("events"))
        self.publish({"postings": postings, "lengths": lengths})
        made = self._manifest()
        self._write("current", json.dumps(made | {"indexed": made["tables"]["events"]}))

    def search_tables(self, query: str) -> tuple[DataFrame, DataFrame] | None:
        """The stored index as far as a query needs it; None if events have changed since it was built.

        Only the buckets of the query's terms are read, or all where it asks for beginnings of terms.
        """
        made = self._manifest()
        if "indexed" not in made or made["indexed"] != made["tables"].get("events"):
            return None
        phrases = search.leaves(search.Parser(query).parse())
        terms = sorted({t for p in phrases for t in p.terms})
        own = None if any(p.prefix for p in phrases) or not terms else self.touched(self.spark.createDataFrame([(t,) for t in terms], "term string"), "postings")
        return self.table("postings", own), self.table("lengths")

    def rebuild_origins(self, mux: DataFrame | None = None) -> int:
        """Works out anew who each user message came from: by the editor's flags, agents' tool calls, and a control log.

        mux: submissions of a control log (evidence_id, session_id, sha256, at). What has no verdict is a human's.
        """
        sessions, events, placements = self.table("sessions"), self.table("events"), self.table("placements")
        messages = durable(provenance.user_messages(placements, events))
        evidence = provenance.flag_evidence(placements, events.filter("event_id LIKE 'cursor:%'"), sessions).withColumn("evidence_id", F.col("evidence_id").cast("string"))
        for kind, sent in (("mcp", control.agent_submissions(events)), ("mux", mux)):
            if sent is not None:
                found = provenance.spread(provenance.verdicts(provenance.candidates(sent, messages, provenance.LATE[kind])), placements)
                evidence = evidence.unionByName(found.withColumn("evidence_kind", F.lit(kind)))
        origins = durable(provenance.effective(evidence).select(*schema.ORIGINS.names))
        self.publish({"origins": origins})
        return origins.count()

    def hide(self, sessions: list[str], reason: str | None, now: str) -> None:
        """Hides sessions, or shows them again where no reason is given; all or none of them."""
        rows = [(s, now if reason is not None else None, reason, time.time_ns()) for s in sessions]
        new = self.spark.createDataFrame(rows, schema.VISIBILITY)
        own = self.touched(new, "visibility")
        self.publish({"visibility": (self.table("visibility", own).unionByName(new), own)})

    def mark_fresh(self, now: float | None = None) -> None:
        self._write("sweep", json.dumps({"at": time.time() if now is None else now, "generation": self.generation()}))

    def is_fresh(self, now: float | None = None) -> bool:
        """Whether a sweep ended shortly ago and nothing was published since. A mark from the future doesn't count."""
        mark = json.loads(self._read("sweep") or "null")
        try:
            most = float(os.environ.get("THREADLOOM_MAX_STALENESS", FRESH))
        except ValueError:
            most = 0
        age = (time.time() if now is None else now) - mark["at"] if mark else -1
        return bool(mark) and math.isfinite(most) and 0 <= age < most and mark["generation"] == self.generation()

    def void_mark(self) -> None:
        fs, p = self._fs(f"{self.root}/sweep")
        fs.delete(p, False)


def follow(spark: SparkSession, folder: str, source: str, sink):  # noqa: ANN001, ANN201
    """A stream over new logs in a folder: each batch of them, parsed, goes to `sink(parsed, batch)`.

    The file source takes each file once, as it was; logs that grow are for Store.refresh.
    """
    files = spark.readStream.option("wholetext", "true").format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("value"))
    return files.writeStream.foreachBatch(lambda df, n: sink(logs.parse(df, source), n)).trigger(availableNow=True)
