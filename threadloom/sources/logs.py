"""From log files to the canonical tables: finding logs, parsing each as one, and merging what they say."""

from __future__ import annotations

import os
import re
import socket
from glob import glob
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import merge
from . import formats, jsonl

# Where each source keeps its logs, below its root.
PLACES = {"claude": ("projects/*/*.jsonl",), "codex": ("sessions/*/*/*/rollout-*.jsonl", "archived_sessions/*.jsonl"), "pi": ("agent/sessions/*/*.jsonl",)}
MACHINE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def discover(source: str, root: str) -> list[str]:
    """Logs of a source below its root on this machine, in order."""
    return sorted(p for place in PLACES[source] for p in glob(f"{glob_safe(root)}/{place}") if os.path.isfile(p))


def glob_safe(root: str) -> str:
    return re.sub(r"([*?[])", r"[\1]", root)


def machine_of(path: str, source: str, given: str | None = None) -> str:
    """The machine that a log came from: as given, by its place in a pool, by the environment, or this one."""
    found = re.search(rf"raw/([^/]+)/{source}(?:/|$)", path)
    return given or (found[1] if found else None) or os.environ.get("THREADLOOM_MACHINE") or socket.gethostname()


def pool_roots(pool: str, local: set[str], include_local: bool = False) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(machine, source, root) of a pool's folders raw/<machine>/<source>, and this machine's own, which are left out."""
    roots, skipped = [], []
    for path in sorted(Path(pool, "raw").glob("*/*")):
        machine, source = path.parent.name, path.name
        if source not in schema.SOURCES or not MACHINE.fullmatch(machine) or path.is_symlink() or path.parent.is_symlink() or not path.is_dir():
            continue
        (skipped.append(str(path)) if machine in local and not include_local else roots.append((machine, source, str(path))))
    return roots, skipped


def titles(spark: SparkSession, root: str) -> DataFrame:
    """(id, title) of a side table session_index.jsonl; a later line replaces an earlier one."""
    rows = jsonl.records(spark, [f"{root}/session_index.jsonl"]).select("line", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.thread_name").alias("title"))
    return rows.filter("id <> '' AND title <> ''").groupBy("id").agg(F.max_by("title", "line").alias("title"))


def titled(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """Parsed logs whose sessions have their names from a side table (id, title)."""
    ids = names.select(F.concat(F.lit("codex:"), "id").alias("sid"), "title")
    rows = parsed.withColumn("sid", F.when(F.col("kind") == "session", F.get_json_object("body", "$.session_id"))).join(ids, "sid", "left")
    named = F.to_json(F.from_json("body", schema.SESSIONS).withField("title", F.col("title")))
    return rows.select("path", "kind", F.when(F.col("title").isNotNull(), named).otherwise(F.col("body")).alias("body"))


def parse(files: DataFrame, source: str, machine: str | None = None) -> DataFrame:
    """(path, kind, body) of the sessions, events and placements in files (path, value); bodies are JSON.

    A log is a task's row and is read as a whole, so nothing moves between executors. A log without any content
    gives one row of kind `empty`, one that breaks its format one of kind `error`.
    """

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for path, value in zip(pdf["path"], pdf["value"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    parsed = formats.FORMATS[source](jsonl.parse_lines(value or ""), name, machine_of(path, source, machine))
                except Exception as e:  # noqa: BLE001  one bad log must not stop the others
                    out.append((path, "error", repr(e)[:500]))
                    continue
                out += [(path, kind, body) for kind, body in parsed.rows()] if parsed else [(path, "empty", "")]
            yield pd.DataFrame(out, columns=["path", "kind", "body"])

    return files.select("path", "value").mapInPandas(run, "path string, kind string, body string")


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, events and placements of parsed logs, with the path that each row came from."""

    def of(kind: str, shape: T.StructType) -> DataFrame:
        return parsed.filter(F.col("kind") == kind).select("path", F.from_json("body", shape).alias("r")).select("path", "r.*")

    return of("session", schema.SESSIONS), of("event", schema.EVENTS), of("placement", schema.PLACEMENTS)


def canonical(parsed: DataFrame, rank: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The canonical tables from parsed logs, whatever order they came in: by source, then path.

    Of one session's logs the last stands for it. An event is what its first log says; placements of rows that say
    otherwise are left out, and so are those of a session's other logs.
    """
    sessions, events, placements = tables(parsed)
    order = F.create_map(*[x for s, n in (rank or {s: n for n, s in enumerate(schema.SOURCES)}).items() for x in (F.lit(s), F.lit(n))])
    at = lambda df, c: df.withColumn("rank", F.coalesce(order[F.split(F.col(c), ":")[0]], F.lit(99)))
    last = merge.latest(at(sessions, "session_id"), "session_id", ["rank", "path"])
    rows = merge.first_identity(at(events, "event_id"), ["rank", "path"])
    merged = merge.merge_events(at(events, "event_id"), ["rank", "path"]).drop("rank", "path")
    kept = rows.filter("kept").select("path", "event_id").distinct()
    of_last = placements.join(last.select("session_id", "path"), ["session_id", "path"], "left_semi")
    return last.drop("rank", "path"), merged, of_last.join(kept, ["path", "event_id"], "left_semi").drop("path")
