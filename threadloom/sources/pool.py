"""A pool of logs from several machines, filled by copying, and copies of lost logs out of backups."""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from . import jsonl, logs


def collect(source: str, root: str, pool: str, machine: str) -> dict[str, int]:
    """Copies a source's logs into raw/<machine>/<source> of a pool: new and grown ones; nothing is deleted or cut.

    A log that is shorter than its copy is left alone and counted. A copy is written beside and put in place at once.
    """
    if not logs.MACHINE.fullmatch(machine):
        raise ValueError(f"not a machine's name: {machine!r}")
    stats = dict.fromkeys(("files", "new", "updated", "unchanged", "shrunk", "errors"), 0)
    for path in logs.discover(source, root):
        stats["files"] += 1
        target = Path(pool, "raw", machine, source, os.path.relpath(path, root))
        try:
            now, old = os.stat(path), target.stat() if target.exists() else None
            if old and (old.st_size, int(old.st_mtime)) == (now.st_size, int(now.st_mtime)):
                stats["unchanged"] += 1
            elif old and now.st_size < old.st_size:
                stats["shrunk"] += 1
            else:
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.{os.getpid()}.part")
                shutil.copy2(path, part)
                os.replace(part, target)
                stats["updated" if old else "new"] += 1
        except OSError:
            stats["errors"] += 1
    return stats


def archived(path: str, below: str = ".claude/") -> Iterator[tuple[str, zipfile.ZipInfo]]:
    """Members of a backup that are logs below a folder; links and paths that leave it are passed over."""
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            name = m.filename.replace("\\", "/")
            parts = PurePosixPath(name).parts
            if m.is_dir() or stat.S_ISLNK(m.external_attr >> 16) or ".." in parts or name.startswith("/") or below not in f"/{name}" or not name.endswith(".jsonl"):
                continue
            yield name, m


def candidates(spark: SparkSession, archives: list[str]) -> DataFrame:
    """A row for each log in the backups: its session and what a choice among copies goes by. One member is a task's row."""
    members = [(a, n) for a in archives for n, _ in archived(a)]
    rows = spark.createDataFrame(members, "archive string, name string").repartition(max(1, min(len(members), 200)), "archive", "name")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for a, n in zip(pdf["archive"], pdf["name"], strict=True):
                with zipfile.ZipFile(a) as z:
                    body = z.read(n)
                found = [r for _, r in jsonl.parse_lines(body.decode("utf-8", "replace"))]
                main = [r for r in found if not r.get("isSidechain")]
                ids = sorted({r["uuid"] for r in main if isinstance(r.get("uuid"), str)})
                session = next((r["sessionId"] for r in found if isinstance(r.get("sessionId"), str)), PurePosixPath(n).stem)
                legacy = session != PurePosixPath(n).stem and len(main) < len(found) and not any(r.get("type") in ("user", "assistant") for r in main)
                times = [r["timestamp"] for r in main if isinstance(r.get("timestamp"), str)]
                out.append((a, n, f"claude:{session}", max(times, default=""), len(main), len(ids), len(body), hashlib.sha256(body).hexdigest(), ids, legacy))
            yield pd.DataFrame(out, columns=["archive", "name", "session_id", "max_ts", "records", "uuid_count", "size", "content_sha", "uuids", "legacy_subagent"])

    return rows.mapInPandas(run, "archive string, name string, session_id string, max_ts string, records bigint, uuid_count bigint, size bigint, content_sha string, uuids array<string>, legacy_subagent boolean")


def restore(winners: DataFrame, pool: str, machine: str) -> list[dict]:
    """Writes the chosen copies into a pool and returns what was done; the choice is one row a session."""
    done = []
    for r in winners.select("archive", "name", "session_id", "decision").toLocalIterator():
        target = Path(pool, "raw", machine, "claude", "projects", *PurePosixPath(r["name"]).parts[-2:])
        target.parent.mkdir(parents=True, exist_ok=True)
        if not target.exists():
            with zipfile.ZipFile(r["archive"]) as z, z.open(r["name"]) as f, target.open("wb") as out:
                shutil.copyfileobj(f, out)
        done.append(r.asDict() | {"path": str(target)})
    return done
