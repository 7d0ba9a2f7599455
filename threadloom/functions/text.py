"""Column functions for texts, times and paths, with the matching rules of the model's queries."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Beginnings of user messages that a client wrote itself.
SYNTHETIC = ("<local-command-", "<command-name>", "<task-notification>")
# Fixed value: what looks like a commit, before it must hold a letter.
COMMIT = r"(?<![0-9A-Za-z])([0-9A-Fa-f]{7,40})(?![0-9A-Za-z])"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like(text: Column, pattern: str) -> Column:
    """LIKE without an escape: % and _ are wildcards, ASCII letters match in either case."""
    body = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern)
    return text.rlike(rf"(?is)\A{body}\z")


def contains(text: Column, needle: str) -> Column:
    return like(F.coalesce(text, F.lit("")), f"%{needle}%")


def synthetic(text: Column) -> Column:
    """Whether a browsing query leaves a message out: as it stands, letters in either case."""
    out = F.lit(False)
    for start in SYNTHETIC:
        out = out | like(text, start + "%")
    return out


def synthetic_in_turns(text: Column) -> Column:
    """Whether turns leave a message out: behind leading white space, in exact letters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+", "")
    out = F.lit(False)
    for start in SYNTHETIC:
        out = out | bare.startswith(start)
    return out


def millis(ts: Column) -> Column:
    """Milliseconds of a time written out, or null."""
    return F.unix_millis(F.try_to_timestamp(ts))


def literal_millis(value: str) -> Column:
    return millis(F.lit(value))


def cutoff(value: str | None, now: datetime | None = None) -> str | None:
    """A time, or how long ago in seconds, minutes, hours, days or weeks, as a time."""
    if not value:
        return None
    m = re.fullmatch(r"(\d+)([smhdw])", value.strip())
    if not m:
        return value.strip()
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
    return ((now or datetime.now(UTC)) - timedelta(**{unit: int(m[1])})).strftime("%Y-%m-%dT%H:%M:%SZ")


def preview(text: Column, chars: int) -> Column:
    """White space runs as one blank, cut to so many characters with an ellipsis as the last; 0 gives all as it is."""
    if chars == 0:
        return F.coalesce(text, F.lit(""))
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(F.substring(line, 1, chars - 1), F.lit("…")))


def path_norm(path: Column, home: str = "/root") -> Column:
    p = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    p = F.when((p == "~") | p.startswith("~/"), F.concat(F.lit(home), F.substring(p, 2, 1_000_000))).otherwise(p)
    return F.regexp_replace(p, r"\A(\./)+", "")


def path_bare(path: Column, home: str = "/root") -> Column:
    """Normal, without slashes at its end."""
    return F.regexp_replace(path_norm(path, home), r"/+\z", "")


def path_basename(path: Column, home: str = "/root") -> Column:
    return F.element_at(F.split(path_bare(path, home), "/"), -1)


def path_in(path: Column, cwd: Column, home: str = "/root") -> Column:
    """A relative path under the working directory, another one as it is."""
    full, at = path_bare(path, home), path_bare(cwd, home)
    inner = F.regexp_replace(full, r"\A/+", "")
    return F.when(inner == "", F.lit("")).when(full.startswith("/"), full).when(at == "", inner).otherwise(F.concat(at, F.lit("/"), inner))


def commits(text: Column) -> Column:
    """Commit-like tokens of a text, in lower case, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMMIT), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda x: x.rlike("[A-Fa-f]")), lambda x: F.lower(x)))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and what they are without, by decomposition."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms(text: Column) -> Column:
    """Terms of a text for the index: in lower case, without marks, between all that is no letter or digit."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
