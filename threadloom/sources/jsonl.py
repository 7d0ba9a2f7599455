"""Tolerant reading of line-wise JSON logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A file's path as it was asked for: decoded, local ones without their scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, size, value): a row a file, bytes that aren't UTF-8 replaced."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.make_valid_utf8("value").alias("value"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, value) of the lines that hold a JSON object; lines count from 0, blank and broken ones too."""
    lines = files(spark, paths).select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "value"))
    value = F.regexp_replace("value", r"(?U)\A\s+|\s+\z", "")
    shape = F.schema_of_variant(F.try_parse_json(value))
    return lines.withColumn("value", value).filter(F.col("value").startswith("{") & shape.startswith("OBJECT"))


def parse_lines(text: str) -> list[tuple[int, dict]]:
    """Objects of a log with their lines, for readers that take a file as one."""
    found = []
    for line, value in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        value = value.strip()
        if value.startswith("{"):
            try:
                record = json.loads(value)
            except (ValueError, RecursionError):
                continue
            if isinstance(record, dict):
                found.append((line, record))
    return found
