"""Lines of raw logs by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: folders that are never searched.
LEFT_OUT = "file-history"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value) of all lines under the paths, without those below a folder that is left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.filter(~F.col("path").rlike(rf"(^|/){LEFT_OUT}(/|$)"))


def grep(rows: DataFrame, pattern: str, mode: str = "lines") -> DataFrame:
    """Matching lines of (path, value), the files that have any, or how many each has."""
    hits = rows.filter(F.col("value").rlike(pattern))
    if mode == "files":
        return hits.select("path").distinct()
    return hits.groupBy("path").agg(F.count("*").alias("n")) if mode == "counts" else hits.select("path", "value")
