"""Incremental scans: reuse stored results of unchanged files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_of(rules: list[str], sources: list[str]) -> str:
    """Cache version: changes with the detectors' code and with the rules."""
    import hashlib

    return hashlib.sha1("\0".join([*sources, *sorted(rules)]).encode()).hexdigest()


def split_by_cache(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """files with `hit` (same size and time, or else same content hash, under the same version) and the stored
    result; content is hashed only where size or time differ."""
    own = cache.where(F.col("version") == version).select("rel_path", F.col("size_bytes").alias("c_size"), F.col("mtime_ms").alias("c_time"), "content_sha1", "result")
    joined = files.join(own, "rel_path", "left")
    same = (F.col("size_bytes") == F.col("c_size")) & (F.col("mtime_ms") == F.col("c_time"))
    hit = F.coalesce(same, F.lit(False)) | F.coalesce(F.sha1(F.col("content").cast("binary")) == F.col("content_sha1"), F.lit(False))
    return joined.withColumn("hit", hit).withColumn("result", F.when(F.col("hit"), F.col("result"))).drop("c_size", "c_time", "content_sha1")


def next_cache(scanned: DataFrame, version: str) -> DataFrame:
    """The cache after a scan: files seen this time only."""
    return scanned.select("rel_path", "size_bytes", "mtime_ms", F.sha1(F.col("content").cast("binary")).alias("content_sha1"), F.lit(version).alias("version"), "result")
