"""Snapshot history: append, latest, as-of, consecutive differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders that a log's apps are dealt to: enough to read one app without the others, few enough to keep files large.
BUCKETS = 64


def bucket(app_id: Column | str = "app_id") -> Column:
    return F.pmod(F.xxhash64(app_id), F.lit(BUCKETS)).cast("int")


def append(snapshots: DataFrame, path: str) -> None:
    """Add snapshots to a log whose folders are buckets of apps; runs do not touch what is there."""
    snapshots.withColumn("bucket", bucket()).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema: str, app_id: int | None = None) -> DataFrame:
    """The log's snapshots; those of one app come from its bucket alone."""
    log = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if app_id is not None:
        log = log.where((F.col("bucket") == bucket(F.lit(app_id).cast("long"))) & (F.col("app_id") == app_id))
    return log.drop("bucket")


#: Snapshot files: what they hold, and the time in a file's name, whose colons and points are hyphens there.
SNAPSHOT = (
    "app_id long, scan_id long, scannedAt string, stats struct<files:long,issues:long,routes:long,models:long>, "
    "issues array<struct<file:string,line:int,severity:string,category:string,summary:string>>, _corrupt_record string"
)
NAMED = r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z[^/]*\.json$"


def write_log(snapshots: DataFrame, path: str) -> None:
    """Append snapshots (columns of SNAPSHOT) as JSON lines, in files of a good size."""
    snapshots.select(F.to_json(F.struct(*snapshots.columns)).alias("value")).hint("rebalance").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, broken) of a folder of JSON lines, one snapshot a line; a line without an app belongs to that of its folder
    (`app_id=1`), if it is named so.

    The schema is fixed, so nothing is inferred. A snapshot without a time takes the one in its file's name. Lines that are
    no JSON, and snapshots that have no time at all, are kept apart as (app_id, file, line, reason).
    """
    lines = spark.read.option("recursiveFileLookup", True).schema(SNAPSHOT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    file = F.col("_metadata.file_path")
    name = lambda i: F.regexp_extract(file, NAMED, i)
    written = F.try_to_timestamp("scannedAt")
    named = F.try_to_timestamp(F.concat(name(1), F.lit("T"), name(2), F.lit(":"), name(3), F.lit(":"), name(4), F.lit("."), name(5), F.lit("Z")))
    folder = F.nullif(F.regexp_extract(file, r"/app_id=(\d+)/", 1), F.lit("")).cast("long")
    rows = lines.select(
        F.coalesce("app_id", folder).alias("app_id"), "scan_id", F.coalesce(written, named).alias("scanned_at"), "stats", "issues", file.alias("file"), F.col("_corrupt_record").alias("line"),
    )
    good = F.col("line").isNull() & F.col("scanned_at").isNotNull()
    reason = F.when(F.col("line").isNotNull(), "no JSON").otherwise("no time")
    return rows.where(good).drop("line", "file"), rows.where(~good).select("app_id", "file", "line", reason.alias("reason"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each app (ties: the larger scan id); partial aggregation, no sort of an app's history."""
    rest = [c for c in snapshots.columns if c != "app_id"]
    order = ["scanned_at", "scan_id", *(c for c in rest if c not in ("scanned_at", "scan_id"))]
    best = snapshots.groupBy("app_id").agg(F.max(F.struct(*order)).alias("s"))
    return best.select("app_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def consecutive(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it in its app."""
    w = Window.partitionBy("app_id").orderBy("scanned_at", "scan_id")
    return snapshots.withColumn("previous_id", F.lag("scan_id").over(w))


def only_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key right lacks; repeated rows stay, so not a set difference."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def diff(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(scan_id, change, row...) for each pair (previous_id, scan_id): rows of the newer scan that the older lacks
    (`new`), and of the older that the newer lacks (`resolved`). Rows are read once: a scan's rows are the newer side of
    its own pair and the older side of the next, and one shuffle by pair and key tells which keys have both."""
    p = pairs.where("previous_id is not null")
    roles = p.select(F.col("scan_id").alias("at"), "scan_id", F.lit("new").alias("change")).union(p.select(F.col("previous_id").alias("at"), "scan_id", F.lit("resolved").alias("change")))
    sides = rows.withColumnRenamed("scan_id", "at").join(roles, "at").drop("at")
    same = Window.partitionBy("scan_id", key)
    both = sides.withColumn("__low", F.min("change").over(same)).withColumn("__high", F.max("change").over(same))
    return both.where("__low = __high").drop("__low", "__high")


def daily(snapshots: DataFrame, last_day: Column, n: int) -> DataFrame:
    """(app_id, day, scan_id, scanned_at): the last snapshot of each app at the end of each of n days up to last_day.

    A snapshot counts from its own day or the first on; each app keeps the last one of each such day before days are
    multiplied, at most n rows.
    """
    first = F.date_sub(last_day, n - 1)
    day = F.greatest(F.col("scanned_at").cast("date"), first)
    best = snapshots.where(F.col("scanned_at").cast("date") <= last_day).groupBy("app_id", day.alias("from_day")).agg(F.max(F.struct("scanned_at", "scan_id")).alias("s"))
    each = best.withColumn("day", F.explode(F.sequence("from_day", last_day)))
    last = each.groupBy("app_id", "day").agg(F.max("s").alias("s"))
    return last.select("app_id", "day", F.col("s.scan_id").alias("scan_id"), F.col("s.scanned_at").alias("scanned_at"))


def baseline(snapshots: DataFrame, since: Column) -> DataFrame:
    """The last snapshot at or before a time, else the oldest."""
    s = F.struct("scanned_at", "scan_id")
    best = snapshots.groupBy("app_id").agg(F.coalesce(F.max(F.when(F.col("scanned_at") <= since, s)), F.min(s)).alias("s"))
    return best.select("app_id", F.col("s.scan_id").alias("scan_id"), F.col("s.scanned_at").alias("scanned_at"))
