"""Registered streaming queries: digests by timers, and the change feed of snapshots, run over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscan.plans.portfolio import ctes, query
from loomscan.sources import fixtures as fx
from loomscan.sources import stores
from loomscan.streaming import changes, digests


def arrived(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """A stream of the files of a folder with df's columns."""
    return spark.readStream.schema(df.schema).parquet(folder)


@query("""WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), e AS (SELECT user_id % 50 AS app_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL),
closed AS (SELECT *, min(day) OVER (PARTITION BY app_id) AS first, [1, 3, 7][(app_id % 3 + 1)::int] AS every FROM e, w WHERE day + INTERVAL 1 DAY <= mark),
p AS (SELECT app_id, first + to_days((date_diff('day', first, day) // every * every)::int) AS since, every, n, mark FROM closed)
SELECT app_id, since::timestamp AS since, (since + to_days(every))::timestamp AS until, sum(n)::bigint AS n FROM p WHERE since + to_days(every) <= mark GROUP BY ALL""")
def digest_feed(spark, sf):
    """Digests of the events of fifty apps, due every 1, 3 or 7 days, each emitted once; events arrive in two runs of one
    query, and a third run finds nothing new."""
    folder, path, checkpoint = (stores.scratch(spark, n) for n in ("events", "digests", "progress"))
    every = F.element_at(F.array(*map(F.lit, (1, 3, 7))), (F.col("app_id") % 3 + 1).cast("int"))
    e = fx.read(spark, sf, "events").select((F.col("user_id") % 50).alias("app_id"), F.col("ts").cast("timestamp").alias("ts")).withColumn("every_days", every)
    half = F.lit("2024-01-15").cast("timestamp")
    stream = lambda: digests.digest_stream(arrived(spark, e, folder).withWatermark("ts", "1 hour"))
    for part in (e.where(F.col("ts") < half), e.where(F.col("ts") >= half), e.limit(0)):
        part.write.mode("append").parquet(folder)
        digests.run_now(stream(), path, checkpoint)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.schema(digests.DIGEST).parquet(path).select("app_id", ntz("since"), ntz("until"), "n")


#: Every 97th scan comes in last of all; it is late if its app has a newer one by then.
SQL_LATE = """scan AS (SELECT *, scan_id % 97 = 5 AND scanned_at < max(CASE WHEN scan_id % 97 <> 5 THEN scanned_at END) OVER (PARTITION BY app_id) AS late FROM snapshots),
pair AS (SELECT *, lag(scan_id) OVER (PARTITION BY app_id ORDER BY scanned_at, scan_id) AS before FROM scan WHERE NOT coalesce(late, false)),
f AS (SELECT scan_id, category || line AS f FROM issues)"""


@query(ctes(fx.SQL_SNAPSHOTS, fx.SQL_ISSUES, SQL_LATE) + """SELECT app_id, scan_id, CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM f WHERE f.scan_id = p.scan_id AND f NOT IN (SELECT g.f FROM f g WHERE g.scan_id = p.before)) END::int AS new,
  CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM f WHERE f.scan_id = p.before AND f NOT IN (SELECT g.f FROM f g WHERE g.scan_id = p.scan_id)) END::int AS resolved, false AS late FROM pair p
UNION ALL SELECT app_id, scan_id, 0, 0, true FROM scan WHERE late""")
def change_stream(spark, sf):
    """The change feed of a stream of snapshots, fed in order by four runs that restart at one checkpoint, then late ones, then
    nothing: equal to comparing neighbours in a batch."""
    folder, path, checkpoint = (stores.scratch(spark, n) for n in ("scans", "changes", "progress"))
    line, part = fx.read(spark, sf, "lineitem"), fx.read(spark, sf, "part")  # findings without their apps, which snapshots know
    said = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("scan_id"), F.concat("p_type", F.col("l_linenumber").cast("string")).alias("fingerprint"))
    found = said.groupBy("scan_id").agg(F.collect_list("fingerprint").alias("fingerprints"))
    newest = F.max(F.when(F.col("scan_id") % 97 != 5, F.col("scanned_at"))).over(Window.partitionBy("app_id"))
    late = F.coalesce((F.col("scan_id") % 97 == 5) & (F.col("scanned_at") < newest), F.lit(False))
    scans = fx.snapshots(spark, sf).withColumn("late", late).join(found, "scan_id", "left").select("app_id", "scan_id", F.col("scanned_at").cast("timestamp").alias("scanned_at"), "fingerprints", "late")
    scans = stores.cut(scans, "snapshots")
    year, own = F.year("scanned_at"), scans.drop("late")
    runs = [own.where(~F.col("late") & cond) for cond in (year < 1997, year.between(1997, 1998), year.between(1999, 2000), year > 2000)] + [own.where("late"), own.limit(0)]
    for part in runs:
        part.write.mode("append").parquet(folder)
        digests.run_now(changes.change_stream(arrived(spark, own, folder)), path, checkpoint)
    return spark.read.schema(changes.CHANGE).parquet(path)


#: Customers join at the first of the ticks (days 1, 5, 9, 13) that comes after the last digit of their key.
@query("""WITH c AS (SELECT c_custkey AS app_id, CASE WHEN c_custkey % 10 = 0 THEN 1 WHEN c_custkey % 10 < 5 THEN 5 WHEN c_custkey % 10 < 9 THEN 9 ELSE 13 END AS first FROM customer WHERE c_custkey % 3 <> 0)
SELECT app_id, first AS day FROM c UNION ALL SELECT app_id, first + 8 FROM c WHERE first + 8 <= 13""")
def digest_ticks(spark, sf):
    """Four ticks of the digest: each sends what is due a week after the last one and remembers it for the next."""
    path, out = stores.scratch(spark, "sent"), stores.scratch(spark, "texts")
    c = fx.read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("name"), F.lit(True).alias("digest_enabled"), F.lit("http://x").alias("webhook"))
    zero = F.lit(0).cast("long")
    counts = c.select("app_id", "name", zero.alias("new"), zero.alias("resolved"), zero.alias("active"))
    for day in (1, 5, 9, 13):
        send = lambda texts, day=day: texts.select("app_id", F.lit(day).alias("day")).write.mode("append").parquet(out)
        digests.digest_tick(c.where(F.col("app_id") % 10 < day), counts, path, F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp"), send)
    return spark.read.schema("app_id long, day int").parquet(out)
