"""Digests by timers, ticks that remember, and schedules that fall due, as running queries."""

import inspect
import time

from pyspark.sql import functions as F

from loomscan.sources import stores
from loomscan.streaming import changes, digests

EVENT = "app_id long, ts string, every_days int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_digests_are_due_once_and_without_further_events(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def feed(*events):
        df = spark.createDataFrame(list(events), EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder).withWatermark("ts", "1 hour")
        digests.run_now(digests.digest_stream(stream), out, cp)
        return rows(spark.read.parquet(out).select("app_id", F.date_format("since", "MM-dd").alias("s"), F.date_format("until", "MM-dd").alias("u"), "n"), "app_id", "s", "u", "n")

    first = feed((1, "2024-01-01 05:00:00", 2), (1, "2024-01-02 05:00:00", 2), (2, "2024-01-01 07:00:00", 1), (3, "2024-01-03 00:30:00", 7))
    assert first == [(2, "01-01", "01-02", 1)]  # the watermark stands at the second of January, 23:30
    second = feed((3, "2024-01-05 12:00:00", 7), (1, "2024-01-01 06:00:00", 2))  # the second one is late and lost; app 1's time has come
    assert second == [(1, "01-01", "01-03", 2), *first]
    third = feed((1, "2024-01-09 01:00:00", 2), (3, "2024-01-20 01:00:00", 7))
    assert third == sorted([*second, (3, "01-03", "01-10", 2), (1, "01-09", "01-11", 1)], key=str)
    assert feed() == third


def test_ticks_remember_what_was_sent(spark, tmp_path):
    path, sent = str(tmp_path / "sent"), []
    apps = spark.createDataFrame([(1, "A", True, "http://x"), (2, "B", False, "http://x"), (3, "C", True, "")], "app_id long, name string, digest_enabled boolean, webhook string")
    counts = spark.createDataFrame([(1, "A", 4, 2, 9)], "app_id long, name string, new long, resolved long, active long")
    tick = lambda day: digests.digest_tick(apps, counts, path, F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp"), lambda t: sent.append([r["text"] for r in t.collect()]))
    for day in (1, 2, 7, 8, 9):
        tick(day)
    assert sent == [["Digest of A: 4 new, 2 resolved in 7 days, 9 active"], [], [], ["Digest of A: 4 new, 2 resolved in 7 days, 9 active"], []]
    assert [(r[0], str(r[1])[:10]) for r in stores.read_state(spark, path, digests.SENT).collect()] == [(1, "2024-01-08")]


def test_a_tick_hands_on_the_apps_that_are_due(spark, tmp_path):
    schema = "app_id long, schedule_minutes int, status string, scanned_at timestamp"
    state, seen = {"status": "Done"}, []
    apps = lambda: spark.createDataFrame([(1, 60, state["status"], None), (2, 0, "Done", None)], schema)

    def enqueue(due, number):
        seen.append([r["app_id"] for r in due.collect()])
        state["status"] = "Queued"

    query = digests.schedule(spark, apps, enqueue, str(tmp_path / "cp"), "1 second")
    try:
        for _ in range(120):
            if len(seen) >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen[:2] == [[1], []]


def test_apps_of_a_bucket_share_one_row_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "BUCKETS", 3, raising=False)
    folder, big = str(tmp_path / "scans"), (1 << 60) + 1
    for day in (1, 3, 2):
        rows = [(a, day, f"2024-01-0{day} 00:00:00", ["kept", f"of {day}"]) for a in [*range(40), big, None]]
        made = spark.createDataFrame(rows, "app_id long, scan_id long, t string, fingerprints array<string>").selectExpr("app_id", "scan_id", "cast(t as timestamp) scanned_at", "fingerprints")
        made.coalesce(1).write.mode("append").parquet(folder)
    stream = changes.change_stream(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName("bucketed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    want = [(a, d, *told) for a in [*range(40), big, None] for d, told in ((1, (0, 0, False)), (2, (0, 0, True)), (3, (1, 1, False)))]
    assert sorted(map(tuple, spark.table("bucketed").collect()), key=str) == sorted(want, key=str)


def test_a_run_may_take_as_long_as_it_needs():
    assert inspect.signature(digests.run_now).parameters["timeout"].default is None
