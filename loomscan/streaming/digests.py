"""Digests and scans that fall due: state that remembers when the last one went out, timers, and a tick."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomscan.operators import pages
from loomscan.sources import stores
from loomscan.streaming import events

DIGEST = "app_id long, since timestamp, until timestamp, n long"
#: State of an app: when its next digest is due (epoch milliseconds), its period, and what has been counted for it.
HELD = "due long, every long, n long"
DAY = 86_400_000


class DigestProcessor(StatefulProcessor):
    """Emits a digest of an app once its period is over, also when nothing more happens; quiet periods have none.

    An app's periods begin with its first active day. State is one row an app; a timer stands at the end of the period that
    has something to tell.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.held.get()) if self.held.exists() else None
        timer = state[0] if state and state[2] else None
        out = []
        for r in pd.concat(list(rows)).sort_values("day").itertuples():
            day = int(pd.Timestamp(r.day).value // 1_000_000)
            due, every, n = state or (day + int(r.every_days) * DAY, int(r.every_days) * DAY, 0)
            if day >= due:
                if n:
                    out.append((key[0], due - every, due, n))
                due, n = due + ((day - due) // every + 1) * every, 0
            state = due, every, n + int(r.n)
        if timer is not None and timer != state[0]:
            self.handle.deleteTimer(timer)
        if timer != state[0]:
            self.handle.registerTimer(state[0])
        self.held.update(state)
        yield told(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, every, n = self.held.get()
        self.held.update((due + every, every, 0))
        yield told([(key[0], due - every, due, n)] if n else [])

    def close(self) -> None:
        pass


def told(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["app_id", "since", "until", "n"])
    return out.assign(app_id=out["app_id"].astype("int64"), n=out["n"].astype("int64"), since=pd.to_datetime(out["since"], unit="ms"), until=pd.to_datetime(out["until"], unit="ms"))


def digest_stream(rows: DataFrame) -> DataFrame:
    """(app_id, since, until, n) from a stream (app_id, ts with a watermark, every_days): each due digest once.

    Days are counted first, by an aggregate that combines before its shuffle, so a busy app sends one row a day to the state.
    """
    days = rows.groupBy("app_id", "every_days", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    closed = days.select("app_id", "every_days", F.col("w.start").alias("day"), F.col("w.end").alias("closed_at"), "n")
    return closed.groupBy("app_id").transformWithStateInPandas(DigestProcessor(), DIGEST, "Append", "EventTime")


#: transformWithState keeps its state in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_now(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Run a stream over all that is there, append to a folder, and stop; a restart goes on at the checkpoint. A run ends by
    itself, however much there is; with a timeout in seconds it is an error if it does not end in time."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"not done after {timeout} s")
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)


SENT = "app_id long, digest_sent_at timestamp"


def digest_tick(apps: DataFrame, counts: DataFrame, path: str, now: F.Column, send: Callable[[DataFrame], None], days: int = 7) -> DataFrame:
    """Send the digests that are due and remember that they went out; the rows (app_id, text) that were sent.

    The times of the last digests are a state table at `path`. They are written after sending, as a new version: a tick that
    dies in between sends again, one that died before it has sent nothing.
    """
    spark = apps.sparkSession
    sent = stores.cut(stores.read_state(spark, path, SENT), "sent")
    due = events.digest_due(apps.join(sent, "app_id", "left"), now, days)
    texts = stores.cut(pages.digest_texts(due.select("app_id").join(counts, "app_id"), days), "digests")
    send(texts)
    stores.write_state(sent.join(due.select("app_id"), "app_id", "left_anti").unionByName(due.select("app_id", now.cast("timestamp").alias("digest_sent_at"))), path)
    return texts


def schedule(spark: SparkSession, apps: Callable[[], DataFrame], enqueue: Callable[[DataFrame, int], None], checkpoint: str, period: str = "60 seconds"):
    """A running query that at each period hands the apps whose scan is due to `enqueue`; the table is read anew at each tick."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, number: int) -> None:
        enqueue(events.due(apps(), F.current_timestamp()), number)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()
