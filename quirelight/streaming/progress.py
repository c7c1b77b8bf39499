"""Streams of calls: progress, and a breaker that follows the events' own time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from quirelight.operators.jobs import latest
from quirelight.sources.store import root

#: State of several variables and timers needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the event files that path (a pattern) names, some in each batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream has now: each batch's rows, with its number, in a table of the shared
    folder. A batch that runs again writes to its own folder again."""
    spark = stream.sparkSession
    where = f"{root(spark)}/quirelight/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", IntegerType())).parquet(f"{where}/rows")


def drained_progress(spark: SparkSession, d: str) -> DataFrame:
    counts = events(spark, f"{d}/events*.parquet").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return latest(drained(counts, "update", "progress"), ["user_id"], "batch").drop("batch")


class Breaker(StatefulProcessor):
    """For each user, calls wait until the watermark has passed their time; then they are counted in the
    order of their time, whichever order they came in. waiting: those calls; streak: of bad calls
    so far. One timer stands at the earliest call that waits."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, bad boolean")
        self.streak = handle.getValueState("streak", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(at), int(i), bool(bad)) for frame in rows for at, i, bad in zip(frame["at"], frame["event_id"], frame["bad"], strict=True)]
        self.waiting.appendList(came)
        self._wake(min(at for at, _, _ in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(at), int(i), bool(bad)) for at, i, bad in self.waiting.get())
        ready, left = [x for x in held if x[0] < passed], [x for x in held if x[0] >= passed]
        streak, out = self.streak.get()[0] if self.streak.exists() else 0, []
        for at, event_id, bad in ready:
            streak = streak + 1 if bad else 0
            if streak == self.threshold:
                out.append((key[0], at, event_id))
        self.streak.update((int(streak),))
        self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self._wake(left[0][0])
        yield pd.DataFrame(out, columns=["user_id", "at", "event_id"]).astype("int64")

    def _wake(self, at: int) -> None:
        """A timer behind the microsecond, in whole milliseconds."""
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        return


def breaker(stream: DataFrame, delay: str, threshold: int = 3) -> DataFrame:
    """stream: user_id, ts, event_id, bad. (user_id, at, event_id) whenever a user's streak of bad calls, in the order of
    (ts, event_id), reaches threshold; at is ts in microseconds. Calls may come later than newer ones by up to
    delay; what comes later still is dropped, as a watermark does. A call's row is given when the
    watermark has passed it: so a user's state holds the calls of one delay."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "bad").withWatermark("ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(Breaker(threshold), "user_id long, at long, event_id long", "Append", "eventTime")


def shuffled_files(log: DataFrame, folder: str, files: int = 6) -> int:
    """Writes the log (with ts) as a folder of files: slices of time, one behind the other, of which every tenth
    row comes with the next slice. One row far ahead stands last and lets the watermark pass all
    others. Returns how late, in seconds, a row can be."""
    low, high = log.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    width = (high - low) // files + 1
    at = F.unix_micros(F.col("ts").cast("timestamp")) - low
    slot = F.floor(at / width).cast("int")
    rows = log.withColumn("slot", F.when(F.col("event_id") % 10 == 0, slot + 1).otherwise(slot))
    for k in range(files + 1):
        rows.where(F.col("slot") == k).drop("slot").coalesce(1).write.mode("append").parquet(folder)
    ahead = F.timestamp_micros(F.lit(high + 4 * width)).cast(log.schema["ts"].dataType)
    log.limit(1).withColumn("ts", ahead).withColumn("user_id", F.lit(-1).cast("long")).write.mode("append").parquet(folder)
    return 2 * width // 1_000_000 + 1


def drained_breaker(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, n_open, event_id): how often each user's breaker opens, and at which call first; the log comes in several files, some rows late."""
    bad = (F.col("event_type") == "error") | (F.col("value") < 20)
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", bad.alias("bad"))
    folder = f"{root(spark)}/quirelight/events-{uuid.uuid4().hex}"
    late = shuffled_files(log, folder)
    with state_in_rocksdb(spark):
        opened = drained(breaker(events(spark, folder, 1), f"{late} seconds"), "append", "breaker")
    return opened.groupBy("user_id").agg(F.count("*").alias("n_open"), F.min_by("event_id", F.struct("at", "event_id")).alias("event_id"))
