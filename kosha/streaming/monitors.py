"""Streams of documents and events, and the batch forms that give the same rows from a finished table."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window


#: Job states after which nothing of a job is reported, and the minutes of silence after which it is forgotten.
ENDED = ("completed", "failed", "canceled")
FORGOTTEN = 90


def progress_changes(events: DataFrame, job: str, order: list[str], progress: str, state: str | None = None, ended: tuple[str, ...] = ENDED, minutes: int = FORGOTTEN) -> DataFrame:
    """Batch form: the events that change a job's progress; order begins with the event's time.

    With a column `state`, an event of an ended state is the last of its job that is told (told even if its progress is
    the old one), and after `minutes` without any event a job is forgotten: what comes then is told as of a new job.
    Without `state` only changes count. Events without progress tell nothing, but keep a job alive.
    """
    w = Window.partitionBy(job).orderBy(*order)
    if state is None:
        before = F.lag(progress).over(w)
        return events.where(F.col(progress).isNotNull()).withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(progress))).drop("__b")
    gap = F.coalesce(F.col(order[0]) > F.lag(order[0]).over(w) + F.expr(f"interval {minutes} minutes"), F.lit(False))
    rows = events.withColumn("__g", gap).withColumn("__run", F.sum(F.col("__g").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(job, "__run").orderBy(*order)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.col(state).isin(*ended), F.lit(False))
    rows = rows.withColumns({"__over": over, "__done": F.coalesce(F.max(over).over(earlier), F.lit(False)), "__b": F.last(progress, ignorenulls=True).over(earlier)})
    new = F.col(progress).isNotNull() & (F.col("__b").isNull() | (F.col("__b") != F.col(progress)))
    return rows.where(~F.col("__done") & (new | F.col("__over"))).drop("__g", "__run", "__over", "__done", "__b")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch by (ts, event_id), over all Arrow chunks that they came in."""
    return pd.concat(list(rows)).sort_values(["ts", "event_id"])


class ProgressProcessor(StatefulProcessor):
    """Stream form: a job's last progress, whether it ended and its last event; a timer forgets it after the silence."""

    def __init__(self, ended: tuple[str, ...] = ENDED, minutes: int = FORGOTTEN):
        self._ended, self._wait = set(ended), minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        shape = StructType([StructField("p", DoubleType()), StructField("done", BooleanType()), StructField("at", LongType())])
        self._job = handle.getValueState("job", shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, done, at = self._job.get() if self._job.exists() else (None, False, None)
        out, old = [], at
        for row in in_order(rows).itertuples():
            now = row.ts.value // 1_000_000
            if at is not None and now > at + self._wait:
                last, done = None, False
            at = now if at is None else max(at, now)
            over, known = row.state in self._ended, row.progress == row.progress and row.progress is not None
            if not done and (over or (known and row.progress != last)):
                out.append((key[0], row.ts, row.progress if known else None, row.state))
            last, done = (row.progress if known else last), done or over
        if old is not None:
            self._handle.deleteTimer(old + self._wait)
        self._handle.registerTimer(at + self._wait)
        self._job.update((None if last is None else float(last), done, at))
        yield pd.DataFrame(out, columns=["job", "ts", "progress", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._job.clear()
        yield pd.DataFrame([], columns=["job", "ts", "progress", "state"])

    def close(self) -> None:
        pass


def on_disk(spark) -> None:
    """State of this session's streams goes to RocksDB on the executors' disks instead of their memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def progress_stream(stream: DataFrame, late: str = "10 minutes", ended: tuple[str, ...] = ENDED, minutes: int = FORGOTTEN) -> DataFrame:
    """Rows (job, ts, progress, state) of a stream (job, ts, event_id, progress, state): those of progress_changes.

    A job's state is three values; it goes when the watermark (`late` behind the newest event) is `minutes` past the
    job's last event, ended or not. Events later than the watermark are left out.
    """
    on_disk(stream.sparkSession)
    keyed = stream.withWatermark("ts", late).groupBy("job")
    return keyed.transformWithStateInPandas(ProgressProcessor(ended, minutes), "job long, ts timestamp, progress double, state string", "Append", "EventTime")


def streaks(events: DataFrame, user: str, order: list[str], failed: str, length: int = 5, minutes: int = 15) -> DataFrame:
    """Batch form: (user, ts, until) when a user's `length` consecutive failures lock them out; success starts anew."""
    w = Window.partitionBy(user).orderBy(*order)
    island = F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("__i", island).where(F.col(failed))
    n = F.row_number().over(Window.partitionBy(user, "__i").orderBy(*order))
    hit = marked.withColumn("__n", n).where(F.col("__n") % length == 0)
    return hit.select(user, F.col("ts"), (F.col("ts") + F.expr(f"interval {minutes} minutes")).alias("until"))


class StreakProcessor(StatefulProcessor):
    """Stream form: counts a user's consecutive failures; a success forgets the user, so only open streaks hold state."""

    def __init__(self, length: int = 5, minutes: int = 15):
        self._length, self._minutes = length, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._count = handle.getValueState("count", StructType([StructField("n", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, out = self._count.get()[0] if self._count.exists() else 0, []
        for row in in_order(rows).itertuples():
            n = n + 1 if row.failed else 0
            if n and n % self._length == 0:
                out.append((key[0], row.ts, row.ts + datetime.timedelta(minutes=self._minutes)))
        if n:
            self._count.update((n % self._length,))
        else:
            self._count.clear()
        yield pd.DataFrame(out, columns=["user_id", "ts", "until"])

    def close(self) -> None:
        pass


def lockout_stream(stream: DataFrame, length: int = 5, minutes: int = 15) -> DataFrame:
    """Rows (user_id, ts, until) of a stream (user_id, ts, event_id, failed), the same in every replay as of streaks."""
    on_disk(stream.sparkSession)
    return stream.groupBy("user_id").transformWithStateInPandas(StreakProcessor(length, minutes), "user_id long, ts timestamp, until timestamp", "Append", "None")


def breaches(events: DataFrame, user: str, most: int, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user, start, n): windows in which a user has more than `most` events; the same for streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(user, F.window("ts", every).alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(user, F.col("w.start").alias("start"), "n")


def hourly_usage(events: DataFrame, kind: str, value: str, late: str = "1 hour") -> DataFrame:
    """(kind, hour, n, total) per hour; rows later than `late` are dropped from a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    made = events.groupBy(kind, F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return made.select(kind, F.col("w.start").alias("hour"), "n", "total")


def rolling_latency(events: DataFrame, value: str, failed: str, length: str = "1 hour", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n, p95, p99, error_rate) of sliding windows: approximate percentiles on a stream, exact ones on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    share = (lambda p: F.percentile_approx(value, p)) if events.isStreaming else (lambda p: F.expr(f"percentile({value}, {p})"))
    made = events.groupBy(F.window("ts", length, every).alias("w")).agg(
        F.count("*").alias("n"), F.round(share(0.95), 4).alias("p95"), F.round(share(0.99), 4).alias("p99"), F.round(F.avg(F.col(failed).cast("int")), 6).alias("error_rate")
    )
    return made.select(F.col("w.start").alias("start"), "n", "p95", "p99", "error_rate")


def recent(events: DataFrame, hours: int = 10, most: int = 20) -> DataFrame:
    """The newest `most` events of the last `hours` before the newest one."""
    end = events.agg(F.max("ts")).first()[0]
    kept = events.where(F.col("ts") >= F.lit(end) - F.expr(f"interval {hours} hours"))
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


BUCKETS = 256


def ingest(stream: DataFrame, target: str, checkpoint: str, chunk, keys: list[str], scope: str | None = None, buckets: int = BUCKETS):
    """Start a query that appends the chunks of new documents once each; safe to run again, from any of its batches.

    chunk maps documents to chunks that hold keys. The target is dealt out by a hash of `scope` (the first key) in
    folders `bucket=n`; a batch reads the keys of those buckets alone that its own rows fall in, leaves out what is there
    and appends the rest. So the query has no state that grows, and a batch that failed half-way and comes again adds only
    what is missing. Rows of a batch that repeat a key are one.
    """
    scope = scope or keys[0]

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        made = chunk(batch).dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int"))
        made = made.persist()
        try:
            touched = [r.bucket for r in made.select("bucket").distinct().collect()]  # at most `buckets`
            if touched:
                held = _held(spark, target, made.schema)
                if held is not None:
                    known = held.where(F.col("bucket").isin(touched)).select("bucket", *keys)
                    on = reduce(lambda a, b: a & b, [made[c].eqNullSafe(known[c]) for c in ("bucket", *keys)])
                    fresh = made.join(known, on, "left_anti")
                else:
                    fresh = made
                fresh.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(target)
        finally:
            made.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _held(spark, target: str, schema: StructType) -> DataFrame | None:
    """The rows of a target written so far; None before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(target)
