"""Queries of the streaming operators (K): their batch forms on the finished event table, and one run of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.chunks import emit, split_pages
from ..session import shared_folder
from ..streaming import monitors as M
from .registry import query
from .tables import LINES, table

_BAND = "floor(value / 25)"


def events(spark, sf):
    return table(spark, sf, "events")


@query(
    "k1_progress",
    f"""WITH e AS (SELECT event_id, user_id, ts, {_BAND}::BIGINT AS p, event_type = 'purchase' AS done, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 90 MINUTE, false) AS gap FROM events),
        r AS (SELECT *, sum(gap::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
        w AS (SELECT *, coalesce(bool_or(done) OVER v, false) AS over, last_value(p IGNORE NULLS) OVER v AS b FROM r WINDOW v AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, p, done FROM w WHERE NOT over AND (done OR (p IS NOT NULL AND (b IS NULL OR b <> p)))""",
)
def k1(spark, sf):
    """A user's events as one job's: a purchase completes it, quarters of the value are its progress."""
    rows = events(spark, sf).withColumn("p", F.floor(F.col("value") / 25)).withColumn("state", F.when(F.col("event_type") == "purchase", "completed").otherwise("running"))
    return M.progress_changes(rows, "user_id", ["ts", "event_id"], "p", "state").select("event_id", "p", (F.col("state") == "completed").alias("done"))


@query("k2_ingest", f"SELECT DISTINCT doc_id, trim(text) AS text, sha256(trim(text)) AS text_hash FROM {LINES} WHERE length(trim(text)) >= 50")
def k2(spark, sf):
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.parquet(f"{root}/in/drop=1")
    stream = spark.readStream.schema(docs.schema).parquet(f"{root}/in/*")
    chunk = lambda d: emit(split_pages(d, ["doc_id"], sep="\n"))
    M.ingest(stream, f"{root}/out", f"{root}/state", chunk, ["doc_id", "text_hash"]).awaitTermination()
    docs.where("doc_id % 2 = 1").write.parquet(f"{root}/in/drop=2")
    M.ingest(stream, f"{root}/out", f"{root}/state", chunk, ["doc_id", "text_hash"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "text", "text_hash")


@query(
    "k3_lockout",
    """WITH m AS (SELECT user_id, event_id, ts, value < 40 AS f, sum((NOT value < 40)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events WHERE value IS NOT NULL),
       n AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS n FROM m WHERE f) SELECT user_id, ts, ts + INTERVAL 15 MINUTE AS until FROM n WHERE n % 5 = 0""",
)
def k3(spark, sf):
    rows = events(spark, sf).where("value is not null").withColumn("failed", F.col("value") < 40)
    return M.streaks(rows, "user_id", ["ts", "event_id"], "failed")


@query("k4_breaches", "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def k4(spark, sf):
    return M.breaches(events(spark, sf), "user_id", 1)


@query("k5_hourly_usage", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def k5(spark, sf):
    return M.hourly_usage(events(spark, sf), "event_type", "value")


@query(
    "k6_rolling",
    """WITH w AS (SELECT value, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) v(i))
       SELECT start, count(*) AS n, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(avg((value < 1)::INT), 6) AS error_rate FROM w GROUP BY 1""",
)
def k6(spark, sf):
    return M.rolling_latency(events(spark, sf).withColumn("failed", F.col("value") < 1), "value", "failed", every="30 minutes")


@query("k7_recent", "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 HOUR ORDER BY ts DESC, event_id DESC LIMIT 20")
def k7(spark, sf):
    return M.recent(events(spark, sf)).select("event_id", "ts")
