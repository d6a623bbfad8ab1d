"""Job progress with an end and a silence, and ingestion that is safe to run again."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from kosha.streaming import monitors as M

START = datetime.datetime(2024, 1, 1)
EVENTS = "job long, ts timestamp, event_id long, progress double, state string"


def job_events(seed):
    """Six jobs with bursts, silences around 90 minutes, ends, events after them and rows without progress or state."""
    rng, rows, n = random.Random(seed), [], 0
    for job in range(6):
        at = START + datetime.timedelta(minutes=rng.randrange(50))
        for _ in range(40):
            at += datetime.timedelta(minutes=rng.choice([0, 1, 2, 5, 5, 89, 90, 91, 200]) if rng.random() < 0.3 else 1)
            n += 1
            rows.append((job, at, n, rng.choice([0.1, 0.1, 0.5, 0.9, None]), rng.choice(["running", "running", "running", None, "failed", "completed"]) if rng.random() < 0.2 else "running"))
    return rows


def by_hand(rows):
    out, jobs = [], {}
    for job, ts, n, p, state in sorted(rows, key=lambda r: (r[1], r[2])):
        last, done, at = jobs.get(job, (None, False, ts))
        if ts - at > datetime.timedelta(minutes=90):
            last, done = None, False
        over = state in M.ENDED
        if not done and (over or (p is not None and p != last)):
            out.append((job, ts, p, state))
        jobs[job] = (p if p is not None else last, done or over, ts)
    return sorted(out, key=repr)


def run(spark, folder, batches, schema, make):
    """The rows that a stream emits which reads one batch of rows after the other, and its last report."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    name = f"t{uuid.uuid4().hex}"
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.sql(f"select * from {name}").collect(), query.recentProgress


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_in_batches_equals_the_table(spark, tmp_path, seed):
    rows = job_events(seed)
    want = by_hand(rows)
    table = M.progress_changes(spark.createDataFrame(rows, EVENTS), "job", ["ts", "event_id"], "progress", "state")
    assert sorted((tuple(r) for r in table.select("job", "ts", "progress", "state").collect()), key=repr) == want
    rows.sort(key=lambda r: (r[1], r[2]))
    size = len(rows) // 4
    batches = [random.Random(3).sample(rows[i : i + size], len(rows[i : i + size])) for i in range(0, len(rows), size)]
    got, _ = run(spark, tmp_path, batches, EVENTS, M.progress_stream)
    assert sorted(((r.job, r.ts, None if r.progress is None or r.progress != r.progress else r.progress, r.state) for r in got), key=repr) == want


def test_state_of_finished_and_silent_jobs_goes(spark, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    first = [(j, at(j % 5), j, 0.5, "completed" if j % 2 else "running") for j in range(20)]
    later = [[(100, at(300 + 10 * i), 1000 + i, 0.1 * i, "running")] for i in range(3)]
    got, told = run(spark, tmp_path, [first, *later], EVENTS, M.progress_stream)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in told if p["stateOperators"]]
    assert len(got) == 23 and max(held) >= 20 and held[-1] < 5


def test_changes_alone_without_states(spark):
    rows = spark.createDataFrame([(1, 1, 0.1), (1, 2, None), (1, 3, 0.1), (1, 4, 0.2), (2, 5, None)], "job int, t int, p double")
    assert [r.t for r in M.progress_changes(rows, "job", ["t"], "p").orderBy("t").collect()] == [1, 4]


DOCS = "doc_id long, text string"


def chunk(docs):
    return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word")).withColumn("h", F.sha2("word", 256))


def ingest(spark, tmp_path, state, cut=chunk):
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/drop=*")
    query = M.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/{state}", cut, ["doc_id", "h"], buckets=8)
    query.awaitTermination()
    return query


def test_ingestion_replayed_writes_nothing_twice(spark, tmp_path):
    texts = {i: f"a b{i % 3} c{i} a" for i in range(30)}
    for i in range(3):
        spark.createDataFrame([(d, t) for d, t in texts.items() if d % 3 == i] + [(0, texts[0]), (None, "null id")], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/drop={i}")
    want = sorted([(d, w) for d, t in texts.items() for w in set(t.split())] + [(None, "null"), (None, "id")], key=repr)
    rows = lambda: sorted(((r.doc_id, r.word) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    query = ingest(spark, tmp_path, "state")
    assert rows() == want
    assert not any(p["stateOperators"] for p in query.recentProgress)  # nothing of the corpus is kept as state
    ingest(spark, tmp_path, "state")
    assert rows() == want
    ingest(spark, tmp_path, "other")  # a lost checkpoint: all batches come again
    assert rows() == want


def test_ingestion_goes_on_after_a_failed_batch(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(10 * i + j, f"w{j} x") for j in range(5)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/drop={i}")

    def breaks(docs):
        made = chunk(docs)
        return made.withColumn("h", F.when(F.col("doc_id") == 14, F.raise_error(F.lit("broken"))).otherwise(F.col("h")))

    with pytest.raises(Exception):
        ingest(spark, tmp_path, "state", breaks)
    ingest(spark, tmp_path, "state")
    got = sorted((r.doc_id, r.word) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((10 * i + j, w) for i in range(2) for j in range(5) for w in (f"w{j}", "x"))
