"""The relational source against Derby, and the upsert sink over batches, one of which fails."""

import uuid

import pytest
from pyspark.sql import functions as F

from kosha.sources import tables as S

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:k{uuid.uuid4().hex};create=true"
    rows = [(i, ["approved", "rejected", "extracted"][i % 3], int(i % 5 == 0), i * 2.5) for i in range(1, 301)] + [(None, "approved", 0, 0.0)]
    spark.createDataFrame(rows, "id long, status string, deleted int, score double").write.option("createTableColumnTypes", "status VARCHAR(20)").jdbc(url, "units", properties={"driver": DERBY})
    spark.createDataFrame([], "id long, status string").write.jdbc(url, "nothing", properties={"driver": DERBY})
    return url, rows


def test_relational_rows_come_in_ranges(spark, database):
    url, rows = database
    got = S.read_jdbc(spark, url, "units", "id", parts=4, driver=DERBY)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_filters_and_columns_reach_the_database(spark, database):
    url, rows = database
    got = S.read_jdbc(spark, url, "units", "id", F.expr("status <> 'rejected' and deleted = 0"), 4, DERBY, ["id"]).select("id", "score")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "status" in plan.split("PushedFilters")[1].split("]")[0]
    want = sorted(((i, x) for i, s, d, x in rows if s != "rejected" and not d), key=lambda r: (r[0] is not None, r))
    assert [tuple(r) for r in got.collect()] == want


def test_a_relational_table_without_rows(spark, database):
    got = S.read_jdbc(spark, database[0], "nothing", "id", parts=4, driver=DERBY)
    assert got.count() == 0 and got.rdd.getNumPartitions() == 1


UNITS = "k int, part string, v string, version int"


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/units"
    rows = lambda: {(r.k, r.part): (r.v, r.version) for r in spark.read.parquet(path).collect()}
    put = lambda data: S.upsert_into(spark.createDataFrame(data, UNITS), path, ["k", "part"], "version", 8)
    assert put([]) == 0 and put([(i, "a", "one", 1) for i in range(50)] + [(None, None, "none", 1), (1, "a", "older", 0)]) == 8
    assert len(rows()) == 51 and rows()[1, "a"] == ("one", 1)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert put([(3, "a", "two", 2), (3, "b", "new", 1), (4, "a", "late", 0), (5, "a", "same", 1)]) <= 4
    assert rows()[3, "a"] == ("two", 2) and rows()[3, "b"] == ("new", 1) and rows()[4, "a"] == ("one", 1) and rows()[5, "a"] == ("one", 1) and len(rows()) == 52
    kept = [p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len({p.parent for p in kept}) >= 4
    before = rows()
    bad = spark.createDataFrame([(6, "a", "x", 9), (7, "a", "y", 9)], UNITS).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        S.upsert_into(bad, path, ["k", "part"], "version", 8)
    assert rows() == before and not list(tmp_path.glob("units-staged-*"))
    put([(6, "a", "x", 9), (None, None, "some", 2)])
    assert rows() == before | {(6, "a"): ("x", 9), (None, None): ("some", 2)}
