"""What the operators of this package share: tables that cut lineage, and connected components."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


class Scratch:
    """Tables written below the shared folder. Reading them back cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/t{self._n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kosha_path = path
        return out

    def keep_bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Keep df dealt out by key: later joins and groupings by key read it without a shuffle of its rows."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"kosha_{uuid.uuid4().hex}"
        writer = df.repartition(n, key).write.option("compression", "zstd").option("path", self.path())
        try:
            writer.bucketBy(n, key).sortBy(key).saveAsTable(name)
            out = self.spark.table(name)
            out.schema  # resolves the frame while the table has its name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay, and the frame knows them
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._kosha_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """docs with a column `name` that tells its rows apart, also when lost tasks are computed again.

    Rows of a file scan are named by file and place in it; any other frame is written to a table first.
    """
    place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit(":"), F.col("_metadata.row_index"))
    if docs.inputFiles():
        try:
            out = docs.select("*", place.alias(name))
            out.schema  # resolving the metadata column raises where there is none
            return out
        except AnalysisException:
            pass  # files behind a join or an aggregate
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id().cast("string")))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), longs: one row (node, root) per node, root the smallest node.

    Alternating large and small stars: each round points every node at the smallest neighbour seen so far,
    so the number of rounds grows with the logarithm of the longest chain. Each round is a written table.
    Self loops and nulls are ignored. Raises if most_rounds do not suffice; never returns a partial answer.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _mark(now)
    if not seen[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now)
        now, last, seen = new, seen, _mark(new)
        if seen == last:
            roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return scratch.keep(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
