"""Sources and sinks: document folders, block JSON, golden sets, relational and vector tables, and idempotent writes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = "array<struct<layout_tag:string,text:string,reading_order:int,block_id:string>>"
GOLDEN_QUERY = "query string, language string, expected_chunk_ids array<string>, expected_book_ids array<string>, min_citation_coverage double, note string"
GOLDEN_FACT = (
    "fact_id string, book_slug string, language string, type string, domain_type string, subject string, predicate string, object string,"
    " conditions string, verbatim_snippet string, page_numbers array<int>, confidence_floor double, notes string"
)

# Markdown prefixes of layout tags, and tags that are not text.
TAG_PREFIX = {"title": "# ", "section-title": "## ", "sub-section-title": "### ", "list-item": "- ", "caption": "*"}
SKIPPED_TAGS = ["header", "footer", "page-number"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(book_key, text): one row per folder below path that holds a document.md."""
    whole = spark.read.text(f"{path}/*/document.md", wholetext=True)
    return whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/document\.md$", 1).alias("book_key"), F.col("value").alias("text"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(book_key, page_no, blocks) of every page_NNN.json below path."""
    pages = spark.read.schema(f"blocks {BLOCKS}").option("multiLine", True).json(f"{path}/*/metadata/page_*.json")
    name = F.input_file_name()
    return pages.select(
        F.regexp_extract(name, r"([^/]+)/metadata/", 1).alias("book_key"), F.regexp_extract(name, r"page_(\d+)\.json", 1).cast("int").alias("page_no"), "blocks"
    )


def read_golden(spark: SparkSession, path: str, schema: str = GOLDEN_QUERY) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def with_metadata(books: DataFrame, sidecar: DataFrame, pages: DataFrame) -> DataFrame:
    """books (book_key, inferred) with language and pages_processed: from the sidecar, else inferred and counted.

    A sidecar's language of "unknown" counts as missing; what is in neither place is null, or 0 pages.
    """
    counted = pages.groupBy("book_key").agg(F.count("*").alias("counted"))
    return (
        books.join(sidecar, "book_key", "left")
        .join(counted, "book_key", "left")
        .select("book_key", F.coalesce(F.nullif("language", F.lit("unknown")), "inferred").alias("language"), F.coalesce("pages_processed", "counted", F.lit(0)).cast("long").alias("pages_processed"))
    )


def assemble_pages(blocks: DataFrame, page: list[str], tags: dict[str, str] = TAG_PREFIX, skip: list[str] = SKIPPED_TAGS) -> DataFrame:
    """Text of each page from blocks (page columns, layout_tag, text, reading_order, block_id) in reading order."""
    prefix = F.lit("")
    for tag, mark in tags.items():
        prefix = F.when(F.col("layout_tag") == tag, F.lit(mark)).otherwise(prefix)
    kept = blocks.where(~F.coalesce(F.col("layout_tag").isin(skip), F.lit(False)) & (F.trim("text") != ""))
    order = F.struct(F.coalesce("reading_order", F.lit(9999)).alias("o"), F.col("block_id").alias("b"), F.concat(prefix, F.trim("text")).alias("t"))
    return kept.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), "\n\n").alias("text"))


def merge_parts(parts: DataFrame, book: str, order: str, pages: str, pieces: int = 64) -> DataFrame:
    """parts with page_offset: how many pages of its book come before a part; order: a number, unique in its book.

    The sum runs over pieces of the order and over the parts of a piece, so a book that holds most parts is many tasks.
    """
    ends = parts.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.001) if pieces > 1 else []
    bounds = sorted(set(ends))
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda x: x < F.col(order)))
    cut = parts.withColumn("__piece", cut)
    before = Window.partitionBy(book).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(book, "__piece").agg(F.sum(pages).alias("__sum")).select(F.col(book).alias("__b"), F.col("__piece").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(book, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("__in", F.coalesce(F.sum(pages).over(within), F.lit(0)))
    joined = rows.join(sums, F.col(book).eqNullSafe(F.col("__b")) & (F.col("__piece") == F.col("__p")))
    return joined.select(*parts.columns, (F.col("__start") + F.col("__in")).alias("page_offset"))


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The rows of batch to append: one per key, and none whose key is in target."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return fresh.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """target with batch merged in: of each key the row with the greatest version."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return target.unionByName(batch).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def normalised(df: DataFrame, column: str) -> DataFrame:
    """df with column composed to NFC; only rows that hold combining marks go through Python."""
    import unicodedata

    @F.pandas_udf("string")
    def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    marked = F.col(column).rlike(r"\p{M}")
    plain = df.where(~F.coalesce(marked, F.lit(False)))
    return plain.unionByName(df.where(marked).withColumn(column, nfc(column)))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, where: Column | None = None, parts: int = 16, driver: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of a relational table, read by `parts` tasks that each ask for a range of the whole-number column key.

    The bounds are asked for first, by a query that the database answers. where, and any other filter or choice of
    columns put on the result, is the database's work, too. A table without rows or with one key is one task; rows with
    a null key belong to the first range. order sorts by ranges, as by creation.
    """
    options = {"url": url} | ({"driver": driver} if driver else {})
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(**options).option("query", f"SELECT MIN({name}) AS a, MAX({name}) AS b FROM {table}").load().first()
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if low is not None and high > low:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(min(parts, high - low + 1)))
    rows = reader.load()
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(*order) if order else rows


#: Folders that a table kept by upsert_into is dealt out in.
UPSERT_BUCKETS = 64


def upsert_into(batch: DataFrame, path: str, keys: list[str], version: str, buckets: int = UPSERT_BUCKETS) -> int:
    """Merge batch into the Parquet table at path, the greatest version of each key staying; the number of touched buckets.

    The table is dealt out by a hash of keys in folders `bucket=n`. Only buckets that the batch falls in are read, merged
    and written, first to a folder of their own beside the table: a batch that fails until then leaves the table as it
    was. The swap then replaces these buckets by dynamic overwrite, which moves finished files folder by folder, and can be
    run again. Of equal versions the table's row stays, and of a batch's equal ones the first by its other columns.
    Null keys are a key. Writers of one table take turns.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn("bucket", bucket)
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return 0
    both = new.withColumn("__old", F.lit(0))
    if _exists(spark, path):
        held = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        both = both.unionByName(held.withColumn("__old", F.lit(1)))
    order = Window.partitionBy("bucket", *keys).orderBy(F.desc_nulls_last(version), F.desc("__old"), F.xxhash64(*batch.columns))
    best = both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__old")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        best.repartition("bucket").write.partitionBy("bucket").parquet(staged)
        done = spark.read.schema(new.schema).parquet(staged)
        done.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    finally:
        _delete(spark, staged)
    return len(touched)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, system = _folder(spark, path)
    return system.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where, system = _folder(spark, path)
    system.delete(where, True)
