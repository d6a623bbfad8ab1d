"""Queries of sources and sinks (A1 to A11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import language as L
from ..session import shared_folder
from ..sources import tables as S
from .registry import query
from .tables import LINES, lines, table
from .text import _HITS


@query("a1_documents", "SELECT source || '/' || doc_id AS book_key, length(text) AS n_chars, sha256(text) AS text_hash FROM documents")
def a1(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.concat_ws("/", "source", "doc_id").alias("book_key"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query("a2_block_json", "SELECT conv_id AS page_no, role AS layout_tag, text, turn AS reading_order, 'b' || turn AS block_id FROM conversations")
def a2(spark, sf):
    rows = table(spark, sf, "conversations")
    block = F.struct(F.col("role").alias("layout_tag"), "text", F.col("turn").cast("int").alias("reading_order"), F.concat(F.lit("b"), F.col("turn")).alias("block_id"))
    raw = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(block).alias("blocks"))).alias("json"))
    parsed = raw.select(F.col("conv_id").alias("page_no"), F.from_json("json", f"blocks {S.BLOCKS}").alias("r"))
    return parsed.select("page_no", F.explode("r.blocks").alias("b")).select("page_no", "b.*")


_HEADS = r"(SELECT doc_id, left(regexp_replace(text, '(?s)!\[[^\]]*\]\(data:[^)]+\)', '', 'g'), 8000) AS text FROM documents)"


@query(
    "a3_sidecar",
    f"""SELECT doc_id AS book_key, CASE WHEN doc_id % 3 = 0 AND doc_id % 6 > 0 THEN lang WHEN en + fr + de + es = 0 THEN 'unknown' WHEN en = b THEN 'en' WHEN fr = b THEN 'fr' WHEN de = b THEN 'de' ELSE 'es' END AS language,
        CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE n END AS pages_processed
        FROM documents JOIN (SELECT doc_id AS d, count(*) AS n FROM {LINES} GROUP BY 1) ON d = doc_id
        JOIN (SELECT *, greatest(en, fr, de, es) AS b FROM (SELECT doc_id AS h, {_HITS} FROM {_HEADS})) ON h = doc_id""",
)
def a3(spark, sf):
    """Two thirds of the books have no sidecar, and half of the others one without a language."""
    docs = table(spark, sf, "documents")
    told = F.when(F.col("doc_id") % 6 == 0, "unknown").otherwise(F.col("lang"))
    sidecar = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("book_key"), told.alias("language"), F.col("n_chars").alias("pages_processed"))
    books = docs.select(F.col("doc_id").alias("book_key"), L.document_language(F.col("text")).alias("inferred"))
    return S.with_metadata(books, sidecar, lines(spark, sf).withColumnRenamed("doc_id", "book_key"))


@query("a4_golden", "SELECT text AS query, 'en' AS language, item_id AS expected FROM benchmark")
def a4(spark, sf):
    raw = table(spark, sf, "benchmark").select(
        F.to_json(F.struct(F.col("text").alias("query"), F.lit("en").alias("language"), F.array(F.col("item_id").cast("string")).alias("expected_chunk_ids"))).alias("value")
    )
    rows = raw.where(F.trim("value") != "").select(F.from_json("value", S.GOLDEN_QUERY).alias("r")).select("r.*")
    return rows.select("query", "language", F.element_at("expected_chunk_ids", 1).cast("long").alias("expected"))


@query("a5_live_units", "SELECT d.doc_id, lang, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0")
def a5(spark, sf):
    live = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(live, "doc_id")


@query("a6_vector_scan", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE label = 1")
def a6(spark, sf):
    return table(spark, sf, "embeddings").where("label = 1").select("vec_id", "label", F.size("embedding").alias("dims"))


@query(
    "a7_insert_if_absent",
    """WITH t AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0),
       b AS (SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
       SELECT text_hash, doc_id FROM b WHERE text_hash NOT IN (SELECT h FROM t)""",
)
def a7(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return S.insert_if_absent(docs.where("doc_id % 2 = 0"), docs, ["text_hash"], F.col("doc_id"))


@query(
    "a8_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'U' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM orders""",
)
def a8(spark, sf):
    """The orders as a table on disk, and two batches merged into it: news, and old versions that change nothing."""
    path = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}/orders"
    now = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    S.upsert_into(now, path, ["o_orderkey"], "version", 8)
    S.upsert_into(now.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("U").alias("status"), F.lit(2).alias("version")), path, ["o_orderkey"], "version", 8)
    S.upsert_into(now.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("OLD").alias("status"), F.lit(0).alias("version")), path, ["o_orderkey"], "version", 8)
    return spark.read.parquet(path).select("o_orderkey", "status", "version")


@query("a9_jsonl_sink", "SELECT p_partkey, p_name, p_size FROM part")
def a9(spark, sf):
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    S.write_jsonl(part, path)
    return spark.read.schema(part.schema).json(path)


@query(
    "a10_page_assembly",
    """SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '# ' WHEN 'assistant' THEN '- ' ELSE '' END || trim(text), chr(10) || chr(10) ORDER BY turn, 'b' || turn) AS text
       FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id""",
)
def a10(spark, sf):
    rows = table(spark, sf, "conversations")
    blocks = rows.select("conv_id", F.col("role").alias("layout_tag"), "text", F.col("turn").alias("reading_order"), F.concat(F.lit("b"), F.col("turn")).alias("block_id"))
    return S.assemble_pages(blocks, ["conv_id"], {"user": "# ", "assistant": "- "}, ["system"])


@query(
    "a11_part_merge",
    f"""WITH n AS (SELECT source, doc_id, count(*) AS pages FROM {LINES} GROUP BY 1, 2)
       SELECT source, doc_id, pages, coalesce(sum(pages) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM n""",
)
def a11(spark, sf):
    parts = table(spark, sf, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("pages"))
    return S.merge_parts(parts, "source", "doc_id", "pages")
