"""Queries of embedding and retrieval (E)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import preview, snippet
from ..operators import retrieval as R
from .registry import query
from .tables import table

_VEC = "(SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings)"
_TOP = f"""(SELECT * FROM (SELECT q.vec_id AS query_id, x.vec_id, x.label, q.label AS qlabel, array_cosine_similarity(q.v, x.v) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(array_cosine_similarity(q.v, x.v), 9) DESC, x.vec_id) AS rank
    FROM {_VEC} q, {_VEC} x WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))


def asked_of(rows):
    """(query_id, q, qlabel): every row whose id is divisible by 20 is a query."""
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("qlabel"))


def hits(spark, sf, k=10, rows=None):
    every = vectors(spark, sf)
    rows = every if rows is None else rows
    asked = asked_of(every)
    found = R.top_k(asked, rows, k)
    return found.join(rows.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "qlabel"), "query_id")


@query("e1_embed")
def e1(spark, sf):
    return R.embed(table(spark, sf, "documents"), "doc_id", "text")


@query("e2_top_k", f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM {_TOP}")
def e2(spark, sf):
    return hits(spark, sf).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("e3_approximate")
def e3(spark, sf):
    rows = vectors(spark, sf).withColumn("v", F.col("v").cast("array<double>"))
    return R.near_k(asked_of(rows), rows, 10)


@query(
    "e4_payload_filter",
    f"""SELECT query_id, rank, vec_id FROM (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(array_cosine_similarity(q.v, x.v), 9) DESC, x.vec_id) AS rank
        FROM {_VEC} q, {_VEC} x WHERE q.vec_id % 20 = 0 AND x.label IN (1, 2) AND x.vec_id >= 5) WHERE rank <= 10""",
)
def e4(spark, sf):
    rows = R.filtered(vectors(spark, sf), any_of={"label": [1, 2]}, least={"vec_id": 5}, most={"vec_id": None})
    return hits(spark, sf, rows=rows).select("query_id", "rank", "vec_id")


@query(
    "e5_result_shape",
    f"""SELECT query_id, vec_id, round(score, 4) AS score, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE coalesce(text, '') END AS preview, coalesce(source, 'unknown') AS book
        FROM {_TOP} t LEFT JOIN documents d ON d.doc_id = t.vec_id""",
)
def e5(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    out = hits(spark, sf).join(docs, "vec_id", "left")
    return out.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.coalesce(preview(F.col("text")), F.lit("")).alias("preview"), F.coalesce("source", F.lit("unknown")).alias("book"))


@query("e6_batch_search", f"SELECT query_id, count(*) AS hits, sum((label = qlabel)::INT)::BIGINT AS relevant FROM {_TOP} GROUP BY 1")
def e6(spark, sf):
    return hits(spark, sf).groupBy("query_id").agg(F.count("*").alias("hits"), F.sum((F.col("label") == F.col("qlabel")).cast("int")).alias("relevant"))


@query(
    "e7_rerank",
    f"""SELECT query_id, vec_id, round(0.5 * score + 0.2 * (label = qlabel)::INT + 0.2 * (d.lang = 'en')::INT + 0.1 / (1 + abs(query_id - vec_id)), 6) AS score
        FROM {_TOP} t JOIN documents d ON d.doc_id = t.vec_id""",
)
def e7(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    flag = lambda c: c.cast("int")
    total = R.weighted(F.col("score"), flag(F.col("label") == F.col("qlabel")), flag(F.col("lang") == "en"), 1 / (1 + F.abs(F.col("query_id") - F.col("vec_id"))))
    return hits(spark, sf).join(docs, "vec_id").select("query_id", "vec_id", F.round(total, 6).alias("score"))


@query(
    "e8_fusion",
    rf"""WITH d AS (SELECT doc_id, string_split_regex(lower(text), '\s+') AS words FROM documents), q AS (SELECT item_id AS query_id, list_distinct(string_split_regex(lower(text), '\s+')) AS words FROM benchmark),
        s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d), w AS (SELECT query_id, unnest(words) AS w FROM q),
        tf AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS w FROM d) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
        b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM w JOIN tf USING (w) JOIN df USING (w), s GROUP BY 1, 2),
        l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM b),
        r AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(array_cosine_similarity(q.v, x.v), 9) DESC, x.vec_id) AS k
            FROM {_VEC} q, {_VEC} x WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND x.vec_id IN (SELECT doc_id FROM documents))
        SELECT query_id, doc_id, round(coalesce(1 / (60 + l.k), 0) + coalesce(1 / (60 + r.k), 0), 6) AS score
        FROM (SELECT * FROM l WHERE k <= 20) l FULL JOIN (SELECT * FROM r WHERE k <= 20) r USING (query_id, doc_id)""",
)
def e8(spark, sf):
    """Whole query texts by BM25, the vectors of queries and documents by cosine, fused over the union of both lists."""
    split = F.split(F.lower("text"), r"\s+")
    docs = table(spark, sf, "documents").select("doc_id", split.alias("words"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), split.alias("words"))
    scored = R.bm25(docs, asked).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    lexical = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 20").drop("score")
    rows = vectors(spark, sf)
    queries = rows.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    of_docs = rows.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = R.top_k(queries, of_docs, 20).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return R.fuse(lexical, dense).withColumn("score", F.round("score", 6))


@query(
    "e9_evidence",
    """SELECT l_orderkey, l_linenumber, o_custkey, left(p_name, 600) AS snippet, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P'""",
)
def e9(spark, sf):
    chunks = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    books = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    chapters = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), snippet(F.col("p_name")).alias("snippet"), "p_brand")
    return chunks.join(books, "l_orderkey").join(chapters, "l_partkey", "left").select("l_orderkey", "l_linenumber", "o_custkey", "snippet", "p_brand")


@query("e10_indexed", "SELECT DISTINCT source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def e10(spark, sf):
    return table(spark, sf, "documents").join(vectors(spark, sf).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("source").distinct()
