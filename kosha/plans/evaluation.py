"""Queries of extraction levels, chunk quality and coverage by variant (J6, J8, J9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, sentences
from ..operators import chunks as C
from ..operators import evaluation as V
from ..operators import facts as K
from ..operators import retrieval as R
from ..session import shared_folder
from .analytics import snippets
from .facts import mined
from .registry import ORACLE_SQL, QUERIES, query
from .tables import table


def facts(spark, sf):
    """(fact_id, doc_id, book, subject, predicate, object, type, floor, confidence): the statements of all documents."""
    rows = mined(spark, sf).select("source", "doc_id", "pos", "s", K.fact_type(F.col("s")).alias("type"), K.confidence(F.col("s"), F.lit("en")).alias("confidence"))
    told = K.statements(rows, "s", F.lit("claim")).where("subject <> ''")
    fact = F.format_string("%d-%d", "doc_id", "pos").alias("fact_id")
    return told.select(fact, "doc_id", F.col("source").alias("book"), "subject", "predicate", "object", "type", (F.lit(0.7) * (F.col("doc_id") % 4 == 0).cast("int")).alias("floor"), "confidence")


def both_sides(spark, sf):
    """Facts of documents with even ids are golden, those of the others mined; written once, as matching reads them again."""
    shared_folder(spark)
    rows = facts(spark, sf)
    golden = rows.where("doc_id % 2 = 0").withColumnRenamed("fact_id", "golden_id").drop("confidence", "doc_id")
    found = rows.where("doc_id % 2 = 1").withColumnRenamed("fact_id", "mined_id").drop("floor", "doc_id")
    return golden.checkpoint(), found.checkpoint()


_FACTS = f"""(SELECT doc_id || '-' || pos AS id, doc_id, source AS book, subject, predicate, object, type, 0.7::DOUBLE * (doc_id % 4 = 0)::INT AS floor, confidence
    FROM ({ORACLE_SQL["f7_statement"]}) JOIN ({ORACLE_SQL["f5_fact_type"]}) USING (doc_id, pos) JOIN ({ORACLE_SQL["f9_confidence"]}) USING (doc_id, pos) JOIN (SELECT doc_id, source FROM documents) USING (doc_id))"""
_PAIRED = f"""WITH f AS MATERIALIZED {_FACTS}, e AS (SELECT book, subject, predicate, object, floor AS x, 1 AS side, id FROM f WHERE doc_id % 2 = 0 UNION ALL SELECT book, subject, predicate, object, confidence, 0, id FROM f WHERE doc_id % 2 = 1),
    k AS (SELECT * FROM e WHERE book IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
    c AS (SELECT *, sum(side) OVER w AS g, sum(1 - side) OVER w AS m FROM k WINDOW w AS (PARTITION BY book, subject, predicate, object ORDER BY x DESC, side, id ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT *, g + least(0, min(CASE WHEN side = 1 THEN m - g END) OVER (PARTITION BY book, subject, predicate, object ORDER BY x DESC, side, id ROWS UNBOUNDED PRECEDING)) AS n FROM c),
    b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY book, subject, predicate, object ORDER BY g), 0) AS before FROM n WHERE side = 1),
    p AS (SELECT b.id AS golden_id, y.id AS mined_id FROM b JOIN n y ON y.side = 0 AND y.m = b.n AND y.book = b.book AND y.subject = b.subject AND y.predicate = b.predicate AND y.object = b.object WHERE b.n > b.before),
    t AS (SELECT a.book, count(*) AS found, sum((a.type = z.type)::INT) AS typed FROM p JOIN f a ON a.id = golden_id JOIN f z ON z.id = mined_id GROUP BY 1),
    s AS (SELECT book, count(*) FILTER (WHERE doc_id % 2 = 0) AS golden, count(*) FILTER (WHERE doc_id % 2 = 1) AS mined FROM f GROUP BY 1)"""


@query(
    "j8_extraction",
    f"""{_PAIRED} SELECT s.book, 'exact' AS level, golden, mined, coalesce(found, 0) AS found, coalesce(typed, 0) AS typed, round(coalesce(found, 0) / nullif(mined, 0), 6) AS precision,
        round(coalesce(found, 0) / nullif(golden, 0), 6) AS recall, round(2 * coalesce(found, 0) / nullif(golden + mined, 0), 6) AS f1 FROM s LEFT JOIN t USING (book)""",
)
def j8(spark, sf):
    """The exact level of all facts; j8_levels has all three."""
    golden, found = both_sides(spark, sf)
    made = V.paired(golden, found, ["book", "subject", "predicate", "object"]).withColumn("level", F.lit("exact"))
    return V.extraction_report(golden, found, made, ("exact",))


@query("j8_levels")
def j8_levels(spark, sf):
    """Facts of both sides with the vectors of their statements, matched one to one on three levels."""
    said = F.concat_ws(" ", "subject", "predicate", "object")
    golden, found = (t.withColumn("v", R.hashed_words(said)) for t in both_sides(spark, sf))
    return V.extraction_report(golden, found, V.assignments(golden, found))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_SQUARES = " + ".join(f"pow(sum(u[{i}]), 2)" for i in range(1, 65))


@query(
    "j9_boundary",
    f"""WITH s AS (SELECT vec_id // 100 AS doc, vec_id // 10 AS chunk, vec_id, {_UNIT} AS u FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        c AS (SELECT doc, chunk, count(*) AS n, {_SQUARES} AS q, arg_min(u, vec_id) AS first, arg_max(u, vec_id) AS last FROM s GROUP BY 1, 2),
        e AS (SELECT *, lead(first) OVER (PARTITION BY doc ORDER BY chunk) AS following FROM c),
        r AS (SELECT doc, (q - n) / nullif(n * (n - 1), 0) AS coherence, CASE WHEN following IS NOT NULL THEN list_dot_product(last, following) END AS d FROM e)
        SELECT doc, count(*) AS chunks, round(avg(coherence), 6) AS coherence, avg((coherence > 0.75)::INT) AS coherent, count(d) AS edges, round(avg(d), 6) AS drop, avg((d < 0.5)::INT) AS natural FROM r GROUP BY 1""",
)
def j9_boundary(spark, sf):
    """Given vectors as sentences: ten to a chunk, ten chunks to a document."""
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 100").alias("doc"), F.expr("vec_id div 10").alias("chunk"), "vec_id", "embedding")
    told = V.chunk_quality(V.chunk_signals(rows, "doc", "chunk", "vec_id", "embedding", 64), "doc")
    return told.withColumns({"coherence": F.round("coherence", 6), "drop": F.round("drop", 6)})


@query("j9_chunks")
def j9_chunks(spark, sf):
    """Coherence and boundary drop per source, from the sentences of the window chunks of all documents."""
    told = QUERIES["b8_window_chunks"](spark, sf).select("doc_id", "chunk", V.sentence_digest(sentences(F.col("text"))).alias("d"))
    signals = V.digest_signals(told.select("doc_id", "chunk", "d.*"), "doc_id", "chunk")
    books = table(spark, sf, "documents").select("doc_id", F.col("source").alias("book"))
    return V.chunk_quality(signals.join(books, "doc_id"), "book")


#: The line feed before a heading line.
SECTION_EDGE = r"\n(?=[\p{L}\p{N}_]++\.(?:\n|\z))"
_BODIES = f"""(SELECT 'text' AS variant, source, text, doc_id || '' AS id FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'header', source, x.text, x.doc_id || '-' || section FROM ({ORACLE_SQL["b7_sections"]}) x JOIN documents USING (doc_id)
    UNION ALL SELECT 'window', source, x.text, x.doc_id || '-' || chunk FROM ({ORACLE_SQL["b8_window_chunks"]}) x JOIN documents USING (doc_id))"""


@query(
    "j6_variants",
    rf"""WITH b AS MATERIALIZED {_BODIES}, m AS (SELECT item_id, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 40) AS head FROM benchmark),
        n AS (SELECT variant, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM b),
        h AS (SELECT DISTINCT variant, source, item_id FROM n JOIN m ON contains(body, head)),
        s AS (SELECT source, variant, grouping(source)::INT AS grouped, count(*) AS chunks, round(sum(length(text)) / count(*), 4) AS mean_length FROM b GROUP BY GROUPING SETS ((variant, source), (variant))),
        c AS (SELECT source, variant, grouping(source)::INT AS grouped, count(DISTINCT item_id) AS covered FROM h GROUP BY GROUPING SETS ((variant, source), (variant)))
        SELECT s.source, s.variant, s.grouped, chunks, mean_length, coalesce(covered, 0) AS covered, round(100.0 * coalesce(covered, 0) / (SELECT count(*) FROM m), 4) AS share
        FROM s LEFT JOIN c ON c.variant = s.variant AND c.grouped = s.grouped AND c.source IS NOT DISTINCT FROM s.source""",
)
def j6(spark, sf):
    """Whole texts, sections by heading and overlapping windows, cut where a document lies and searched in one pass over all three."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "source", "text")
    owned = docs.where("doc_id is not null")
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text"))).alias("pages")
    windows = C.window_chunks(owned.select("source", pages), ["source"])
    headed = owned.select("source", F.explode(F.split("text", SECTION_EDGE)).alias("text"))
    parts = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("variant"), "source", "text") for name, t in (("text", docs), ("header", headed), ("window", windows))])
    told = parts.select(F.struct("variant", "source", F.length("text").alias("chars")).alias("of"), collapse(F.lower("text")).alias("body"))
    marks = snippets(spark, sf)
    met = R.containing(told, "of", "body", marks, "item_id", "head", every=True).select("of.*", F.col("item_id").alias("mark"), F.col("head").isNull().alias("own"))
    sums = [F.sum(F.when(F.col("own"), c).otherwise(0)).alias(n) for n, c in (("chunks", F.lit(1)), ("chars", F.col("chars")))]
    return V.coverage_report(met.groupBy("variant", "source", "mark").agg(*sums), marks.count(), "source")
