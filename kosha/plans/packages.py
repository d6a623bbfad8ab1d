"""Queries of citations and packages (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packages as P
from .registry import query
from .tables import table

_KNOWN = "(SELECT 'i' || item_id AS id FROM benchmark WHERE item_id % 2 = 0)"
_CITED = "('i' || (turn % 40))"


def paragraphs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.array(F.concat(F.lit("i"), F.col("turn") % 40)).alias("cited"))


def enforced(spark, sf):
    rows = paragraphs(spark, sf)
    items = table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.concat(F.lit("i"), "item_id").alias("id"))
    cited = rows.select("conv_id", F.explode("cited").alias("id")).distinct()
    return P.enforce(rows, cited.join(items, "id"), "conv_id", "turn", "cited", "text")


@query("h1_enforce", f"SELECT conv_id, turn, {_CITED} IN {_KNOWN} AS supported, CASE WHEN {_CITED} IN {_KNOWN} THEN text ELSE '[Interpretation] ' || text END AS text FROM conversations")
def h1(spark, sf):
    return enforced(spark, sf).select("conv_id", "turn", "supported", "text")


@query("h2_scene_policy", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'no citation' END AS warning FROM conversations")
def h2(spark, sf):
    scenes = table(spark, sf, "conversations").withColumn("indices", F.when(F.col("turn") % 3 != 0, F.array("turn")))
    return P.scene_flags(scenes, F.col("role") == "assistant", F.col("indices")).select("conv_id", "turn", "warning")


@query("h3_evidence_map", "SELECT conv_id, turn, item_id, left(b.text, 300) AS snippet FROM conversations c JOIN benchmark b ON b.item_id = c.turn")
def h3(spark, sf):
    refs = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array("turn", F.lit(-1))).alias("item_id"))
    items = table(spark, sf, "benchmark").select("item_id", F.left("text", F.lit(300)).alias("snippet"))
    return refs.join(items, "item_id")


@query(
    "h4_citation_report",
    """SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0) AS cited, count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0) AS chunks, coalesce(string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FILTER (WHERE l_discount > 0 AND l_linenumber > 1), '') AS pages,
       round(avg((l_discount > 0)::INT), 3) AS coverage FROM lineitem GROUP BY 1""",
)
def h4(spark, sf):
    """A line is a paragraph, cited if it has a discount; the first line has no page."""
    cited = F.col("l_discount") > 0
    pages = F.array_join(F.sort_array(F.collect_set(F.when(cited & (F.col("l_linenumber") > 1), F.col("l_linenumber").cast("string")))), ",")
    told = [F.count(F.when(cited, 1)).alias("cited"), F.countDistinct(F.when(cited, F.col("l_partkey"))).alias("chunks"), pages.alias("pages"), F.round(F.avg(cited.cast("int")), 3).alias("coverage")]
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*told)


@query("h5_script", "SELECT conv_id, string_agg('### Scene ' || turn || ': ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS script FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def h5(spark, sf):
    return P.script(table(spark, sf, "conversations").where("text is not null"), "conv_id", "turn", "role", "text")


@query("h6_scene_range", "SELECT p_partkey, greatest(p_size, CASE WHEN p_size % 2 = 0 THEN 8 ELSE 5 END) AS low, least(p_size + 5, CASE WHEN p_size % 2 = 0 THEN 20 ELSE 10 END) AS high FROM part")
def h6(spark, sf):
    even = F.col("p_size") % 2 == 0
    low, high = P.scene_range(F.col("p_size"), F.col("p_size") + 5, F.when(even, 8), F.when(even, 20))
    return table(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query(
    "h7_rollup",
    "SELECT o_orderkey, count(l_orderkey) AS scenes, round(coalesce(sum(l_quantity), 0), 4) AS seconds, round(avg((l_discount > 0.05)::INT), 6) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def h7(spark, sf):
    scenes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", (F.col("l_discount") > 0.05).cast("int").alias("backed"))
    both = table(spark, sf, "orders").select("o_orderkey").join(scenes, "o_orderkey", "left")
    return both.groupBy("o_orderkey").agg(
        F.count("backed").alias("scenes"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 4).alias("seconds"), F.round(F.avg("backed"), 6).alias("coverage")
    )


_TEMPLATES = {"user": 25, "assistant": 40}
_SCENES = r"(SELECT conv_id, turn, role, len(string_split_regex(trim(text), '\s+')) AS words, 10 + 5 * turn AS seconds FROM conversations WHERE trim(text) <> '')"


@query(
    "h8_pacing",
    f"""SELECT conv_id, turn, words, most AS max_words, coalesce(words > most, false) AS too_long, round(words * 60 / seconds, 4) AS per_minute, words * 60 / seconds > 150 AS too_fast
        FROM {_SCENES} LEFT JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in _TEMPLATES.items())}) t(template, most) ON template = role""",
)
def h8(spark, sf):
    """Scenes against their template's words a scene (none: no limit), and 150 words a minute."""
    rows = table(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn", "text", F.col("role").alias("template"), (10 + 5 * F.col("turn")).alias("seconds"))
    templates = spark.createDataFrame(list(_TEMPLATES.items()), "template string, max_words int")
    return P.pacing(rows, templates, "text", "seconds").select("conv_id", "turn", "words", "max_words", "too_long", "per_minute", "too_fast")


@query(
    "h9_versions",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate >= TIMESTAMP '1995-01-01', o_orderkey) AS version FROM orders",
)
def h9(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).alias("new"))
    none = rows.select("o_custkey", F.lit(0).alias("version")).limit(0)
    history = P.next_versions(none, rows.where("not new"), "o_custkey", "o_orderkey")
    return history.unionByName(P.next_versions(history, rows.where("new"), "o_custkey", "o_orderkey")).drop("new")
