"""Queries of the concept graph (G)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..session import shared_folder
from .registry import query
from .tables import table
from .text import docs

# nations and regions, suppliers and customers, as one graph of text keys
_EDGES = """(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS rel FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'FROM' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'FROM' FROM customer)"""


def graph(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    nation = table(spark, sf, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("IN").alias("rel"))
    supplier = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("FROM").alias("rel"))
    customer = table(spark, sf, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("FROM").alias("rel"))
    return nation.unionByName(supplier).unionByName(customer)


_REL_WHOLE = "CASE key " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in G.RELATIONS.items()) + " END"
_REL = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in G.RELATIONS.items()) + " END"


@query(
    "g1_relation_type",
    rf"""WITH p AS (SELECT p_partkey, lower(trim(p_name || ' ' || p_type)) AS key FROM part UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Is A' WHEN 1 THEN 'causes ' || lower(p_name) ELSE '12 ' || p_name END FROM part),
        k AS (SELECT p_partkey, lower(key) AS key, string_split_regex(lower(key), '\s+')[1] AS k,
        regexp_replace(regexp_replace(upper(key), '[\s\-]+', '_', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g') AS own FROM p)
        SELECT p_partkey, coalesce({_REL_WHOLE}, {_REL}, CASE WHEN regexp_matches(own, '^\p{{L}}') THEN left(own, 50) END, 'RELATES_TO') AS rel FROM k""",
)
def g1(spark, sf):
    part = table(spark, sf, "part")
    named = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("predicate"))
    odd = F.when(F.col("p_partkey") % 3 == 0, "Is A").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("causes "), F.lower("p_name"))).otherwise(F.concat(F.lit("12 "), "p_name"))
    return named.unionByName(part.select("p_partkey", odd.alias("predicate"))).select("p_partkey", G.relation_type(F.col("predicate")).alias("rel"))


@query(
    "g2_labels",
    "SELECT doc_id, CASE source WHEN 'src1' THEN 'Concept:Crop' WHEN 'src2' THEN 'Concept:Soil' ELSE 'Concept' END AS label, CASE WHEN lang IN ('en', 'mr', 'hi', 'sa') THEN 'label_' || lang ELSE 'label_en' END AS prop FROM documents",
)
def g2(spark, sf):
    labels = {"src1": "Crop", "src2": "Soil"}
    return docs(spark, sf).select("doc_id", G.node_label(F.col("source"), labels).alias("label"), G.label_column(F.col("lang")).alias("prop"))


@query(
    "g3_routes",
    """SELECT route, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'process' WHEN o_custkey % 3 > 0 THEN 'relation' ELSE 'definition' END AS route FROM orders) WHERE route IS NOT NULL GROUP BY 1""",
)
def g3(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("live")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "process").otherwise("claim")
    what = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string"))
    routed = table(spark, sf, "orders").select(G.route(status, F.col("o_orderkey").cast("string"), kind, what).alias("route"))
    return routed.where("route is not null").groupBy("route").agg(F.count("*").alias("n"))


_NODES = """WITH u AS (SELECT 'p' || l_partkey AS key, 'part ' || l_linenumber AS label, CASE WHEN l_returnflag = 'R' THEN 'mr' ELSE 'en' END AS language, l_orderkey AS book, l_shipdate AS ts, l_orderkey AS o, l_linenumber AS n FROM lineitem
    UNION ALL SELECT 's' || l_suppkey, 'supp ' || l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'mr' ELSE 'en' END, l_orderkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem)"""


def units(spark, sf, live: str = "true"):
    c = F.col
    return table(spark, sf, "lineitem").where(live).select(
        F.concat(F.lit("p"), "l_partkey").alias("subject"), F.concat(F.lit("part "), "l_linenumber").alias("subject_label"),
        F.concat(F.lit("s"), "l_suppkey").alias("object"), F.concat(F.lit("supp "), "l_linenumber").alias("object_label"),
        F.when(c("l_returnflag") == "R", "mr").otherwise("en").alias("language"), c("l_orderkey").alias("book"), c("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_returnflag", "l_discount",
    )


def concept_nodes(spark, sf):
    return G.nodes(units(spark, sf), [("subject", "subject_label"), ("object", "object_label")], ["l_orderkey", "l_linenumber"], ["en", "mr"])


@query(
    "g4_nodes",
    f"""{_NODES} SELECT key, arg_max(label, (o, n, label)) FILTER (WHERE language = 'en') AS label_en, arg_max(label, (o, n, label)) FILTER (WHERE language = 'mr') AS label_mr,
        count(DISTINCT book) AS books, min(ts) AS first_seen FROM u GROUP BY key""",
)
def g4(spark, sf):
    return concept_nodes(spark, sf).withColumn("books", F.size("books").cast("long"))


@query(
    "g5_edges",
    """SELECT l_partkey, l_suppkey, l_returnflag AS rel, max(l_orderkey) AS unit, arg_max(l_discount, (l_orderkey, l_linenumber, l_discount)) AS confidence, count(*) AS evidence FROM lineitem GROUP BY 1, 2, 3""",
)
def g5(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("rel"), F.col("l_orderkey").alias("unit"), "l_linenumber", F.col("l_discount").alias("confidence"))
    return G.weighed_edges(rows, ["l_partkey", "l_suppkey", "rel"], "unit", "confidence", ["unit", "l_linenumber"])


@query(
    "g6_steps",
    "SELECT conv_id || '_process' AS process, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_order, text AS step FROM conversations",
)
def g6(spark, sf):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"])
    units_ = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("key")).agg(ordered.alias("steps"))
    return G.steps(units_, "key", "steps")


@query("g7_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') ORDER BY p_partkey LIMIT 25")
def g7(spark, sf):
    low = [F.contains(F.lower(c), F.lit("a")) for c in ("p_name", "p_brand")]
    return table(spark, sf, "part").where(low[0] | low[1]).orderBy("p_partkey").limit(25).select("p_partkey", "p_name")


@query(
    "g8_detail",
    f"""WITH e AS (SELECT node, way || ':' || rel || ':' || other AS link FROM (SELECT src AS node, dst AS other, rel, 'out' AS way FROM {_EDGES} UNION ALL SELECT dst, src, rel, 'in' FROM {_EDGES})),
        k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY link) AS n, count(*) OVER (PARTITION BY node) AS evidence FROM e)
        SELECT node, string_agg(link, ',' ORDER BY link) AS links, min(evidence) AS evidence FROM k WHERE n <= 50 GROUP BY node""",
)
def g8(spark, sf):
    e = graph(spark, sf)
    out = e.select(F.col("src").alias("node"), F.concat_ws(":", F.lit("out"), "rel", "dst").alias("link"))
    into = e.select(F.col("dst").alias("node"), F.concat_ws(":", F.lit("in"), "rel", "src").alias("link"))
    every = out.unionByName(into)
    counted = every.groupBy("node").agg(F.count("*").alias("evidence"))
    # a page of links for each node, so a node with most of the edges is no array of them
    page = G.first_edges(every.withColumnRenamed("node", "src"), 50, ["link"]).groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("link")), ",").alias("links"))
    return page.join(counted, "node")


@query(
    "g9_neighbourhood",
    f"""WITH RECURSIVE b AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), w AS (SELECT 'n' || n_nationkey AS node, 0 AS hop FROM nation WHERE n_regionkey = 1 UNION SELECT b.dst, hop + 1 FROM w JOIN b ON b.src = w.node WHERE hop < 3)
        SELECT node, min(hop) AS hop FROM w GROUP BY node""",
)
def g9(spark, sf):
    seeds = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return G.neighbourhood(graph(spark, sf), seeds, 3)


# every vector and a variant of it, as two spellings of a concept
_VARIANTS = """(SELECT vec_id * 2 AS vec_id, embedding::DOUBLE[64] AS v FROM embeddings
    UNION ALL SELECT vec_id * 2 + 1, list_transform(embedding::DOUBLE[64], lambda x, i: x * (1 + 0.2 * ((i + vec_id) % 3 - 1)))::DOUBLE[64] FROM embeddings)"""
_PAIRS = f"""(WITH v AS (SELECT * FROM {_VARIANTS}), p AS (SELECT a.vec_id AS me, b.vec_id AS other, array_cosine_similarity(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY me ORDER BY round(score, 9) DESC, other) AS n FROM p WHERE score >= 0.92)
    SELECT least(me, other) AS a, greatest(me, other) AS b, round(max(score), 4) AS score FROM k WHERE n <= 5 GROUP BY 1, 2)"""


def same_as(spark, sf, threshold=0.92):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    other = v.select("id", F.transform("v", lambda x, i: x * (1 + F.lit(0.2) * ((i + 1 + F.col("id")) % 3 - 1))).alias("v"))
    both = v.select((F.col("id") * 2).alias("vec_id"), "v").unionByName(other.select((F.col("id") * 2 + 1).alias("vec_id"), "v"))
    return R.similar_pairs(both, threshold, 5, recall=0.999999)


@query("g10_same_as", f"SELECT a, b, score FROM {_PAIRS}")
def g10(spark, sf):
    return same_as(spark, sf)


@query("g11_primary_label", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_acctbal > 0 THEN c_name END), ''), nullif(trim(c_mktsegment), '')) AS label FROM customer")
def g11(spark, sf):
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(filled(F.when(F.col("c_acctbal") > 0, F.col("c_name"))), filled(F.col("c_mktsegment"))).alias("label"))


@query(
    "g12_clusters",
    f"""WITH RECURSIVE e AS (SELECT a AS x, b AS y FROM {_PAIRS} UNION SELECT b, a FROM {_PAIRS}), r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
        SELECT node, min(root) AS root FROM r GROUP BY node""",
)
def g12(spark, sf):
    return G.components(same_as(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(
    "g9_edges",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst, rel FROM {_EDGES} WHERE rel = 'FROM'), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        w AS (SELECT 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_suppkey <= 3 UNION SELECT b.dst, hop + 1 FROM w JOIN b ON b.src = w.node WHERE hop < 3), n AS (SELECT node, min(hop) AS hop FROM w GROUP BY 1)
        SELECT src, dst, rel, least(x.hop, y.hop) + 1 AS hop FROM e JOIN n x ON x.node = src JOIN n y ON y.node = dst WHERE least(x.hop, y.hop) + 1 <= 3""",
)
def g9_edges(spark, sf):
    """Edges of one relation type within three hops of three suppliers."""
    seeds = table(spark, sf, "supplier").where("s_suppkey <= 3").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.subgraph(graph(spark, sf), seeds, 3, ["FROM"])


# every part but the first of a run of four goes into the one before it, so renames form chains
_MERGES = "(SELECT 'p' || p_partkey AS old, 'p' || (p_partkey - p_partkey % 4) AS new FROM part WHERE p_partkey % 4 <> 0 AND p_partkey > 4)"


def part_merges(spark, sf):
    key = lambda c: F.concat(F.lit("p"), c)
    k = F.col("p_partkey")
    return table(spark, sf, "part").where("p_partkey % 4 <> 0 and p_partkey > 4").select(key(k).alias("old"), key(k - 1).alias("new"))


def merged(spark, sf):
    rows = units(spark, sf)
    links = rows.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("l_returnflag").alias("rel"))
    return G.merge_concepts(concept_nodes(spark, sf), links, rows.select("l_orderkey", "l_linenumber", "subject", "object"), part_merges(spark, sf), ["label_en", "label_mr"], ["subject", "object"], ["rel"])


@query(
    "g13_merge",
    f"""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS rel FROM lineitem)
        SELECT DISTINCT coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst, rel FROM e LEFT JOIN {_MERGES} a ON a.old = src LEFT JOIN {_MERGES} b ON b.old = dst WHERE coalesce(a.new, src) <> coalesce(b.new, dst)""",
)
def g13(spark, sf):
    return merged(spark, sf)[1]


@query(
    "g13_nodes",
    f"""WITH n AS ({_NODES} SELECT key, arg_max(label, (o, n, label)) FILTER (WHERE language = 'en') AS label_en, arg_max(label, (o, n, label)) FILTER (WHERE language = 'mr') AS label_mr, list(DISTINCT book) AS books, min(ts) AS first_seen FROM u GROUP BY key),
        m AS (SELECT n.*, coalesce(new, key) AS home FROM n LEFT JOIN {_MERGES} ON old = key),
        g AS (SELECT home AS key, arg_min(label_en, (key <> home, key)) FILTER (WHERE label_en IS NOT NULL) AS label_en, arg_min(label_mr, (key <> home, key)) FILTER (WHERE label_mr IS NOT NULL) AS label_mr,
              len(list_distinct(flatten(list(books)))) AS books, min(first_seen) AS first_seen, list_distinct(flatten(list([label_en, label_mr]))) AS l FROM m GROUP BY 1)
        SELECT key, label_en, label_mr, books, first_seen, array_to_string(list_sort([x for x in l if x IS NOT NULL AND x IS DISTINCT FROM label_en AND x IS DISTINCT FROM label_mr]), ',') AS aliases FROM g""",
)
def g13_nodes(spark, sf):
    made = merged(spark, sf)[0]
    return made.withColumns({"books": F.size("books").cast("long"), "aliases": F.array_join("aliases", ",")})


@query("g13_units", f"SELECT l_orderkey, l_linenumber, coalesce(new, 'p' || l_partkey) AS subject, 's' || l_suppkey AS object FROM lineitem LEFT JOIN {_MERGES} ON old = 'p' || l_partkey")
def g13_units(spark, sf):
    return merged(spark, sf)[2]


@query(
    "g14_beats",
    f"""WITH c AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE contains(lower(n_name), '1') ORDER BY 1 LIMIT 5), b AS (SELECT src, dst, rel FROM {_EDGES} UNION SELECT dst, src, rel FROM {_EDGES}),
        e AS (SELECT node, dst, rel, row_number() OVER (PARTITION BY node ORDER BY dst, rel) AS n FROM c JOIN b ON src = node), k AS (SELECT * FROM e WHERE n <= 10)
        SELECT c.node, coalesce((SELECT string_agg(rel, ',' ORDER BY rel) FROM (SELECT DISTINCT rel FROM k WHERE k.node = c.node ORDER BY 1 LIMIT 3)), 'RELATES_TO') AS intent,
        coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT DISTINCT dst FROM k WHERE k.node = c.node ORDER BY 1 LIMIT 8)), '') AS related FROM c""",
)
def g14(spark, sf):
    """Concepts whose label holds the searched text, and what surrounds them."""
    named = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), "n_name")
    found = named.where(F.contains(F.lower("n_name"), F.lit("1"))).orderBy("node").limit(5).select("node")
    return G.beats(graph(spark, sf), found)


_LABELLED = """(SELECT 'n' || n_nationkey AS node, n_name AS label, 'Region' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END, NULL FROM supplier
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END FROM customer)"""
_SAME = "(SELECT 'c' || c_custkey AS src, 'c' || (c_custkey - 1) AS dst, 'SAME_AS' AS rel FROM customer WHERE c_custkey % 50 = 0 AND c_custkey > 0)"


def labelled(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c)).alias("node")
    paid = lambda c, n: F.when(F.col(c) > 0, F.col(n)).alias("label")
    nation = table(spark, sf, "nation").select(key("n", "n_nationkey"), F.col("n_name").alias("label"), F.lit("Region").alias("type"))
    supplier = table(spark, sf, "supplier").select(key("s", "s_suppkey"), paid("s_acctbal", "s_name"), F.lit(None).cast("string").alias("type"))
    customer = table(spark, sf, "customer").select(key("c", "c_custkey"), paid("c_acctbal", "c_name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("type"))
    return nation.unionByName(supplier).unionByName(customer)


@query(
    "g15_quality",
    f"""WITH e AS (SELECT * FROM {_EDGES} UNION ALL SELECT * FROM {_SAME}), l AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
        SELECT count(*) AS nodes, round(avg((l.node IS NULL)::INT), 6) AS orphan_rate, round(avg((coalesce(label, '') <> '')::INT), 6) AS label_coverage, round(avg((type IS NOT NULL)::INT), 6) AS type_coverage,
        (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE rel = 'SAME_AS') AS same_as FROM {_LABELLED} n LEFT JOIN l ON l.node = n.node""",
)
def g15(spark, sf):
    c = F.col("c_custkey")
    same = table(spark, sf, "customer").where("c_custkey % 50 = 0 and c_custkey > 0").select(F.concat(F.lit("c"), c).alias("src"), F.concat(F.lit("c"), c - 1).alias("dst"), F.lit("SAME_AS").alias("rel"))
    return G.quality(labelled(spark, sf), graph(spark, sf).unionByName(same))


@query("g16_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def g16(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey")
    with_edge = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    with_unit = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("c_custkey"))
    return rows.join(with_edge, "c_custkey", "left_anti").join(with_unit, "c_custkey", "left_anti")


@query(
    "g17_export",
    f"""SELECT dst AS node, string_agg(left(dst, 20) || ' <-' || rel || '- ' || left(src, 20), chr(10) ORDER BY src) AS text FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM {_EDGES}) WHERE n <= 15 GROUP BY dst""",
)
def g17(spark, sf):
    e = graph(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel")
    line = F.struct(F.col("dst").alias("o"), F.concat(F.left("src", F.lit(20)), F.lit(" <-"), "rel", F.lit("- "), F.left("dst", F.lit(20))).alias("t"))
    few = G.first_edges(e, 15, ["dst"])
    return few.groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))


@query(
    "g18_rebuild",
    """WITH live AS (SELECT * FROM lineitem WHERE l_linestatus <> 'F') SELECT 'nodes' AS what, count(*) AS n FROM (SELECT 'p' || l_partkey FROM live UNION SELECT 's' || l_suppkey FROM live)
       UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM live) UNION ALL SELECT 'processes', count(DISTINCT l_orderkey) FROM live
       UNION ALL SELECT 'steps', count(*) FROM live UNION ALL SELECT 'type ' || l_returnflag, count(*) FROM live GROUP BY 1""",
)
def g18(spark, sf):
    """Nodes, edges and processes of all live units as tables; what they hold is counted from the written tables."""
    rows = units(spark, sf, "l_linestatus <> 'F'")
    steps = rows.groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "subject"))), lambda x: x["subject"]).alias("steps"))
    made = {
        "nodes": G.nodes(rows, [("subject", "subject_label"), ("object", "object_label")], ["l_orderkey", "l_linenumber"], ["en", "mr"]),
        "edges": G.weighed_edges(rows, ["subject", "object", "l_returnflag"], "l_orderkey", "l_discount", ["l_orderkey", "l_linenumber"]),
        "steps": G.steps(steps, "key", "steps"),
        "types": rows.groupBy("l_returnflag").agg(F.count("*").alias("n")),
    }
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    for name, df in made.items():
        df.write.parquet(f"{root}/{name}")
    kept = {name: spark.read.parquet(f"{root}/{name}") for name in made}
    told = [kept[n].agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n in ("nodes", "edges", "steps")]
    told += [kept["steps"].agg(F.lit("processes").alias("what"), F.countDistinct("process").alias("n")), kept["types"].select(F.concat(F.lit("type "), "l_returnflag").alias("what"), "n")]
    return functools.reduce(DataFrame.unionByName, told)
