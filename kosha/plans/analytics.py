"""Queries of relational analytics (I) and evaluation (J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse
from ..operators import analytics as A
from ..operators import retrieval as R
from .registry import query
from .retrieval import _TOP, asked_of, hits, vectors
from .tables import table
from .text import docs


def orders(spark, sf):
    return table(spark, sf, "orders")


def events(spark, sf):
    return table(spark, sf, "events")


@query(
    "i1_coverage",
    """WITH u AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT o_custkey, sum(n)::BIGINT AS units, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS statuses, sum(CASE WHEN o_orderstatus = 'F' THEN n END) AS ok FROM u GROUP BY 1),
       c AS (SELECT o_custkey, count(*) AS chunks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT c_custkey, coalesce(chunks, 0) AS chunks, coalesce(units, 0) AS units, coalesce(statuses, '') AS statuses, CASE WHEN units > 0 THEN round(coalesce(ok, 0) / units, 4) END AS coverage
       FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""",
)
def i1(spark, sf):
    """A customer is a book, the orders are units, their lines chunks."""
    units = orders(spark, sf).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(units.select("o_orderkey", "c_custkey"), "o_orderkey")
    told = A.book_report(table(spark, sf, "customer"), chunks, units, "c_custkey", "o_orderstatus", "F")
    return told.withColumn("statuses", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query(
    "i2_usage",
    """WITH e AS (SELECT event_type AS operation, CASE WHEN event_id % 9 > 0 THEN (event_id % 9)::VARCHAR END AS book, user_id::VARCHAR AS user, round(coalesce(value, 0) * 10)::BIGINT AS i, round(coalesce(value, 0))::BIGINT AS o FROM events
           WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND (SELECT max(ts) FROM events)),
       g AS (SELECT operation, book, user, grouping(operation, book, user) AS g, count(*) AS calls, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(round((i * 0.005 + o * 0.015) / 1000, 6)) AS cost FROM e GROUP BY GROUPING SETS ((operation), (book), (user), ()))
       SELECT CASE g WHEN 3 THEN 'operation' WHEN 5 THEN 'book' WHEN 6 THEN 'user' ELSE 'total' END AS grouped_by, CASE g WHEN 3 THEN coalesce(operation, 'unknown') WHEN 5 THEN coalesce(book, 'unknown') WHEN 6 THEN coalesce(user, 'unknown') ELSE 'total' END AS k,
       calls, tokens_in, tokens_out, round(cost, 6)::DOUBLE AS cost FROM g""",
)
def i2(spark, sf):
    """Tokens and cost by operation, book and user in the 30 days before the newest event, and their total."""
    rows = events(spark, sf).withColumn("book", F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 9))
    value = F.coalesce("value", F.lit(0.0))
    i, o = F.round(value * 10).cast("long"), F.round(value).cast("long")
    end = rows.agg(F.max("ts")).first()[0]
    made = A.usage(rows, {"operation": "event_type", "book": "book", "user": "user_id"}, {"tokens_in": i, "tokens_out": o, "cost": A.cost(i, o)}, "ts", until=F.lit(end))
    return made.withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query("i3_cost", "SELECT l_orderkey, l_linenumber, round((l_quantity * 100 * 0.005 + l_quantity * 10 * 0.015) / 1000, 6)::DECIMAL(10,6) AS cost FROM lineitem")
def i3(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.cost(q * 100, q * 10).alias("cost"))


@query("i4_distribution", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def i4(spark, sf):
    return orders(spark, sf).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(
    "i5_latest",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""",
)
def i5(spark, sf):
    last = A.latest(orders(spark, sf), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("i6_active_limit", "SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) >= 2")
def i6(spark, sf):
    return orders(spark, sf).where("o_orderstatus in ('O', 'P')").groupBy("o_custkey").agg(F.count("*").alias("active")).where("active >= 2")


@query(
    "i7_keyset",
    """WITH p AS (SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_orderkey FROM p WHERE n BETWEEN 21 AND 40""",
)
def i7(spark, sf):
    rows = orders(spark, sf).select("o_orderdate", "o_orderkey")
    _, _, cursor = A.keyset_page(rows, "o_orderdate", "o_orderkey", None, 20)
    page, _, _ = A.keyset_page(rows, "o_orderdate", "o_orderkey", cursor, 20)
    return page.select("o_orderkey")


@query("i8_soft_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 7 = 0 AND o_orderstatus = 'F')")
def i8(spark, sf):
    mine = (F.col("o_custkey") % 7 == 0) & (F.col("o_orderstatus") == "F")
    return orders(spark, sf).withColumn("deleted_at", F.when(mine, F.lit("2024-01-01"))).where("deleted_at is null").select("o_orderkey")


@query("i9_access", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def i9(spark, sf):
    granted = orders(spark, sf).where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return A.visible(table(spark, sf, "customer"), "c_nationkey", 3, "c_custkey", granted).select("c_custkey")


_WEIGHTS = {"click": 0.2, "view": 0.3, "purchase": 0.1, "signup": 0.4}


@query(
    "i10_progress",
    """SELECT event_id, round(b::DOUBLE + w::DOUBLE * least(1, greatest(0, value / 100)), 5) AS progress FROM events JOIN (VALUES ('click', 0.0, 0.2), ('view', 0.2, 0.3), ('purchase', 0.5, 0.1), ('signup', 0.6, 0.4)) s(stage, b, w) ON stage = event_type WHERE value IS NOT NULL""",
)
def i10(spark, sf):
    stages = A.stage_progress(spark, _WEIGHTS)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    both = events(spark, sf).where("value is not null").join(F.broadcast(stages), F.col("event_type") == F.col("stage"))
    return both.select("event_id", F.round(F.col("before") + F.col("weight") * share, 5).alias("progress"))


@query("i11_substring", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_size = 10")
def i11(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%a%") & (F.col("p_size") == 10)).select("p_partkey", "p_name")


@query("i12_catalogue", "SELECT n_nationkey, n_name AS title, coalesce(lang, 'en') AS language FROM nation LEFT JOIN documents ON doc_id = n_nationkey + 990")
def i12(spark, sf):
    found = docs(spark, sf).select((F.col("doc_id") - 990).alias("n_nationkey"), "lang")
    return table(spark, sf, "nation").join(found, "n_nationkey", "left").select("n_nationkey", F.col("n_name").alias("title"), F.coalesce("lang", F.lit("en")).alias("language"))


@query("i13_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS rate FROM events GROUP BY 1, 2")
def i13(spark, sf):
    grouped = events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    made = grouped.agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("rate"))
    return made.select(F.col("w.start").alias("hour"), "event_type", "n", "rate")


@query("i14_search_log", "SELECT event_type, ts::DATE AS day, count(*) AS n, round(avg((value < 1)::INT), 6) AS empty_rate, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1, 2")
def i14(spark, sf):
    return (
        events(spark, sf)
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") < 1).cast("int")), 6).alias("empty_rate"), F.round(F.expr("percentile(value, 0.95)"), 4).alias("p95"))
    )


@query("i14_retention", "SELECT event_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY + INTERVAL 0 DAY THEN user_id END AS user_id, event_type, value FROM events")
def i14_retention(spark, sf):
    """The search log as it is 80 days after its newest row: users of rows older than 90 days are gone."""
    rows = events(spark, sf)
    end = F.lit(rows.agg(F.max("ts")).first()[0]) + F.expr("interval 80 days")
    return A.retained(rows.select("event_id", "ts", "user_id", "event_type", "value"), "ts", end, {"user_id": (90, F.lit(None).cast("long"))}).drop("ts")


@query(
    "i15_masked",
    """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY THEN '10.0.' || (user_id % 200) || '.7' ELSE '10.0.x.x' END AS ip FROM events""",
)
def i15_masked(spark, sf):
    """Erased users lose their identity, and addresses their last parts after two years (720 days after the newest row)."""
    rows = events(spark, sf)
    end = F.lit(rows.agg(F.max("ts")).first()[0]) + F.expr("interval 720 days")
    erased = rows.where("user_id % 10 = 0").select("user_id").distinct().withColumn("erased", F.lit(True))
    told = rows.join(erased, "user_id", "left").select("event_id", "ts", F.when(F.col("erased").isNull(), F.col("user_id")).alias("user_id"), F.concat(F.lit("10.0."), F.col("user_id") % 200, F.lit(".7")).alias("ip"))
    masked = F.regexp_replace("ip", r"^(\d+\.\d+)\..*$", "$1.x.x")
    return A.retained(told, "ts", end, {"ip": (730, masked)}).drop("ts")


@query("i15_retention", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events")
def i15(spark, sf):
    erased = events(spark, sf).where("user_id % 10 = 0").select("user_id").distinct().withColumn("erased", F.lit(True))
    rows = events(spark, sf).join(erased, "user_id", "left")
    return rows.select("event_id", F.when(F.col("erased").isNull(), F.col("user_id")).alias("user_id"), "event_type")


@query(
    "i16_reassign",
    "SELECT coalesce(s_suppkey, k) AS s_suppkey, CASE WHEN k IS NULL THEN 'delete' WHEN s_suppkey IS NULL THEN 'insert' ELSE 'own' END AS action FROM supplier FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) ON k = s_suppkey",
)
def i16(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("s_suppkey")).distinct().withColumn("wanted", F.lit(1))
    held = table(spark, sf, "supplier").select("s_suppkey", F.lit(1).alias("held"))
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("held").isNull(), "insert").otherwise("own")
    return held.join(wanted, "s_suppkey", "full").select("s_suppkey", action.alias("action"))


@query("i17_counts", "SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def i17_counts(spark, sf):
    return A.store_counts({n: table(spark, sf, n) for n in ("documents", "labels", "embeddings")})


@query("i17_reconcile", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def i17(spark, sf):
    return A.reconcile(docs(spark, sf), table(spark, sf, "labels"), "doc_id")


# a vector's book is its id modulo 7, and every third vector has no citation
_METRICS = f"""(SELECT h.query_id, good / n_true AS recall, good / n AS precision, met / n_books AS book_recall, med AS median_score, cites / n AS citation_share, cites / n >= 0.6 AS citation_ok FROM
    (SELECT query_id, qlabel AS label, count(*) AS n, count(*) FILTER (WHERE label = qlabel) AS good, median(score) AS med, count(*) FILTER (WHERE vec_id % 3 > 0) AS cites FROM {_TOP} GROUP BY 1, 2) h JOIN (SELECT label, count(*) AS n_true FROM embeddings GROUP BY 1) USING (label)
    JOIN (SELECT query_id, count(*) AS n_books, count(m) AS met FROM (SELECT q.vec_id AS query_id, b.book, t.query_id AS m FROM embeddings q JOIN (SELECT DISTINCT label, vec_id % 7 AS book FROM embeddings) b ON b.label = q.label
        LEFT JOIN (SELECT DISTINCT query_id, vec_id % 7 AS book FROM {_TOP}) t ON t.query_id = q.vec_id AND t.book = b.book WHERE q.vec_id % 20 = 0) GROUP BY 1) k ON k.query_id = h.query_id)"""


def metrics(spark, sf, k=10):
    """Every row of a query's label is relevant and its book expected, so counts by label stand for the pairs."""
    rows = vectors(spark, sf).withColumn("book", F.col("vec_id") % 7)
    sizes = rows.groupBy("label").agg(F.count("*").alias("n_true"))
    asked = asked_of(rows).select("query_id", F.col("qlabel").alias("label"))
    n_true = asked.join(sizes, "label").select("query_id", "n_true")
    expected = asked.join(rows.select("label", "book").distinct(), "label").select("query_id", "book")
    found = hits(spark, sf, k).select("query_id", "vec_id", "score", "label", "qlabel", (F.col("vec_id") % 7).alias("book"), (F.col("vec_id") % 3 > 0).alias("cited"))
    good = found.where("label = qlabel").select("query_id", "vec_id")
    return A.retrieval_metrics(found, good, 0.6, n_true, expected)


_ROUNDED = ["recall", "precision", "book_recall", "median_score", "citation_share"]


@query("j1_metrics", f"SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}, citation_ok FROM {_METRICS}")
def j1(spark, sf):
    return metrics(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in _ROUNDED], "citation_ok")


@query(
    "j2_macro",
    f"""WITH m AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'a' ELSE 'b' END AS lang FROM {_METRICS}) SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
        round(avg(book_recall), 6) AS book_recall, round(avg((recall >= 0.02 AND citation_ok)::INT), 6) AS pass_rate FROM m GROUP BY ROLLUP (lang)""",
)
def j2(spark, sf):
    rows = metrics(spark, sf).withColumn("lang", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b"))
    return A.macro_summary(rows, "lang", 0.02)


@query(
    "j3_gate",
    f"""WITH h AS (SELECT query_id, qlabel AS label, count(*) FILTER (WHERE label = qlabel) AS good, count(*) FILTER (WHERE label = qlabel AND rank <= 5) AS good5 FROM {_TOP} GROUP BY 1, 2),
        n AS (SELECT label, count(*) AS n_true FROM embeddings GROUP BY 1) SELECT round(avg(good / n_true), 6) AS baseline, round(avg(good5 / n_true), 6) AS current, avg(good / n_true) - avg(good5 / n_true) > 0.05 AS failed FROM h JOIN n USING (label)""",
)
def j3(spark, sf):
    runs = metrics(spark, sf).select(F.lit("base").alias("run"), "recall").unionByName(metrics(spark, sf, 5).select(F.lit("now").alias("run"), "recall"))
    b, c = (F.avg(F.when(F.col("run") == r, F.col("recall"))) for r in ("base", "now"))
    return runs.agg(F.round(b, 6).alias("baseline"), F.round(c, 6).alias("current"), (b - c > 0.05).alias("failed"))


@query("j4_bootstrap", f"SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS expected FROM {_TOP} GROUP BY 1")
def j4(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string"))
    return hits(spark, sf).groupBy("query_id").agg(F.array_join(ids, ",").alias("expected"))


def snippets(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.left(collapse(F.lower("text")), F.lit(40)).alias("head"))


_HEADS = r"(SELECT item_id, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 40) AS head FROM benchmark)"
_BODY = r"(SELECT doc_id, length(text) AS len, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM documents)"


def located(spark, sf):
    """(item_id, doc_id): snippets whose head a text contains."""
    body = docs(spark, sf).select("doc_id", collapse(F.lower("text")).alias("body"))
    return R.containing(body, "doc_id", "body", snippets(spark, sf), "item_id", "head").select("item_id", "doc_id")


@query("j5_coverage", f"SELECT item_id, count(doc_id) > 0 AS hit, count(doc_id) AS found FROM {_HEADS} LEFT JOIN {_BODY} ON contains(body, head) GROUP BY 1")
def j5(spark, sf):
    counted = located(spark, sf).groupBy("item_id").agg(F.count("*").alias("found"))
    both = snippets(spark, sf).select("item_id").join(counted, "item_id", "left")
    return both.select("item_id", F.col("found").isNotNull().alias("hit"), F.coalesce("found", F.lit(0)).alias("found"))


@query("j7_hit_rank", f"SELECT query_id, min(rank) AS first, min(rank) <= 1 AS hit1, min(rank) <= 3 AS hit3 FROM {_TOP} WHERE label = qlabel AND vec_id <> query_id GROUP BY 1")
def j7(spark, sf):
    good = hits(spark, sf).where("label = qlabel and vec_id <> query_id")
    first = F.min("rank")
    return good.groupBy("query_id").agg(first.alias("first"), (first <= 1).alias("hit1"), (first <= 3).alias("hit3"))


_SUMS = " + ".join(f"pow(sum(embedding[{i}]::DOUBLE), 2)" for i in range(1, 65))


@query("j9_coherence", f"SELECT label, count(*) AS n, round(({_SUMS} - count(*)) / (count(*) * (count(*) - 1)), 6) AS coherence FROM embeddings GROUP BY 1")
def j9(spark, sf):
    return A.coherence(vectors(spark, sf), "label", "v", 64).withColumn("coherence", F.round("coherence", 6))


@query(
    "j10_kappa",
    """SELECT n, round((s - c) / (1 - c), 6) AS kappa FROM (SELECT count(*) AS n, avg((quality = 1 - toxic)::INT) AS s, avg(quality) * avg(1 - toxic) + (1 - avg(quality)) * (1 - avg(1 - toxic)) AS c FROM labels)""",
)
def j10(spark, sf):
    return A.kappa(table(spark, sf, "labels").withColumn("civil", 1 - F.col("toxic")), "quality", "civil")


@query("j11_lint", "SELECT item_id, (CASE WHEN length(text) > 300 THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END) + (CASE WHEN n > 1 THEN 1 ELSE 0 END) AS broken FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM benchmark)")
def j11(spark, sf):
    n = F.count("*").over(Window.partitionBy("item_id"))
    rules = [F.length("text") > 300, F.trim(F.coalesce("text", F.lit(""))) == "", F.col("n") > 1]
    return table(spark, sf, "benchmark").withColumn("n", n).select("item_id", sum((r.cast("int") for r in rules), F.lit(0)).alias("broken"))
