"""Queries of knowledge units (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import phrase, uuid5
from ..operators import facts as K
from .registry import query
from .tables import table
from .text import _NS, _SENTENCES, docs, sentence_rows


def _any(words, c="low"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _case(rules, default):
    return "CASE " + " ".join(f"WHEN {_any(ws)} THEN '{v}'" for v, ws in rules) + f" ELSE '{default}' END"


def _phrase(c, n):
    bare = rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^[ ,;:\-]+|[ ,;:\-]+$', '', 'g')"
    return rf"(CASE WHEN length({bare}) > {n} THEN regexp_replace(left({bare}, {n}), '[ ,;:\-]+$', '') ELSE {bare} END)"


_S = f"(SELECT *, lower(s) AS low FROM {_SENTENCES} WHERE length(s) BETWEEN 60 AND 330)"
_SCORE = rf"""(regexp_matches(s, '\d')::INT * 2.0 + {_any(K.UNITS)}::INT * 1.5 + {_any(K.VERBS)}::INT * 2.0 + {_any(K.NOUNS)}::INT * 1.0
    + {_any(K.COMPARING)}::INT * 1.0 - {_any(K.HEDGES)}::INT * 0.5)::DOUBLE"""


def mined(spark, sf):
    return sentence_rows(spark, sf).where(F.length("s").between(60, 330))


@query("f1_parse_responses", "SELECT event_id, false AS rejected, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def f1(spark, sf):
    body = F.concat(F.lit('```json\n{"units": ['), F.col("props"), F.lit("]}\n```")).alias("body")
    rows = table(spark, sf, "events").where("props is not null").select("event_id", body)
    found = K.parse_responses(rows, "event_id", "body", "units array<struct<k:long>>")
    return found.select("event_id", "rejected", F.col("unit.k").alias("k"))


@query(
    "f2_validate",
    """SELECT doc_id, (CASE WHEN lang = 'en' THEN 0 ELSE 1 END) + (CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) + (CASE WHEN length(text) > 600 THEN 1 ELSE 0 END) AS broken FROM documents""",
)
def f2(spark, sf):
    unit = F.struct(
        F.when(F.col("lang") == "en", "definition").otherwise("other").alias("type"), F.lit("soil").alias("domain_type"), F.lit("is").alias("predicate"),
        F.col("source").alias("subject"), F.lit(None).cast("string").alias("object"), F.when(F.col("n_chars") > 2000, 1.5).otherwise(0.5).alias("confidence"),
        F.array(F.struct(F.col("text").alias("snippet"))).alias("evidence"),
    )
    return docs(spark, sf).select("doc_id", unit.alias("unit")).select("doc_id", F.size(K.failures("unit")).alias("broken"))


@query(
    "f3_normalise",
    """SELECT d.doc_id, CASE WHEN quality * 0.5 + 0.2 < 0.65 THEN 'needs_review' ELSE 'extracted' END AS status, json_object('domain_type', lang) AS payload, replace(source, chr(0), '') AS subject
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def f3(spark, sf):
    both = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    payload = F.to_json(F.struct(F.col("lang").alias("domain_type")))
    return both.select("doc_id", K.status_of(F.col("quality") * 0.5 + 0.2).alias("status"), payload.alias("payload"), F.regexp_replace("source", "\\x00", "").alias("subject"))


@query("f4_salience", f"SELECT doc_id, pos, {_SCORE} AS score FROM {_S} WHERE {_SCORE} >= 2")
def f4(spark, sf):
    return mined(spark, sf).select("doc_id", "pos", K.salience(F.col("s")).alias("score")).where("score >= 2")


@query("f5_fact_type", f"SELECT doc_id, pos, {_case(K.TYPE_RULES, 'claim')} AS type FROM {_S}")
def f5(spark, sf):
    return mined(spark, sf).select("doc_id", "pos", K.fact_type(F.col("s")).alias("type"))


@query("f6_domain_type", f"SELECT doc_id, pos, {_case(K.DOMAIN_RULES, 'general')} AS domain FROM {_S}")
def f6(spark, sf):
    return mined(spark, sf).select("doc_id", "pos", K.domain_type(F.col("s")).alias("domain"))


_AT = "CASE " + " ".join(f"WHEN instr(low, '{m}') > 2 THEN instr(low, '{m}') - 1" for m in K.MARKERS) + " ELSE -1 END"
_MARK = "CASE " + " ".join(f"WHEN instr(low, '{m}') > 2 THEN '{m.strip()}'" for m in K.MARKERS) + " END"
_WORDS = r"string_split_regex(trim(s), '\s+')"


@query(
    "f7_statement",
    f"""WITH m AS (SELECT doc_id, pos, s, {_AT} AS ix, {_MARK} AS mark FROM {_S}),
        p AS (SELECT doc_id, pos, CASE WHEN mark IS NULL THEN {_phrase(f"array_to_string({_WORDS}[1:4], ' ')", 90)} ELSE {_phrase("left(s, ix::INT)", 90)} END AS subject,
        coalesce(mark, 'states') AS predicate, CASE WHEN mark IS NULL THEN {_phrase(f"array_to_string({_WORDS}[5:], ' ')", 220)} ELSE {_phrase("substring(s, (ix + length(mark) + 3)::INT)", 220)} END AS rest, s FROM m)
        SELECT doc_id, pos, subject, predicate, coalesce(nullif(rest, ''), {_phrase("s", 220)}) AS object FROM p WHERE subject <> ''""",
)
def f7(spark, sf):
    return K.statements(mined(spark, sf).select("doc_id", "pos", "s"), "s", F.lit("claim")).drop("s")


@query("f8_condition", f"SELECT doc_id, pos, {_phrase(f'''regexp_extract(s, '(?i){K.CONDITION}', 0)''', 120)} AS condition FROM {_S} WHERE regexp_matches(s, '(?i){K.CONDITION}')")
def f8(spark, sf):
    return mined(spark, sf).select("doc_id", "pos", K.condition(F.col("s")).alias("condition")).where("condition is not null")


@query(
    "f9_confidence",
    f"SELECT doc_id, pos, CASE WHEN {_any([*K.HEDGES, 'can'])} THEN 0.65 WHEN {_any(['approximately', 'around', 'about'])} THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM {_S}",
)
def f9(spark, sf):
    return mined(spark, sf).select("doc_id", "pos", K.confidence(F.col("s"), F.lit("en")).alias("confidence"))


_TOP = f"""(SELECT source, doc_id, pos, row_number() OVER (PARTITION BY source ORDER BY (p > 1)::INT, score DESC, doc_id, pos) AS n FROM
    (SELECT source, doc_id, pos, {_SCORE} AS score, row_number() OVER (PARTITION BY source, doc_id ORDER BY {_SCORE} DESC, pos) AS p FROM {_S}) QUALIFY n <= 20)"""


def selected(spark, sf):
    return K.diverse_top(mined(spark, sf).withColumn("score", K.salience(F.col("s"))), "source", "doc_id", "score", "pos")


@query("f10_diverse_top", f"SELECT source, doc_id, pos, n FROM {_TOP}")
def f10(spark, sf):
    return selected(spark, sf).select("source", "doc_id", "pos", "n")


@query("f11_fact_number", f"SELECT 'en-' || upper(source) || '-' || lpad(n::VARCHAR, 3, '0') AS fact_id, doc_id, pos FROM {_TOP}")
def f11(spark, sf):
    return selected(spark, sf).select(F.format_string("en-%s-%03d", F.upper("source"), "n").alias("fact_id"), "doc_id", "pos")


@query("f12_evidence", "SELECT conv_id, turn AS page, role AS book, left(text, 600) AS snippet FROM conversations WHERE text IS NOT NULL")
def f12(spark, sf):
    rows = table(spark, sf, "conversations").where("text is not null")
    one = F.struct(F.col("role").alias("book"), F.col("turn").alias("page"), F.left("text", F.lit(600)).alias("snippet"))
    return rows.groupBy("conv_id").agg(F.collect_list(one).alias("evidence")).select("conv_id", F.explode("evidence").alias("e")).select("conv_id", "e.page", "e.book", "e.snippet")


@query(
    "f13_prompts",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'Extract facts as JSON.' ELSE 'Extract facts as JSON. Keep the language ' || lang || '.' END AS system,
       'Book ' || source || chr(10) || chr(10) || text AS prompt FROM documents""",
)
def f13(spark, sf):
    system = F.when(F.col("lang") == "en", "Extract facts as JSON.").otherwise(F.concat(F.lit("Extract facts as JSON. Keep the language "), "lang", F.lit(".")))
    return docs(spark, sf).select("doc_id", system.alias("system"), F.concat(F.lit("Book "), "source", F.lit("\n\n"), "text").alias("prompt"))


@query(
    "f14_patch",
    """SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 5 = 0""",
)
def f14(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    patches = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "X").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    _, diff = K.patch(rows, patches, "o_orderkey", ["o_orderstatus", "o_orderpriority"], F.lit("2024-01-01"))
    return diff.select("o_orderkey", F.col("before.o_orderstatus").alias("before"), F.col("after.o_orderstatus").alias("after"))


@query(
    "f15_bulk_status",
    """SELECT doc_id AS o_orderkey, o_orderkey IS NOT NULL AS found, o_orderstatus AS before, CASE WHEN o_orderkey IS NOT NULL THEN 'A' END AS after
       FROM (SELECT DISTINCT doc_id FROM labels ORDER BY 1 LIMIT 200) LEFT JOIN orders ON o_orderkey = doc_id""",
)
def f15(spark, sf):
    return bulk_changed(spark, sf)[1]


def bulk_changed(spark, sf):
    # a call takes at most 200 ids
    asked = table(spark, sf, "labels").select(F.col("doc_id").alias("o_orderkey")).distinct().orderBy("o_orderkey").limit(200)
    return K.bulk_status(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), asked, "o_orderkey", "o_orderstatus", "A")


@query("f15_rows", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT DISTINCT doc_id FROM labels ORDER BY 1 LIMIT 200) THEN 'A' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def f15_rows(spark, sf):
    return bulk_changed(spark, sf)[0]


@query("f15_counts", "SELECT count(o_orderkey) AS succeeded, count(*) - count(o_orderkey) AS not_found FROM (SELECT DISTINCT doc_id FROM labels ORDER BY 1 LIMIT 200) LEFT JOIN orders ON o_orderkey = doc_id")
def f15_counts(spark, sf):
    return bulk_changed(spark, sf)[1].agg(F.count(F.when(F.col("found"), 1)).alias("succeeded"), F.count(F.when(~F.col("found"), 1)).alias("not_found"))


@query("f16_history", "SELECT user_id, event_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def f16(spark, sf):
    # a range sort: a user with most of the edits is many tasks, and no history is held in one row
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type").orderBy("user_id", F.desc("ts"), F.desc("event_id"))


@query("f17_review_queue", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def f17(spark, sf):
    wanted = {"o_orderstatus": F.col("o_orderstatus") == "O", "o_orderpriority": F.col("o_orderpriority").startswith("1")}
    rows = table(spark, sf, "orders")
    for test in wanted.values():
        rows = rows.where(test)
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderstatus")


@query(
    "f18_conflicts",
    f"""WITH c AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS objects, count(DISTINCT l_orderkey) AS books FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1 AND count(DISTINCT l_orderkey) > 1),
        h AS (SELECT *, sha1(unhex('{_NS}') || encode(l_partkey || '/' || l_linenumber)) AS d FROM c)
        SELECT l_partkey, l_linenumber, objects, books, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(d, 17, 1)) - 1)::INT % 4 + 1, 1)
        || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS group_id FROM h""",
)
def f18(spark, sf):
    found = K.conflicts(table(spark, sf, "lineitem"), ["l_partkey", "l_linenumber"], "l_suppkey", "l_orderkey")
    return found.withColumn("group_id", uuid5(_NS, F.concat_ws("/", "l_partkey", "l_linenumber")))


@query(
    "f18_units",
    """WITH c AS (SELECT l_partkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1 AND count(DISTINCT l_orderkey) > 1)
       SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN c.l_partkey IS NULL THEN 'extracted' ELSE 'conflicting' END AS status, c.l_partkey || '/' || c.l_linenumber AS conflict FROM lineitem LEFT JOIN c USING (l_partkey, l_linenumber)""",
)
def f18_units(spark, sf):
    """Every unit with its status; those in conflict name the group that they share."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.lit("extracted").alias("status"))
    marked = K.mark_conflicts(rows, ["l_partkey", "l_linenumber"], "l_suppkey", "l_orderkey", F.concat_ws("/", "l_partkey", "l_linenumber"))
    return marked.select("l_orderkey", "l_linenumber", "l_suppkey", "status", F.col("group_id").alias("conflict"))


@query("f19_review_precision", "SELECT source, count(*) AS n, round(avg(quality), 6) AS precision FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def f19(spark, sf):
    both = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("precision"))


@query(
    "f19_review_sample",
    """WITH u AS (SELECT DISTINCT l.doc_id, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id), a AS (SELECT doc_id, source, reviewer FROM u, (VALUES (1), (2), (3)) v(reviewer) WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = u.doc_id AND x.quality + 1 = reviewer))
       SELECT reviewer, source, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY reviewer, source ORDER BY sha256('1:' || reviewer || ':' || doc_id), doc_id) AS n FROM a) WHERE n <= 5""",
)
def f19_sample(spark, sf):
    """Five units of every source for each of three reviewers; reviewer quality + 1 has seen a labelled document."""
    labels = table(spark, sf, "labels")
    rows = labels.select("doc_id").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    seen = labels.select((F.col("quality") + 1).alias("reviewer"), "doc_id")
    return K.review_sample(rows, seen, [1, 2, 3], "source", "doc_id", "reviewer", 5)


@query("f20_key_backfill", r"SELECT p_partkey, CASE WHEN p_size > 25 THEN trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) ELSE p_brand END AS key FROM part")
def f20(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("key"))
    return rows.select("p_partkey", F.coalesce("key", F.lower(phrase(F.col("p_name"), 500))).alias("key"))
