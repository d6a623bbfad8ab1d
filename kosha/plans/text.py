"""Queries of cleaning, segmentation, language and identity (B, C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language as L
from ..functions import text as T
from ..operators import chunks as C
from ..operators import retrieval as R
from ..sources.tables import insert_if_absent
from .registry import query
from .tables import LINES, lines, table

_HEAD = r"^\w+\.$"
_HEAD_SQL = r"^[\p{L}\p{N}_]+\.$"
_SENTENCES = r"""(SELECT doc_id, source, pos, s FROM (SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS s FROM (
    SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(text, '([.?!;:])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^[ \-\t\r\n]+|[ \-\t\r\n]+$', '', 'g')), lambda x: x <> '') AS p FROM documents)))"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def sentence_rows(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return rows.withColumn("pos", F.col("pos") + 1)


@query("b1_page_split", f"SELECT doc_id, page, text FROM {LINES}")
def b1(spark, sf):
    return C.split_pages(docs(spark, sf), ["doc_id"], sep="\n")


@query(
    "b2_page_clean",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)!\[[^\]]*\]\(data:[^)]+\)', '', 'g'), '<[^>]+>', '', 'g'),
        '(?m)^#{1,6}\s+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM pages""",
)
def b2(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_page(F.col("html")).alias("text"))


@query(
    "b3_eval_clean",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '[A-Za-z0-9+/]{50,}={0,2}', '', 'g'), '!\[Image\]\([^)]{10,}\)', '', 'g'),
        '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM pages""",
)
def b3(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_for_evaluation(F.col("html")).alias("text"))


@query("b4_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def b4(spark, sf):
    return docs(spark, sf).select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(
    "b5_line_repair",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text FROM documents""",
)
def b5(spark, sf):
    return docs(spark, sf).select("doc_id", T.repair_lines(F.col("text")).alias("text"))


@query(
    "b6_title_carry",
    rf"""SELECT doc_id, page, last_value(CASE WHEN regexp_matches(text, '{_HEAD_SQL}') THEN text END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM {LINES}""",
)
def b6(spark, sf):
    return C.carry_titles(lines(spark, sf), "doc_id", heading=r"(?Um)^(\w+\.)$").select("doc_id", "page", "section_title")


_SECTIONS = rf"""(WITH m AS (SELECT doc_id, page, text, regexp_matches(text, '{_HEAD_SQL}') AS h FROM {LINES}),
        s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS section FROM m)
        SELECT doc_id, section, max(CASE WHEN h THEN text END) AS title, min(page) AS page_start, max(page) AS page_end, string_agg(text, chr(10) ORDER BY page) AS text
        FROM s GROUP BY doc_id, section)"""


@query("b7_sections", f"SELECT * FROM {_SECTIONS}")
def b7(spark, sf):
    head = F.col("text").rlike("(?U)" + _HEAD)
    return C.sections(lines(spark, sf), "doc_id", "page", head, F.col("text"))


def _cuts(rows: str, key: str, most: int, overlap: int) -> str:
    """(key, n, a, b, out) of rows (key, p: texts of pages): a recursion that takes one page or makes one cut in each step."""
    found = lambda mark: f"CASE WHEN instr(reverse(head), reverse({mark})) > 0 THEN {most} - instr(reverse(head), reverse({mark})) - length({mark}) + 1 ELSE -1 END"
    half = most // 2
    return rf"""(WITH RECURSIVE w AS (SELECT {key}, p, 0 AS i, '' AS buf, NULL::BIGINT AS start, 0 AS n, NULL::VARCHAR AS out, NULL::BIGINT AS a, NULL::BIGINT AS b, false AS done FROM {rows}
        UNION ALL SELECT {key}, p, CASE WHEN is_full OR NOT more THEN i ELSE i + 1 END,
        CASE WHEN is_full THEN regexp_replace(substring(buf, greatest(0, cut - {overlap}) + 1), '^[\s\p{{Z}}]+', '') WHEN NOT more THEN '' WHEN buf = '' THEN p[i + 1] ELSE buf || chr(10) || chr(10) || p[i + 1] END,
        CASE WHEN is_full THEN i WHEN more THEN coalesce(start, i + 1) ELSE start END, CASE WHEN is_full THEN n + 1 WHEN NOT more THEN n + 1 ELSE n END,
        CASE WHEN is_full THEN left(buf, cut) WHEN NOT more AND regexp_matches(buf, '[^\s\p{{Z}}]') THEN buf END, start, i, NOT is_full AND NOT more
        FROM (SELECT *, (CASE WHEN blank > {half} THEN blank WHEN danda > {half} THEN danda + 1 WHEN stop > {half} THEN stop + 1 ELSE {most} END)::INT AS cut FROM (
            SELECT *, {found("chr(10) || chr(10)")} AS blank, greatest({found("'।'")}, {found("'॥'")}) AS danda, {found("'. '")} AS stop
            FROM (SELECT *, length(buf) >= {most} AS is_full, i < len(p) AS more, left(buf, {most}) AS head FROM w WHERE NOT done))))
        SELECT {key}, n - 1 AS n, a, b, out FROM w WHERE out IS NOT NULL)"""


@query(
    "b8_window_chunks",
    f"SELECT doc_id, n::INT AS chunk, a::INT AS page_start, b::INT AS page_end, out AS text FROM {_cuts('(SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)', 'doc_id', C.MAX_CHARS, C.OVERLAP)}",
)
def b8(spark, sf):
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    return C.window_chunks(docs(spark, sf).select("doc_id", pages.alias("pages")), ["doc_id"])


@query(
    "b9_first_cut",
    """WITH h AS (SELECT doc_id, left(text, 1000) AS c FROM documents WHERE length(text) >= 1000),
       p AS (SELECT doc_id, CASE WHEN instr(reverse(c), chr(10) || chr(10)) > 0 THEN 1000 - instr(reverse(c), chr(10) || chr(10)) - 1 ELSE -1 END AS blank,
       CASE WHEN instr(reverse(c), ' .') > 0 THEN 1000 - instr(reverse(c), ' .') - 1 ELSE -1 END AS stop FROM h)
       SELECT doc_id, CASE WHEN blank > 500 THEN blank WHEN stop > 500 THEN stop + 1 ELSE 1000 END AS cut FROM p""",
)
def b9(spark, sf):
    return docs(spark, sf).where("length(text) >= 1000").select("doc_id", C.first_cut(F.col("text"), 1000).alias("cut"))


@query(
    "b10_large_sections",
    f"""SELECT doc_id, section, 0 AS chunk, page_start, page_end, text FROM {_SECTIONS} WHERE length(text) <= 1500 UNION ALL
        SELECT doc_id, section, n::INT, page_start, page_end, out FROM {_cuts(f"(SELECT doc_id, section, page_start, page_end, [text] AS p FROM {_SECTIONS} WHERE length(text) > 1500)", "doc_id, section, page_start, page_end", 1500, 0)}""",
)
def b10(spark, sf):
    head = F.col("text").rlike("(?U)" + _HEAD)
    found = C.sections(lines(spark, sf), "doc_id", "page", head, F.col("text"))
    return C.split_large(found, ["doc_id", "section"], 1500)


@query("b11_chunk_emit", f"SELECT doc_id, page, trim(text) AS text, sha256(trim(text)) AS text_hash FROM {LINES} WHERE length(trim(text)) >= 50")
def b11(spark, sf):
    return C.emit(lines(spark, sf).select("doc_id", "page", "text"))


@query("b12_sentences", f"SELECT doc_id, pos, s FROM {_SENTENCES}")
def b12(spark, sf):
    return sentence_rows(spark, sf).select("doc_id", "pos", "s")


_SKIPS = " AND ".join(f"NOT contains(lower(s), '{p}')" for p in T.SKIP_PHRASES)
_GATE = rf"""length(s) BETWEEN 60 AND 330 AND len(string_split_regex(trim(s), '\s+')) BETWEEN 8 AND 65 AND {_SKIPS}
    AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= length(s) * 0.45"""


@query("b13_sentence_gate", f"SELECT doc_id, pos FROM {_SENTENCES} WHERE {_GATE}")
def b13(spark, sf):
    return sentence_rows(spark, sf).where(T.is_sentence(F.col("s"))).select("doc_id", "pos")


@query(
    "b14_thirds",
    r"""SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE left(text, 300) || chr(10) || chr(10) || substring(text, (length(text) // 2 - 150)::INT + 1, 300)
        || chr(10) || chr(10) || right(text, 300) END AS text FROM documents""",
)
def b14(spark, sf):
    return docs(spark, sf).select("doc_id", T.sample_thirds(F.col("text"), 900).alias("text"))


@query(
    "b15_snippet",
    """SELECT doc_id, CASE WHEN length(text) > 600 THEN rtrim(left(text, 599)) || '…' ELSE text END AS snippet,
       CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS preview FROM documents""",
)
def b15(spark, sf):
    return docs(spark, sf).select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.preview(F.col("text")).alias("preview"))


@query(
    "b16_page_estimate",
    """SELECT item_id, doc_id, greatest(1, CAST(round_even((strpos(d.text, left(b.text, 40)) - 1)::DOUBLE / length(d.text) * 20, 0) AS BIGINT)) AS page
       FROM documents d JOIN benchmark b ON contains(d.text, left(b.text, 40))""",
)
def b16(spark, sf):
    marks = table(spark, sf, "benchmark").select("item_id", F.left("text", F.lit(40)).alias("head"))
    found = R.containing(docs(spark, sf), "doc_id", "text", marks, "item_id", "head")
    at = F.expr("locate(head, text) - 1") / F.length("text") * 20
    return found.select("item_id", "doc_id", F.greatest(F.lit(1), F.bround(at, 0)).cast("long").alias("page"))


@query(
    "b17_scanned",
    f"""SELECT doc_id, round(avg((length(text) < 100)::INT), 6) AS sparse_share, avg((length(text) < 100)::INT) > 0.3 AS scanned FROM {LINES} GROUP BY doc_id""",
)
def b17(spark, sf):
    share = F.avg((F.length("text") < 100).cast("int"))
    return lines(spark, sf).groupBy("doc_id").agg(F.round(share, 6).alias("sparse_share"), (share > 0.3).alias("scanned"))


@query(
    "c1_script_ratio",
    r"""SELECT doc_id, round(CASE WHEN n > 0 THEN a::DOUBLE / n ELSE 0 END, 6) AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n,
        length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS a FROM documents)""",
)
def c1(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(L.script_ratio(F.col("text"), L.LATIN), 6).alias("ratio"))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_HITS = ", ".join(rf"len(list_intersect(list_distinct(string_split_regex(lower(text), '\s+')), {_list(w)})) AS {k}" for k, w in L.STOPWORDS.items())


@query(
    "c2_majority_language",
    f"""SELECT doc_id, CASE WHEN t = 0 THEN 'unknown' WHEN en = b THEN 'en' WHEN fr = b THEN 'fr' WHEN de = b THEN 'de' ELSE 'es' END AS language,
        CASE WHEN t = 0 THEN 0.5 ELSE round(0.5 + 0.5 * b / t, 2) END AS confidence FROM (SELECT *, en + fr + de + es AS t, greatest(en, fr, de, es) AS b FROM (SELECT doc_id, {_HITS} FROM documents))""",
)
def c2(spark, sf):
    found = docs(spark, sf).select("doc_id", L.majority_language(F.col("text")).alias("l"))
    return found.select("doc_id", "l.language", "l.confidence")


_WORDS = r"(SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w FROM documents)"
_STOPS = "(VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in L.STOPWORDS.items() for w in ws) + ") v(lang, w)"


@query(
    "c3_threshold_language",
    f"""WITH h AS (SELECT doc_id, lang, count(*) AS n FROM {_WORDS} JOIN {_STOPS} USING (w) GROUP BY 1, 2),
        r AS (SELECT doc_id, lang, n, sum(n) OVER (PARTITION BY doc_id) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS k FROM h)
        SELECT doc_id, CASE WHEN n / t >= 0.8 THEN lang ELSE 'mixed' END AS language, round(n / t, 6)::DOUBLE AS confidence FROM r WHERE k = 1""",
)
def c3(spark, sf):
    words = docs(spark, sf).select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    stops = spark.createDataFrame([(k, w) for k, ws in L.STOPWORDS.items() for w in ws], "lang string, w string")
    hits = words.join(F.broadcast(stops), "w").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    best = hits.groupBy("doc_id").agg(F.max(F.struct("n", (-F.ascii("lang") * 1000 - F.ascii(F.substring("lang", 2, 1))).alias("k"), "lang")).alias("b"), F.sum("n").alias("t"))
    share = F.col("b.n") / F.col("t")
    return best.select("doc_id", F.when(share >= 0.8, F.col("b.lang")).otherwise("mixed").alias("language"), F.round(share, 6).alias("confidence"))


# the table's own texts written in Devanagari letters, wholly or in part, each with a few words that tell languages and kinds
_LETTERS = "abcdefghijklmnopqrstuvwxyz", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"[:26]
_TAILS = ["", "यह किताब है और यह खेती में", "हे पुस्तक आहे आणि ते", "धान्यस्य मूलम् ।", "च वा तु", "research shows 5", "is defined as", "the method", "विधि", "म्हणजे"]
_SCRIPTED = f"""(SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'es' THEN text || ' ' || t WHEN 'fr' THEN text || ' ' || left(t, length(t) // 8) ELSE t END || ' ' || {_list(_TAILS)}[doc_id % {len(_TAILS)} + 1] AS text
    FROM (SELECT *, translate(lower(text), '{_LETTERS[0]}', '{_LETTERS[1]}') AS t FROM documents))"""


def scripted(spark, sf):
    rows = docs(spark, sf).select("doc_id", "lang", "text", F.translate(F.lower("text"), *_LETTERS).alias("t"))
    part = F.concat("text", F.lit(" "), F.left("t", F.floor(F.length("t") / 8).cast("int")))
    body = F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "es", F.concat("text", F.lit(" "), "t")).when(F.col("lang") == "fr", part).otherwise(F.col("t"))
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % len(_TAILS) + 1).cast("int"))
    return rows.select("doc_id", F.concat(body, F.lit(" "), tail).alias("text"))


def _ratio(text):
    return rf"(length(regexp_replace(regexp_replace({text}, '[^\p{{L}}]', '', 'g'), '[^ऀ-ॿ]', '', 'g')) / nullif(length(regexp_replace({text}, '[^\p{{L}}]', '', 'g')), 0))"


_SEEN = ", ".join(rf"len(list_intersect(list_distinct(string_split_regex(text, '\s+')), {_list(w)})) AS {k}" for k, w in (("mr", L.STOPWORDS_MR), ("hi", L.STOPWORDS_HI), ("sa", L.MARKERS_SA)))


@query(
    "c2_chunk_language",
    f"""WITH h AS (SELECT doc_id, text, coalesce({_ratio("text")}, 0) AS r, {_SEEN} FROM {_SCRIPTED})
        SELECT doc_id, CASE WHEN r > 0.6 AND mr + hi = 0 AND (regexp_matches(text, '[।॥]') OR sa >= 2) THEN 'sa' WHEN r > 0.6 AND mr >= hi THEN 'mr' WHEN r > 0.6 THEN 'hi' WHEN r > 0.15 THEN 'mixed' WHEN r < 0.05 THEN 'en' ELSE 'unknown' END AS language,
        CASE WHEN r > 0.6 AND mr + hi = 0 THEN CASE WHEN regexp_matches(text, '[।॥]') THEN 0.82 WHEN sa >= 2 THEN 0.75 ELSE 0.7 END WHEN r > 0.6 THEN round_even(0.5 + 0.5 * greatest(mr, hi) / (mr + hi), 2)
        WHEN r > 0.15 THEN round_even(r, 2) WHEN r < 0.05 THEN round_even(1 - r * 4, 2) ELSE 0.5 END::DOUBLE AS confidence FROM h""",
)
def c2_chunks(spark, sf):
    return scripted(spark, sf).select("doc_id", L.chunk_language(F.col("text")).alias("l")).select("doc_id", "l.language", "l.confidence")


_AS_DETECTED = "CASE lang WHEN 'fr' THEN 'hi' WHEN 'de' THEN 'or' WHEN 'es' THEN 'xx' ELSE lang END"


@query("c4_language_code", f"SELECT doc_id, CASE {_AS_DETECTED} WHEN 'hi' THEN 'hi-IN' WHEN 'or' THEN 'od-IN' ELSE 'en-IN' END AS code FROM documents")
def c4(spark, sf):
    return docs(spark, sf).select("doc_id", L.mapped(F.expr(_AS_DETECTED), L.LANGUAGE_CODES, "en-IN").alias("code"))


_KIND_CASES = " ".join(f"WHEN coalesce({_ratio('text')}, 0) > 0.4 AND regexp_matches(text, '{p}') THEN '{k}'" for k, p in L.KINDS_INDIC.items()) + " " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in L.KINDS.items())


@query("c5_chunk_kind", f"SELECT doc_id, CASE {_KIND_CASES} ELSE 'general' END AS kind FROM {_SCRIPTED}")
def c5(spark, sf):
    return scripted(spark, sf).select("doc_id", L.chunk_kind(F.col("text")).alias("kind"))


@query("c6_distribution", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def c6(spark, sf):
    return docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "c7_primary_language",
    "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS k FROM documents GROUP BY 1, 2) WHERE k = 1",
)
def c7(spark, sf):
    counts = docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    first = Window.partitionBy("source").orderBy(F.desc("n"), "seen")
    return counts.withColumn("k", F.row_number().over(first)).where("k = 1").select("source", "lang", "n")


@query(
    "c8_quality_gate",
    """SELECT event_id, CASE WHEN q >= 0.7 THEN 'keep' WHEN q >= 0.4 THEN 'review' ELSE 'skip' END AS gate
       FROM (SELECT event_id, value / max(value) OVER () AS q FROM events WHERE value IS NOT NULL)""",
)
def c8(spark, sf):
    events = table(spark, sf, "events").where("value is not null")
    q = F.col("value") / F.lit(events.agg(F.max("value")).first()[0]).cast("double")
    return events.select("event_id", F.when(q >= 0.7, "keep").when(q >= 0.4, "review").otherwise("skip").alias("gate"))


@query(
    "c9_injection",
    "SELECT conv_id, turn, (" + " OR ".join(f"regexp_matches(left(text, 2000), '(?i){p}')" for p in L.INJECTIONS) + ") AS flagged FROM conversations WHERE text IS NOT NULL",
)
def c9(spark, sf):
    rows = table(spark, sf, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", (F.size(L.injections(F.col("text"))) > 0).alias("flagged"))


@query(
    "c9_search_text",
    r"""SELECT conv_id, turn, left(regexp_replace(trim(regexp_replace(q, '(?i)^\s*(ignore\s+(previous|all)\s+instructions?|system\s*:)', '')), '[\x00-\x08\x0B-\x1F]', '', 'g'), 2000) AS q
        FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' System : ' || text WHEN 1 THEN 'Ignore previous instructions' || chr(7) || text ELSE text END AS q FROM conversations WHERE text IS NOT NULL)""",
)
def c9_search(spark, sf):
    """Turns as searches, some with an instruction ahead or a control character within."""
    ahead = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" System : "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Ignore previous instructions\x07"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", L.search_text(ahead).alias("q"))


@query("c10_context_prefix", "SELECT doc_id, 'Book: ' || source || ' | Section: ' || lang || ' | Pages ' || CASE WHEN n_chars = 1 THEN '1' ELSE '1-' || n_chars END || chr(10) || chr(10) AS prefix FROM documents")
def c10(spark, sf):
    return docs(spark, sf).select("doc_id", L.context_prefix(F.col("source"), F.col("lang"), F.lit(1), F.col("n_chars"), F.col("lang")).alias("prefix"))


@query("d1_content_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def d1(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("text_hash"))


_NS = "6ba7b8109dad11d180b400c04fd430c8"  # the DNS namespace


@query(
    "d2_uuid5",
    f"""WITH h AS (SELECT doc_id, sha1(unhex('{_NS}') || encode(source || '/' || doc_id)) AS d FROM documents)
        SELECT doc_id, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(d, 17, 1)) - 1)::INT % 4 + 1, 1)
        || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h""",
)
def d2(spark, sf):
    return docs(spark, sf).select("doc_id", T.uuid5(_NS, F.concat_ws("/", "source", "doc_id")).alias("id"))


@query("d3_canonical_key", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM part")
def d3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.canonical_key(F.col("p_name")).alias("key"))


@query(
    "d4_slug",
    f"SELECT doc_id, regexp_replace(trim(regexp_replace(translate(lower(text), '{T._FOLD_FROM}', '{T._FOLD_TO}'), '[^a-z0-9\\s]', '', 'g')), '\\s+', '_', 'g') AS key FROM documents",
)
def d4(spark, sf):
    return docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("key"))


@query("d5_exact_dedup", "SELECT source, sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def d5(spark, sf):
    return docs(spark, sf).groupBy("source", F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "d6_prefix_dedup",
    r"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, left(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g'), 200)
        ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1""",
)
def d6(spark, sf):
    keyed = docs(spark, sf).select("source", "doc_id", "n_chars", F.left(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", ""), F.lit(200)).alias("key"))
    best = Window.partitionBy("source", "key").orderBy(F.desc("n_chars"), "doc_id")
    return keyed.withColumn("k", F.row_number().over(best)).where("k = 1").select("source", "doc_id")


@query("d7_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def d7(spark, sf):
    done = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return insert_if_absent(done, docs(spark, sf).select("doc_id"), ["doc_id"], F.col("doc_id"))


# outputs of a stage: a label is one; some come twice, some belong to no input
_MADE = "(SELECT doc_id FROM labels WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 13 = 0)"
_PAIRING = f"""(SELECT coalesce(i.doc_id, o.doc_id) AS doc_id, source, coalesce(i.n, 0) AS inputs, coalesce(o.n, 0) AS outputs FROM (SELECT doc_id, source, count(*) AS n FROM documents GROUP BY 1, 2) i
    FULL JOIN (SELECT doc_id, count(*) AS n FROM {_MADE} GROUP BY 1) o ON i.doc_id = o.doc_id)"""


def _paired(spark, sf):
    k = F.col("doc_id")
    labels = table(spark, sf, "labels").select("doc_id")
    made = labels.where(k % 11 != 0).unionByName(labels.where(k % 7 == 0)).unionByName(labels.where(k % 13 == 0).select((-k - 1).alias("doc_id")))
    return C.pairing(docs(spark, sf), made, "doc_id", "source")


@query(
    "d8_count_guard",
    f"""SELECT source, sum(inputs)::BIGINT AS inputs, sum(outputs)::BIGINT AS outputs, sum((inputs > outputs)::INT)::BIGINT AS missing, sum((inputs > 0 AND outputs > inputs)::INT)::BIGINT AS doubled,
        sum((inputs = 0)::INT)::BIGINT AS foreign, bool_or(inputs <> outputs) AS failed FROM {_PAIRING} GROUP BY 1""",
)
def d8(spark, sf):
    return C.count_guard(_paired(spark, sf), "source")


@query(
    "d8_errors",
    f"SELECT doc_id, source, inputs, outputs, CASE WHEN inputs = 0 THEN 'foreign' WHEN outputs > inputs THEN 'doubled' ELSE 'missing' END AS error FROM {_PAIRING} WHERE inputs <> outputs",
)
def d8_errors(spark, sf):
    return _paired(spark, sf).where("error is not null")
