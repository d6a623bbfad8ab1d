"""Secret scans with multipart credential linking, on DataFrame functions only.

Base findings (assignments, access identifiers, long hex runs) are leftmost non-overlapping matches whose minimum
length is tested afterwards. Weak candidates (40-character base64 secrets, endpoints) are reported only where
complementary parts lie within SCOPE code points of them: a bare secret near an access identifier, an endpoint near
an access identifier or an assignment.

Positions come from splitting the text at the matches and adding up lengths, so nothing leaves the JVM. Texts are read
a fixed number of times, however many findings they hold; masks are put in place block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, numbered

# The patterns of the findings. The first three are the base kinds, in the order of their ranks.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs are maximal, so this keeps what AKIA[A-Z0-9]+ of 16 or more keeps
HEX = r"[0-9a-f]{32,}"  # likewise for [0-9a-f]+
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ["assign", "access", "hex", "bare", "endpoint"]

#: Two parts belong together when they start at most so many code points apart.
SCOPE = 400

_SPANS = "array<struct<s:long,e:long>>"
#: Numbers that are added up at a time; a running sum over n of them copies about n * SUMMED of them.
SUMMED = 128
#: Code points of a block in which masks are put in place.
BLOCK = 4096


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(numbers: Column) -> Column:
    """Running sums of an array of longs: within blocks of SUMMED, then over the blocks."""
    zero = F.array(F.lit(0).cast("long"))
    added = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    starts = lambda xs: F.filter(F.sequence(F.lit(0), F.size(xs)), lambda i: (i % SUMMED == 0) & (i < F.size(xs)))
    inner = _bound(numbers, lambda xs: F.transform(starts(xs), lambda i: added(F.slice(xs, i + 1, SUMMED))))
    before = lambda blocks: added(F.transform(blocks, lambda b: F.element_at(b, -1)))
    both = _bound(inner, lambda blocks: F.struct(blocks.alias("blocks"), before(blocks).alias("before")))
    shifted = lambda x: F.transform(x["blocks"], lambda b, i: F.transform(F.slice(b, 2, SUMMED), lambda n: n + F.element_at(x["before"], i + 1)))
    return F.flatten(_bound(both, shifted))


def _spans(text: Column, pattern: str, seen: Column, keep=None) -> Column:
    """Spans of all matches in code points; keep tests the matched string. Empty where seen is false."""
    # pieces and matches take turns, with one piece more at the end
    long = lambda c: F.length(c).cast("long")
    turns = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, m: F.when(m.isNotNull(), F.struct((long(p) + long(m)).alias("step"), long(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("keep"))),
    )

    def placed(turns: Column) -> Column:
        ends = _running(F.transform(turns, lambda x: x["step"]))
        spans = F.zip_with(turns, ends, lambda x, e: F.when(x["keep"], F.struct((e - x["n"]).alias("s"), e.alias("e"))))
        return F.filter(spans, lambda x: x.isNotNull())

    found = _bound(F.filter(turns, lambda x: x.isNotNull()), placed)
    return F.when(seen, found).otherwise(F.array().cast(_SPANS))


def _findings(t: Column) -> list[Column]:
    """Spans of each kind in a text that is not null."""
    return [
        _spans(t, ASSIGN, t.rlike(ASSIGN), _long_value).alias("assign"),
        _spans(t, ACCESS, F.contains(t, F.lit("AKIA"))).alias("access"),
        _spans(t, HEX, t.rlike(HEX)).alias("hex"),
        _spans(t, BARE, t.rlike(BARE)).alias("bare"),
        _spans(t, ENDPOINT, F.contains(t, F.lit("://"))).alias("endpoint"),
    ]


def _in_order(spans: Column) -> Column:
    """Spans by start, then kind."""
    first = lambda a, b: F.when(a["s"] != b["s"], F.signum(a["s"] - b["s"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int")
    return F.array_sort(spans, first)


def _ranked(kind: Column, rank: int) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(rank).alias("kind")))


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, "^" + ASSIGN, 1)) >= 8


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Scratch]:
    """One row (rid, doc_id, spans) per row of docs; spans: array of (s, e, kind), by start, then kind.

    Kinds are ranks in KINDS. Null and empty texts have no findings; an empty table gives an empty one; repeated rows are scanned one by one; rid tells
    rows of one key apart. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), body.alias("t"))
    found = base.select("rid", "doc_id", *_findings(F.col("t")))
    every = F.flatten(F.array(*[_ranked(F.col(kind), rank) for rank, kind in enumerate(KINDS)]))
    parts = scratch.keep(found.select("rid", "doc_id", every.alias("parts")))

    # only texts that hold a weak candidate and a complement of it need the join
    mixed = parts.where(F.exists("parts", lambda p: p["kind"] >= 3) & F.exists("parts", lambda p: p["kind"] <= 1))
    one = mixed.select("rid", F.explode("parts").alias("p")).select("rid", "p.*").withColumn("scope", F.floor(F.col("s") / SCOPE))
    weak = one.where("kind >= 3")
    # the outermost complements of a scope answer every question about it: one row each, however many it holds
    near = (
        one.where("kind <= 1")
        .withColumn("access", F.col("kind") == 1)
        .groupBy("rid", "scope")
        .agg(
            F.min(F.when(F.col("access"), F.col("s"))).alias("a_lo"),
            F.max(F.when(F.col("access"), F.col("s"))).alias("a_hi"),
            F.min("s").alias("lo"),
            F.max("s").alias("hi"),
        )
        .select("rid", "a_lo", "a_hi", "lo", "hi", F.explode(F.array(F.col("scope") - 1, F.col("scope"), F.col("scope") + 1)).alias("scope"))
        .groupBy("rid", "scope")
        .agg(*[F.sort_array(F.collect_list(F.struct(c1, c2))).alias(n) for n, c1, c2 in (("acc", "a_lo", "a_hi"), ("any", "lo", "hi"))])
    )

    def close(pairs: str, lo: str, hi: str) -> Column:
        s = F.col("s")
        inside = lambda x: F.coalesce(F.abs(x[lo] - s) <= SCOPE, F.lit(False)) | F.coalesce(F.abs(x[hi] - s) <= SCOPE, F.lit(False))
        around = lambda x: F.coalesce((x[lo] <= s) & (x[hi] >= s), F.lit(False))
        return F.exists(pairs, lambda x: inside(x) | around(x))

    linked = (
        weak.join(near, ["rid", "scope"])
        .where(F.when(F.col("kind") == 3, close("acc", "a_lo", "a_hi")).otherwise(close("any", "lo", "hi")))
        .groupBy("rid")
        .agg(F.collect_list(F.struct("s", "e", "kind")).alias("linked"))
    )
    strong = F.filter("parts", lambda p: p["kind"] < 3)
    spans = _in_order(F.concat(strong, F.coalesce("linked", F.array().cast("array<struct<s:long,e:long,kind:int>>"))))
    return parts.join(linked, "rid", "left").select("rid", "doc_id", spans.alias("spans")), scratch


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["s"].cast("string"), p["e"].cast("string"))),
        ",",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every whole text, with counts and a digest of the base kinds."""
    spans, _ = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda p: p["kind"] == k)).cast("long")
    base = F.filter("spans", lambda p: p["kind"] < 3)
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every finding in its text replaced by mask; all columns and rows stay, n_chars follows the text.

    Overlapping findings are masked together. Texts without findings are returned as they are, null stays null, and so
    do null keys and repeated rows; an empty table stays empty. Texts that may hold a finding are cut into blocks, so a
    very long one with very many findings is many rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    doubt = t.rlike(ASSIGN) | F.contains(t, F.lit("AKIA")) | t.rlike(HEX)  # weak candidates count beside one of these
    rid, scratch = "__kosha_rid", Scratch(docs.sparkSession, "redact")
    out = numbered(docs, rid, scratch).withColumn("__kosha_doubt", doubt)
    rows = out.where("__kosha_doubt").select(F.col(rid).alias("rid"), F.col(text).alias("text"))
    spans, _ = find_spans(rows, key="rid", text="text")
    one = spans.select(F.col("doc_id").alias("rid"), F.explode("spans").alias("p")).select("rid", "p.s", "p.e")
    # spans that overlap are one: a new one starts where all before it have ended
    before = Window.partitionBy("rid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("s") >= F.max("e").over(before), F.lit(True)).cast("int")
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(upto)).groupBy("rid", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    of = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    one = one.select("rid", "s", "e", F.explode(F.sequence(of("s"), F.floor((F.col("e") - 1) / BLOCK).cast("int"))).alias("block"))
    local = F.struct(F.greatest(F.col("s") - F.col("block") * BLOCK, F.lit(-1)).cast("int").alias("s"), F.least(F.col("e") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int").alias("e"))
    cuts = one.groupBy("rid", "block").agg(F.sort_array(F.collect_list(local)).alias("cuts"))
    found = scratch.keep(cuts.select("rid").distinct())
    held = rows.join(found, "rid").select("rid", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "body"))
    kept = lambda at, n: F.substring("body", at + 1, F.greatest(n, F.lit(0)))
    # a span that began in an earlier block has left its mask there
    parts = F.transform(
        "cuts",
        lambda p, i: F.concat(
            kept(F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["e"]), p["s"] - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["e"])), F.when(p["s"] >= 0, F.lit(mask)).otherwise("")
        ),
    )
    rest = kept(F.element_at("cuts", -1)["e"], F.length("body"))
    masked = F.when(F.col("cuts").isNull(), F.col("body")).otherwise(F.concat(F.array_join(parts, ""), rest))
    made = held.join(cuts, ["rid", "block"], "left").select("rid", F.struct("block", masked.alias("body")).alias("b"))
    made = made.groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["body"]), "").alias("__kosha_new"))
    made = made.withColumnRenamed("rid", rid)
    plain = out.where("not __kosha_doubt").withColumn("__kosha_new", F.lit(None).cast("string"))
    mixed = out.where("__kosha_doubt").join(made, rid, "left")
    changed = {text: F.coalesce("__kosha_new", text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__kosha_new").isNotNull(), F.length("__kosha_new").cast("long")).otherwise(F.col("n_chars"))
    return plain.unionByName(mixed.select(plain.columns)).select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def _sql() -> str:
    """DuckDB SQL for op10's rows: base kinds by the patterns of the contract, bare runs without lookaround."""
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{name})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    kinds = [
        ("assign", assign, f"length(regexp_extract(m, '^{assign}', 1)) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
        ("hex", "[0-9a-f]+", "length(m) >= 32"),
        ("bare", "[A-Za-z0-9+/=]+", "length(m) = 40 AND NOT contains(m, '=')"),
        ("endpoint", ENDPOINT, "true"),
    ]
    # pieces before matches and matches, in turns, give the places
    one = lambda rank, pattern, keep: (
        f"""SELECT rid, {rank} AS kind, s, s + length(m) AS e FROM (SELECT rid, m, (sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY j) - length(m))::BIGINT AS s
        FROM (SELECT rid, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, unnest(range(len(ms))) AS j FROM (SELECT rid, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM d))) WHERE {keep}"""
    )
    every = " UNION ALL ".join(one(rank, pattern, keep) for rank, (_, pattern, keep) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    told = lambda where: f"coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({where}), '')"
    count = ", ".join(f"count(*) FILTER (kind = {rank}) AS n_{kind}" for rank, kind in enumerate(KINDS[:3]))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({every}),
        g AS (SELECT *, {names}[kind + 1] AS k FROM f WHERE kind < 3 OR EXISTS (SELECT 1 FROM f c WHERE c.rid = f.rid AND abs(c.s - f.s) <= {SCOPE} AND (c.kind = 1 OR c.kind = 0 AND f.kind = 4)))
        SELECT any_value(doc_id) AS doc_id, {count}, sha256({told("kind < 3")}) AS base_sha256, {told("k IS NOT NULL")} AS spans FROM d LEFT JOIN g USING (rid) GROUP BY rid"""


SQL = _sql()
