"""MinHash near-duplicate linking with tensored bands.

A band of TABLES * HALF * 2 hash functions a table would need hundreds of MinHash values for a recall near one. Here a
text has two collections of TABLES half keys, each made of HALF MinHash values, and the key of table (i, j) combines
half i of the first with half j of the second: 2 * TABLES * HALF values stand for TABLES ** 2 tables of 2 * HALF values.
Two sets of Jaccard similarity s meet in no table with a probability of about 2 (1 - s ** HALF) ** TABLES, 3e-6 for the
values below at 0.8 and less above it.

Texts with equal sets of shingles are one entry. A half that no other entry shares can be in no shared key, so only
shared halves are combined. A first half that more than MOST_HELD entries share is a bucket by itself, which holds all
that its TABLES tables could bring together. Buckets with the same members count once. A bucket of up to MOST_MATED members gives all
its pairs; in a larger one every member meets two of it, and if that does not make the bucket one group, its members
are joined by a prefix filter over their whole sets, which misses none. Every candidate is confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, numbered
from .simhash import alike, rare_mates, sets_of, shingle_hashes

TABLES = 13
HALF = 2
MOST_MATED = 24
MOST_HELD = 256
#: Sets that hold over one in HOT rows are looked up by broadcast; there are fewer than HOT of them.
HOT = 1000
#: Shingles hashed by all functions at once.
BLOCK = 512
MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def halves(hashes: np.ndarray, tables: int = TABLES, half: int = HALF) -> np.ndarray:
    """Both collections of half keys of a set of shingle hashes, the second behind the first; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    seeds = np.array([MIX[0] * (i + 1) & (2**64 - 1) for i in range(2 * tables * half)], np.uint64)[:, None]
    values = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        x = hashes[at : at + BLOCK] ^ seeds
        x *= np.uint64(MIX[1])
        x ^= x >> np.uint64(32)
        x *= np.uint64(MIX[1])
        x ^= x >> np.uint64(29)
        np.minimum(values, x.min(axis=1), out=values)
    keys = [xxhash.xxh32_intdigest(v.tobytes()) for v in values.astype("<u8").reshape(-1, half)]
    return np.array(keys, np.uint32).view(np.int32)


def sketches(rows: DataFrame, words: int, tables: int = TABLES, half: int = HALF) -> DataFrame:
    """(rid, doc_id, set_id, n, halves) of rows (rid, doc_id, text); equal sets of shingles have equal set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, keys = [], [], []
            for cell in batch.column(2):
                h = shingle_hashes(cell.as_py(), words)
                sets.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                sizes.append(len(h))
                keys.append(halves(h, tables, half))
            arrays = [batch.column(0), batch.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "set_id", "n", "halves"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid string, doc_id {kind}, set_id long, n long, halves array<int>")


def tensored(sets: DataFrame, scratch: Scratch, tables: int = TABLES, most_held: int = MOST_HELD) -> tuple[DataFrame, DataFrame]:
    """Buckets (set_id, bucket) of sets (set_id, halves): those of the tables, and those of the frequent first halves.

    Halves that no other set holds are in no table. A first half of over most_held sets is a bucket by itself and in no
    table: its members are all that its tables could bring together.
    """
    each = sets.select("set_id", F.posexplode("halves").alias("at", "value"))
    shared = each.groupBy("at", "value").agg(F.count("*").alias("held")).where("held > 1")
    found = F.collect_list(F.struct("at", "value", (F.col("held") > most_held).alias("frequent")))  # 2 * tables at most
    of = scratch.keep(each.join(shared, ["at", "value"]).groupBy("set_id").agg(found.alias("found")))
    first = lambda frequent: F.filter("found", lambda x: (x["at"] < tables) & (x["frequent"] == frequent))
    second = F.filter("found", lambda x: x["at"] >= tables)
    one = of.select("set_id", F.explode(first(False)).alias("one"), second.alias("second"))
    keyed = one.select("set_id", "one", F.explode("second").alias("two")).select("set_id", F.xxhash64("one.at", "one.value", "two.at", "two.value").alias("bucket"))
    return keyed, of.select("set_id", F.explode(first(True)).alias("one")).select("set_id", F.xxhash64("one.at", "one.value").alias("bucket"))


def distinct_buckets(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, set_id, held, low, high) of the buckets with two members or more; one bucket for each set of members."""
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    told = keyed.groupBy("bucket").agg(F.count("*").alias("held"), F.min("set_id").alias("low"), F.max("set_id").alias("high"), *marks).where("held > 1")
    once = told.groupBy("held", "low", "high", "mark0", "mark1").agg(F.min("bucket").alias("bucket"))
    return scratch.keep(keyed.join(once.select("bucket", "held", "low", "high"), "bucket"))


def near_sets(
    sets: DataFrame, rows: DataFrame, words: int, similarity: float, scratch: Scratch, tables: int = TABLES, most_mated: int = MOST_MATED, most_held: int = MOST_HELD
) -> DataFrame:
    """(node, root): the sets (set_id, n, halves, best) that are linked to others, and the smallest of their component."""
    keyed, frequent = tensored(sets, scratch, tables, most_held)
    held = distinct_buckets(scratch.keep(keyed), scratch)
    few, many = held.where(F.col("held") <= most_mated), held.where(F.col("held") > most_mated)
    ends = frequent.groupBy("bucket").agg(F.count("*").alias("held"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    many = many.unionByName(scratch.keep(frequent.join(ends, "bucket")))
    mates = few.select("bucket", F.col("set_id").alias("a")).join(few.select("bucket", F.col("set_id").alias("b")), "bucket").where("a < b").select("a", "b")
    tied = many.select(F.col("set_id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    sizes = sets.select("set_id", "n")
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes alone do not rule the similarity out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        return both.where(near).select("a", "b")

    edges = alike(sized(mates.unionByName(tied)), sets, rows, words, similarity, scratch)
    roots = components(edges, scratch)
    members = many.join(roots, F.col("set_id") == F.col("node"), "left").select("bucket", "set_id", F.coalesce("root", "set_id").alias("root"))
    apart = members.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last")
    loose = scratch.keep(members.join(apart, "bucket").select("set_id", "root").distinct())
    if loose.isEmpty():
        return roots
    texts = scratch.keep(sets_of(loose.select("set_id"), sets, rows, words).join(loose, "set_id").select("set_id", "root", "h"))
    more = alike(rare_mates(texts, similarity, scratch), sets, rows, words, similarity, scratch)
    return components(edges.unionByName(more), scratch)


def near_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", tables: int = TABLES, most_mated: int = MOST_MATED, most_held: int = MOST_HELD
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs, linked by the Jaccard similarity of word shingles.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle. component_id is the smallest key reachable over links, kept whether the row has it. Null and empty
    texts and those without words have no shingles and no links. Rows with a null key take part; a component of them
    alone has a null id and keeps all of them. Repeated rows stay, and an empty table gives an empty one. Other columns
    are not read. Shingles and sets of them are told apart by 64-bit hashes.
    """
    rid = "__kosha_rid"
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = numbered(docs, rid, scratch).select(F.col(rid).alias("rid"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = scratch.keep(sketches(rows, words, tables))
    filled = sketch.where("n > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    told = filled.groupBy("set_id").agg(best.alias("best"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count("*").alias("copies"))
    sets = scratch.keep(told)
    roots = near_sets(sets, rows, words, similarity, scratch, tables, most_mated, most_held)
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "best", "copies", F.coalesce("root", "set_id").alias("group"))
    leads = named.groupBy("group").agg(F.min("best")["doc_id"].alias("component_id"))
    of = scratch.keep(named.join(leads, "group").select("set_id", "copies", "component_id"))
    total = sketch.count()
    often = F.broadcast(of.where(F.col("copies") * HOT > total).select("set_id", "component_id"))  # fewer than HOT rows
    hot = filled.join(often, "set_id")
    rest = filled.join(often, "set_id", "left_anti").join(of.where(F.col("copies") * HOT <= total).select("set_id", "component_id"), "set_id")
    alone = sketch.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return hot.select(*columns).unionByName(rest.select(*columns)).unionByName(alone.select(*columns))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents: 4-word shingles, similarity of 0.8 or more.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns: see near_groups.
    """
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, similarity=0.8)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, coalesce(m.least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
