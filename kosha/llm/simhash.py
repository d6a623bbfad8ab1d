"""SimHash near-duplicate linking with pigeonring candidate filtering.

Fingerprints that differ in at most `radius` bits are linked. The 64 bits form a ring of m segments. By the
pigeonring principle two linked fingerprints have a segment from which every chain of l consecutive segments
differs in at most floor(l * radius / m) bits. The leading segments of that chain, whose budget is zero, are the
join key; the budgets of longer chains prune candidates before the full Hamming check.

Buckets of the key that hold more than MOST_PAIRED fingerprints are not paired: each member is tied to the points
at most one bit away (within the bits that the bucket leaves free) and members meet in shared points, which is
exact for a radius of 2 and linear in the bucket. Work is done on distinct fingerprints, so copies cost nothing.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, numbered

SEED = 42
MOST_PAIRED = 32
#: Shingles that are counted at once, so that very long texts need bounded memory.
BLOCK = 1 << 16
#: Near copies: views per text, shingles that a view samples, and the bucket size up to which all members are paired.
VIEWS = 16
SAMPLE = 3
MOST_MATED = 24
#: Slots that shingles are counted in to tell rare from common ones (a power of two), and the sides of a block of pairs.
SLOTS = 1 << 18
BLOCK_SIDES = 256, 2048
PARITIES = 4


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number; 0 for a text without words."""
    w = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; null texts count as empty, null keys stay. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


class Ring:
    """Segments of the 64 bits and the chains that the pigeonring principle allows for a radius."""

    def __init__(self, radius: int, segments: int | None = None):
        self.radius = radius
        self.m = segments or 2 * radius + 1
        cuts = [round(64 * i / self.m) for i in range(self.m + 1)]
        self.masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        self.budget = [length * radius // self.m for length in range(1, self.m + 1)]
        self.exact = sum(1 for b in self.budget if b == 0)

    def chain(self, start: int, length: int) -> int:
        mask = 0
        for k in range(length):
            mask |= self.masks[(start + k) % self.m]
        return mask

    @staticmethod
    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >= 1 << 63 else mask

    def keyed(self, fps: DataFrame) -> DataFrame:
        """fps (fp) with one row per chain start: (fp, start, key)."""
        keys = [
            F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(self.signed(self.chain(i, self.exact)))).alias("key"))
            for i in range(self.m)
        ]
        return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key")

    def within(self, diff: Column, start: Column) -> Column:
        """All chains from start stay within their budgets, then the whole difference does."""
        per_start = [
            [F.bit_count(diff.bitwiseAND(F.lit(self.signed(self.chain(i, length))))) <= self.budget[length - 1] for length in range(self.exact + 1, self.m)]
            for i in range(self.m)
        ]
        cases = None
        for i, tests in enumerate(per_start):
            good = F.lit(True)
            for test in tests:
                good = good & test
            cases = F.when(start == i, good) if cases is None else cases.when(start == i, good)
        return cases.otherwise(F.lit(False)) & (F.bit_count(diff) <= self.radius)

    def free_bits(self, start: int) -> list[int]:
        held = self.chain(start, self.exact)
        return [b for b in range(64) if not held >> b & 1]


def links(fps: DataFrame, scratch: Scratch, radius: int = 2, segments: int | None = None, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fps (fp long) at most radius bits apart."""
    if radius != 2:
        raise ValueError("points one bit away tie fingerprints up to 2 bits apart; other radii are not supported")
    ring = Ring(radius, segments)
    keyed = ring.keyed(fps)
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("held")).where("held > 1")
    kept = scratch.keep(keyed.join(shared, ["start", "key"]))
    few, many = kept.where(F.col("held") <= most_paired), kept.where(F.col("held") > most_paired)
    left, right = few.select("start", "key", F.col("fp").alias("a")), few.select("start", "key", F.col("fp").alias("b"))
    pairs = (
        left.join(right, ["start", "key"])
        .where(F.expr("a < b") & ring.within(F.col("a").bitwiseXOR(F.col("b")), F.col("start")))
        .select("a", "b")
    )
    one_off = None
    for i in range(ring.m):
        flips = F.array(*[F.lit(0).cast("long")] + [F.lit(ring.signed(1 << b)).cast("long") for b in ring.free_bits(i)])
        one_off = F.when(F.col("start") == i, flips) if one_off is None else one_off.when(F.col("start") == i, flips)
    points = many.select("fp", F.explode(one_off).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    # members at one point are at most two flips apart: tie each to the smallest of them
    tied = (
        points.join(points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1"), "point")
        .where("fp <> least")
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
    )
    return scratch.keep(pairs.unionByName(tied).distinct())


def near_classes(
    docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, Scratch]:
    """(doc_id, fp, component_id) per row of docs: the smallest key reachable over links, itself included.

    Null and empty texts have the fingerprint 0 and are linked like any other. Rows with a null key take part; their
    component is named by its smallest key that is not null, or null where there is none. Repeated rows stay.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, words, key, text))
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), scratch, radius), scratch).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # a fingerprint alone in its component needs no further join
    of = scratch.keep(named.join(ids, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id"), scratch


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents: 3-word shingles, 2 bits."""
    found, _ = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text in order; none for a text without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def views(hashes: np.ndarray, n: int = VIEWS, sample: int = SAMPLE) -> list[int]:
    """SimHashes of n samples of a set of shingles, each the `sample` smallest under its own mixing of the hashes.

    Two sets of Jaccard similarity s have the same sample with a probability near s ** sample, so of 16 views of 3 at
    least one agrees for 99.99 % of pairs at 0.8.
    """
    out = []
    with np.errstate(over="ignore"):
        for i in range(n):
            x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            least = np.argpartition(x, sample)[:sample] if len(x) > sample else np.arange(len(x))
            out.append(_majority(hashes[least]) if len(least) else 0)
    return out


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(rid, doc_id, set_id, fp, views) of rows (rid, doc_id, text); equal sets of shingles have equal set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps, seen = [], [], []
            for cell in batch.column(2):
                h = shingle_hashes(cell.as_py(), words)
                sets.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                fps.append(_majority(h) if len(h) else 0)
                seen.append(views(h))
            arrays = [batch.column(0), batch.column(1), pa.array(sets, pa.int64()), pa.array(fps, pa.int64()), pa.array(seen, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "set_id", "fp", "views"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid string, doc_id {kind}, set_id long, fp long, views array<long>")


def sets_of(wanted: DataFrame, sets: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(set_id, h array of shingle hashes) of wanted (set_id), read from one text of each set."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["set_id", "h"])

    named = sets.join(wanted, "set_id").select("set_id", F.col("best.rid").alias("rid"))
    return rows.join(named, "rid").select("set_id", "text").mapInArrow(hashes, "set_id long, h array<long>")


def alike(pairs: DataFrame, sets: DataFrame, rows: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles are similar enough."""
    pairs = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # the check needs the sets of candidates alone
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    texts = scratch.keep(sets_of(wanted, sets, rows, words))
    both = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("h").alias("ha")), "a").join(texts.select(F.col("set_id").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    similar = common / F.greatest(F.size("ha") + F.size("hb") - common, F.lit(1)) >= similarity
    return scratch.keep(both.where(similar).select("a", "b"))


def rare_mates(texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Candidates (a, b) among texts (set_id, root, h), none missed: pairs of different roots that may be similar.

    Prefix filter: with shingles in one order for all, two similar sets share one of their first
    n - ceil(similarity n) + 1, and the first shared one leaves room for the overlap that similarity needs. Rare
    shingles come first. Parity filter: PARITIES longs hold the parity of a set's shingles by bit; bits that differ are
    at most the shingles of one set alone, of which similarity allows only so many. A shingle's members are dealt out in blocks of pairs; those of its largest group so far need
    no pairs among themselves.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["slot", "n"])

    told = texts.select("h").mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[told.column("slot").to_numpy()] = told.column("n").to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, root, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = cell.values.to_numpy()
                n = len(h)
                k = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                first = h[np.lexsort((h, often[h & (SLOTS - 1)]))[:k]]
                arrays = [pa.array(np.full(len(first), x)) for x in (name, root)]
                arrays += [pa.array(np.full(len(first), n, np.int32)), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(first)]
                odd = np.bincount((h >> 40) & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
                arrays += [pa.array(np.full(len(first), x)) for x in np.packbits(odd.astype(np.uint8)).view(np.int64)]
                yield pa.RecordBatch.from_arrays(arrays, ["set_id", "root", "n", "at", "h", *bits])

    bits = [f"bits{i}" for i in range(PARITIES)]
    schema = ", ".join(["set_id long, root long, n int, at int, h long", *(f"{b} long" for b in bits)])
    keyed = scratch.keep(texts.select("set_id", "root", "h").mapInArrow(prefixes, schema))
    groups = keyed.groupBy("h", "root").agg(F.count("*").alias("n"))
    groups = groups.groupBy("h").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    sides = [F.ceil(x / F.lit(most)).cast("int") for x, most in zip((F.col("all") - F.col("most.n"), F.col("all")), BLOCK_SIDES)]
    keyed = scratch.keep(keyed.join(groups.select("h", F.col("most.root").alias("most"), sides[0].alias("down"), sides[1].alias("across")), "h"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    left = keyed.where("root <> most").withColumns({"i": own("down"), "j": every("across")})
    right = keyed.withColumns({"i": every("down"), "j": own("across")})
    left, right = (t.select("h", "i", "j", *[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "root", "n", "at", *bits)]) for t, x in ((left, "a"), (right, "b")))
    room = 1 + F.least(F.expr("n_a - at_a - 1"), F.expr("n_b - at_b - 1"))
    near = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    near = near & (room >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6) & F.expr("root_a <> root_b")
    differ = reduce(operator.add, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in bits])
    near = near & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)
    return left.join(right, ["h", "i", "j"]).where(near).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))


def near_copies(docs: DataFrame, rid: str, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, group, keep) per row of docs: groups of texts linked by a Jaccard similarity of word shingles.

    Candidates are pairs of distinct shingle sets whose fingerprints differ in 2 bits at most (found by the pigeonring
    filter) or one of whose views agrees; every candidate is then checked on its whole sets. keep marks one row of
    each group: the smallest key that is not null, then the smallest rid. Texts without words are one group. In a
    bucket of more than MOST_MATED sets each is first checked against the least, the greatest and the most central of
    it; the sets of a bucket that this does not make one group are joined by their rarest shingles, which is exact.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = docs.select(F.col(rid).alias("rid"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = scratch.keep(_sketches(rows, words))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    sets = scratch.keep(sketch.groupBy("set_id").agg(best.alias("best"), F.first("fp").alias("fp"), F.first("views").alias("views")))

    # candidates by whole fingerprints: sets of one fingerprint, and fingerprints that the pigeonring filter links
    fps = sets.groupBy("fp").agg(F.min("set_id").alias("least"))
    same = sets.join(fps, "fp").where("set_id <> least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    near = links(fps.select("fp"), scratch)
    ends = near.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    # candidates by views
    seen = sets.select("set_id", F.posexplode("views").alias("view", "value"))
    shared = seen.groupBy("view", "value").agg(F.count("*").alias("held"), F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("held > 1")
    held = scratch.keep(seen.join(shared, ["view", "value"]))
    few, many = held.where(F.col("held") <= MOST_MATED), held.where(F.col("held") > MOST_MATED)
    mates = few.select("view", "value", F.col("set_id").alias("a")).join(few.select("view", "value", F.col("set_id").alias("b")), ["view", "value"]).where("a < b").select("a", "b")
    # what a bucket's texts are edits of lies in more of the large buckets than the edits do
    busy = many.join(many.groupBy("set_id").agg(F.count("*").alias("large")), "set_id")
    central = busy.groupBy("view", "value").agg(F.max(F.struct("large", "set_id"))["set_id"].alias("mid"))
    tied = many.join(central, ["view", "value"]).select(F.col("set_id").alias("a"), F.explode(F.array("low", "high", "mid")).alias("b")).where("a <> b")
    pairs = same.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(mates).unionByName(tied)
    edges = alike(pairs, sets, rows, words, similarity, scratch)
    roots = components(edges, scratch)
    # large buckets of more than one group so far
    members = many.join(roots, F.col("set_id") == F.col("node"), "left").select("view", "value", "set_id", F.coalesce("root", "set_id").alias("root"))
    apart = members.groupBy("view", "value").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last")
    loose = scratch.keep(members.join(apart, ["view", "value"]).select("set_id", "root").distinct())
    if not loose.isEmpty():
        texts = scratch.keep(sets_of(loose.select("set_id"), sets, rows, words).join(loose, "set_id").select("set_id", "root", "h"))
        more = alike(rare_mates(texts, similarity, scratch), sets, rows, words, similarity, scratch)
        roots = components(edges.unionByName(more), scratch)
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "best", F.coalesce("root", "set_id").alias("group"))
    leads = named.groupBy("group").agg(F.min("best").alias("lead"))
    of = scratch.keep(named.join(leads, "group").select("set_id", "group", F.col("lead.rid").alias("lead")))
    return sketch.join(of, "set_id").select("rid", "doc_id", "group", (F.col("rid") == F.col("lead")).alias("keep"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies; all columns stay as they are."""
    rid = "__kosha_rid"
    scratch = Scratch(docs.sparkSession, "copies")
    rows = numbered(docs, rid, scratch)
    gone = scratch.keep(near_copies(rows, rid, words, similarity, key, text).where(~F.col("keep")).select(F.col("rid").alias(rid)))
    return rows.join(gone, rid, "left_anti").select(*docs.columns)
