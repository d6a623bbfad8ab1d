"""Best-fit packing of token sequences by bulk-synchronous rounds.

Texts become pieces of at most `size` tokens. Pieces are taken by size class, largest first. In each round the
pieces and the open gaps are put in one order by size (gaps before pieces of their size), and a sweep from large to
small hands every piece its successor: the smallest gap not smaller than it that no larger piece took. The sweep is
a bracket matching, so it runs in parallel: prefix sums over the counts of each size give every gap and every piece
a level, the rank within a size resolves conflicts, and at each level a piece meets the gap just before it. Gaps are
updated and the round repeats until no piece of the class fits; what is left opens new sequences.

Only counts by size (at most `size` of them, split by salts) reach the driver; rows stay distributed, and a length
that a third of all pieces share is ranked in salted parts.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import Scratch

SIZE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"  # the same ids as byte_bpe_50k.json, which tests compare
WHOLE = "byte_bpe_50k.json"  # has the special tokens, which the ranks lack


class Encoder:
    """Ids of whole texts: by the ranks, and by the whole tokenizer where the ranks' pattern gives up.

    The pattern of the ranks backtracks over runs of white space, of which it takes some hundred thousand characters.
    """

    def __init__(self, ranks: str, whole: str):
        with open(whole, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.whole = Tokenizer.from_file(whole)
        self.whole.no_truncation()
        self.whole.no_padding()

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern's stack is full
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _encoder(ranks: str, whole: str) -> Encoder:
    return Encoder(ranks, whole)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full size but the first, which may be shorter."""
    first = n if n <= size else n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text", with_ids: bool = False, whole: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of docs; null text: empty, one piece of one id.

    vocabulary and whole are the paths of one tokenizer's ranks and of its JSON form. Texts of any length and kind are
    encoded whole. Null keys and repeated rows stay, an empty table gives an empty one, other columns are not read.
    """
    whole = whole or public_tokenizers.path(WHOLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, whole).ids
        for batch in batches:
            rows, source, flat = [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), END_ID).astype("<u4")
                flat.append(ids)
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    source.append(i)
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            if with_ids:  # pieces follow one another, so their ids are one array cut at their ends
                ends = np.concatenate([[0], np.cumsum(columns[2], dtype=np.int64)])
                every = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every)))
            yield pa.RecordBatch.from_arrays(arrays, names)

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return narrow.mapInArrow(run, out)


def _salted_ranks(rows: DataFrame, size: str, salts: int) -> tuple[DataFrame, dict[int, int]]:
    """rows (id, size) with rank: 0, 1, ... among the rows of a size; and the number of rows of each size."""
    spark = rows.sparkSession
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    found = rows.groupBy(size, "salt").agg(F.count("*").alias("n")).collect()
    total: dict[int, int] = {}
    base = []
    for r in sorted(found, key=lambda r: (r[size], r.salt)):
        base.append((r[size], r.salt, total.get(r[size], 0)))
        total[r[size]] = total.get(r[size], 0) + r.n
    if not base:
        return rows.select("id", size, F.lit(0).cast("long").alias("rank")), total
    bases = spark.createDataFrame(base, f"{size} int, salt int, base long")
    within = Window.partitionBy(size, "salt").orderBy("id")
    ranked = rows.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(bases), [size, "salt"])
    return ranked.select("id", size, (F.col("base") + F.col("k")).alias("rank")), total


def sweep(pieces: dict[int, int], gaps: dict[int, int], most: int) -> tuple[list, list, dict[int, int]]:
    """One successor sweep over counts: levels of the slots and pieces that meet.

    pieces, gaps: how many of each size wait. A gap offers a slot of `most` for each whole `most` in it but one, and a
    last slot with the rest. Returns (slot groups: gap, slot, order, first level, count), (piece groups: size, order,
    first level, count) and the number of matched pieces by size. A piece group takes levels downwards.
    """
    need, held, groups = sum(pieces.values()), 0, []
    least = min(pieces)
    for g in sorted(g for g in gaps if g >= least):
        if held >= need and g > most:
            break  # smaller gaps already hold a place for every piece
        k = max(1, g // most)
        for j in range(k):
            if j and held >= need:
                break
            groups.append((most if j < k - 1 else g - (k - 1) * most, g, j))
            held += gaps[g] if g >= most else 0
    events = [(-s, 0, -g, j, g, gaps[g]) for s, g, j in groups] + [(-s, 1, 0, 0, s, n) for s, n in pieces.items()]
    slots, takers, matched, height = [], [], {}, 0
    for order, (_, kind, _, j, what, n) in enumerate(sorted(events)):
        if kind == 0:
            slots.append((what, j, order, height, n))
            height += n
        elif (took := min(n, height)) > 0:
            takers.append((what, order, height - 1, took))
            matched[what] = took
            height -= took
    return slots, takers, matched


def pack(pieces: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """pieces (id long, unique; length int, 1..size) into sequences: (id, sequence_id, offset)."""
    spark = pieces.sparkSession
    salts = max(1, min(256, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    full = pieces.where(F.col("length") == size).select("id", F.col("id").alias("bin"), "length")
    ranked, left = _salted_ranks(pieces.where(F.col("length") < size).select("id", F.col("length").alias("len")), "len", salts)
    docs = scratch.keep(ranked)
    done = dict.fromkeys(left, 0)
    gaps = None
    placed = []
    high = size
    while high >= 1:
        low = high // 2
        todo = {s: n for s, n in left.items() if low < s <= high}
        while gaps is not None and any(todo.values()):
            open_gaps, gap_counts = _salted_ranks(gaps.where(F.col("gap") > low), "gap", salts)
            waiting = {s: n for s, n in todo.items() if n}
            slots, takers, matched = sweep(waiting, gap_counts, high)
            if not matched:
                break
            new = scratch.keep(_meet(spark, docs, open_gaps, slots, takers, done))
            for s, n in matched.items():
                todo[s] -= n
                done[s] += n
            placed.append(new)
            used = new.groupBy(F.col("bin").alias("id")).agg(F.sum("length").alias("used"))
            now = gaps.join(used, "id", "left").select("id", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap"))
            last, gaps = gaps, scratch.keep(now.where("gap > 0"))
            scratch.drop(last)
        if any(todo.values()):
            new = scratch.keep(_open(spark, docs, todo, done, size))
            for s, n in todo.items():
                done[s] += n
            placed.append(new)
            opened = new.groupBy(F.col("bin").alias("id")).agg((size - F.sum("length")).cast("int").alias("gap")).where("gap > 0")
            last, gaps = gaps, scratch.keep(opened if gaps is None else gaps.unionByName(opened))
            if last is not None:
                scratch.drop(last)
        high = low
    everything = full.select("id", "bin", "length")
    for new in placed:
        everything = everything.unionByName(new)
    order = Window.partitionBy("bin").orderBy(F.col("length").desc(), "id")
    return everything.select(
        "id", F.col("bin").alias("sequence_id"), (F.sum("length").over(order) - F.col("length")).cast("long").alias("offset")
    )


def _meet(spark, docs: DataFrame, gaps: DataFrame, slots: list, takers: list, done: dict[int, int]) -> DataFrame:
    """Pieces with the gaps that the sweep hands them: (id, bin, length)."""
    slot = spark.createDataFrame(slots, "gap int, slot int, order int, first long, n long")
    take = spark.createDataFrame([(s, o, f, n, done[s]) for s, o, f, n in takers], "len int, order int, first long, n long, done long")
    # levels above the highest that any piece takes hold no match, but lower ones may hold slots without a piece
    offered = gaps.join(F.broadcast(slot), "gap").select(
        (F.col("first") + F.col("rank")).alias("level"), "order", F.col("id").alias("bin"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("length")
    )
    asked = (
        docs.join(F.broadcast(take), "len")
        .where((F.col("rank") >= F.col("done")) & (F.col("rank") < F.col("done") + F.col("n")))
        .select((F.col("first") - (F.col("rank") - F.col("done"))).alias("level"), "order", F.lit(None).cast("long").alias("bin"), "id", F.col("len").alias("length"))
    )
    before = F.lag("bin").over(Window.partitionBy("level").orderBy("order"))
    met = offered.unionByName(asked).withColumn("before", before)
    return met.where("id is not null").select("id", F.col("before").alias("bin"), "length")


def _open(spark, docs: DataFrame, todo: dict[int, int], done: dict[int, int], size: int) -> DataFrame:
    """Pieces that found no gap, as many to a new sequence as its largest lets in: (id, bin, length)."""
    plan, base = [], {}
    for s in sorted((s for s, n in todo.items() if n), reverse=True):
        k = size // s
        plan.append((s, k, base.get(k, 0), done[s]))
        base[k] = base.get(k, 0) + todo[s]
    each = spark.createDataFrame(plan, "len int, k int, base long, done long")
    rows = (
        docs.join(F.broadcast(each), "len")
        .where("rank >= done")
        .select("id", "len", "k", (F.col("base") + F.col("rank") - F.col("done")).alias("at"))
        .withColumn("group", F.floor(F.col("at") / F.col("k")))
    )
    first = F.first("id").over(Window.partitionBy("k", "group").orderBy("at"))
    return rows.select("id", first.alias("bin"), F.col("len").alias("length"))


def packed_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every row of docs with its place: token_pieces plus sequence_id and offset; its ids if asked for.

    Null keys stay null and repeated rows are packed one by one; null and empty texts are one piece with the end id
    alone; an empty table gives an empty one. Columns of docs other than key and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = token_pieces(docs, vocabulary, size, key, text, with_ids).withColumn("id", F.monotonically_increasing_id())
    pieces = scratch.keep(cut)
    places = pack(pieces.select("id", F.col("length").cast("int").alias("length")), size, scratch)
    return pieces.join(places, "id").drop("id")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs, public_tokenizers.path(VOCABULARY))
