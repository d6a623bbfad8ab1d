"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of SECTORS sectors; a row belongs to the first node at or after its
sector. A shard takes rows only up to its capacity, in ring order; the rest continue clockwise to the next node
of a shard with room. Capacities are the floor or ceiling of rows / shards, so counts differ by one at most.

Rows are never gathered: only the counts of the ring's sectors (a constant number) decide how many rows of each
arc stay or move on, and each row finds its shard from its rank within its arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Resolution of the ring; bounds every broadcast below.
SECTORS = 1 << 16
#: Rows of a sector that one task ranks; a sector with more, such as that of a hot key, is ranked in parts.
RANKED = 1_000_000


def ring_nodes(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(sector, shard) of every virtual node in clockwise order; a node's place depends on its own name alone."""
    names = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.shiftrightunsigned(
            F.xxhash64(F.lit("node"), (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)), 48
        ).alias("sector"),
    )
    return sorted((r.sector, r.shard) for r in names.collect())


def overflow(nodes: list[tuple[int, int]], counts: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, rows, shard) after the rows that find a full shard have moved on clockwise.

    Works on counts of arcs only. In each round every shard takes the waiting rows in ring order while it has
    room; what is left waits at the next node of another shard that still has room.
    """
    room = list(capacity)
    waiting = [(arc, 0, n, arc) for arc, n in sorted(counts.items()) if n]
    out = []
    while waiting:
        left = []
        for arc, first, n, at in sorted(waiting, key=lambda w: (w[3], w[0], w[1])):
            shard = nodes[at][1]
            took = min(n, room[shard])
            if took:
                room[shard] -= took
                out.append((arc, first, took, shard))
            if n > took:
                left.append((arc, first + took, n - took, at))
        waiting = []
        for arc, first, n, at in left:
            step = next(k for k in range(1, len(nodes) + 1) if room[nodes[(at + k) % len(nodes)][1]] > 0)
            waiting.append((arc, first, n, (at + step) % len(nodes)))
    return out


def ring_shards(
    docs: DataFrame, shards: int = 8, vnodes: int = 128, key: str = "doc_id", text: str = "text", ranked: int = RANKED
) -> DataFrame:
    """Place every row of docs: (doc_id, size, text_crc32, shard, slot).

    size is the UTF-8 length of the text plus 1 (null text: 1); text_crc32 is 0 for null and empty texts. Rows with
    a null key are spread by a number of their own; rows that repeat are placed like any other; no rows, no shards.
    Equal keys sit in one sector and so are ordered by size and checksum before they overflow. A sector of more than
    `ranked` rows is dealt out in parts by the rows' places in a written table, which lost tasks find again, and the
    order is that within parts. Other columns of docs are not read. slot counts from 0 within a shard without gaps.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ring")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.when(F.col(key).isNull(), F.xxhash64(F.lit("null"), F.monotonically_increasing_id()))
        .otherwise(F.xxhash64(F.lit("key"), F.col(key)))
        .alias("point"),
    ).withColumn("sector", F.shiftrightunsigned("point", 48).cast("int"))
    rows = scratch.keep(rows)
    # at most one row per `ranked` rows of docs
    hot = scratch.keep(
        rows.groupBy("sector").agg(F.count("*").alias("n")).where(F.col("n") > ranked).select("sector", F.ceil(F.col("n") / ranked).alias("parts"))
    )
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    rows = (
        rows.withColumn("place", place)
        .join(F.broadcast(hot), "sector", "left")
        .withColumn("part", F.coalesce(F.pmod("place", "parts"), F.lit(0)))
        .drop("place", "parts")
    )

    nodes = ring_nodes(spark, shards, vnodes)
    # a node owns the sectors after the node before it, up to its own; those past the last node belong to the first
    arcs = [(i, (nodes[i - 1][0] + 1) if i else 0, at, 0) for i, (at, _) in enumerate(nodes)]
    arcs.append((0, nodes[-1][0] + 1, SECTORS - 1, 1))
    owners = spark.createDataFrame([a for a in arcs if a[1] <= a[2]], "arc int, lo int, hi int, wrapped int").select(
        F.explode(F.sequence("lo", "hi")).alias("sector"), "arc", "wrapped"
    )
    held = rows.groupBy("sector", "part").agg(F.count("*").alias("n"))
    # rank of a part's first row within its arc; sectors past the last node come before those at the start
    base = Window.partitionBy("arc").orderBy(F.col("wrapped").desc(), "sector", "part")
    starts = scratch.keep(
        held.join(F.broadcast(owners), "sector").select(
            "sector", "part", "arc", "n", (F.sum("n").over(base) - F.col("n")).alias("arc_base")
        )
    )
    counts = {r.arc: r.n for r in starts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    filled, segments = [0] * shards, []
    for arc, first, n, shard in overflow(nodes, counts, capacity):
        segments.append((arc, first, first + n, shard, filled[shard] - first))
        filled[shard] += n
    plan = spark.createDataFrame(segments, "arc int, seg_first long, seg_end long, shard int, shift long")

    within = Window.partitionBy("sector", "part").orderBy("point", "size", "text_crc32", "doc_id")
    ranked = (
        rows.withColumn("k", F.row_number().over(within) - 1)
        .join(F.broadcast(starts.select("sector", "part", "arc", "arc_base")), ["sector", "part"])
        .withColumn("arc_rank", F.col("arc_base") + F.col("k"))
    )
    hit = (F.col("arc_rank") >= F.col("seg_first")) & (F.col("arc_rank") < F.col("seg_end"))
    return (
        ranked.join(F.broadcast(plan), "arc")
        .where(hit)
        .select("doc_id", "size", "text_crc32", "shard", (F.col("arc_rank") + F.col("shift")).alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 8 shards under the law `rows`: counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ring_shards(docs, shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
