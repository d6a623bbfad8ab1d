"""Approximate nearest neighbours by low-dimensional stable projections indexed by kd-trees.

Vectors are projected on DIMS directions drawn from the 2-stable (normal) distribution. A coarse kd-tree, whose cuts
are fitted on a bounded sample, deals every row to a cell; within a cell rows form a kd-tree of small leaves. A query
visits leaves in the order of their projected distance and verifies exact distances, until the stopping test holds:
for a true neighbour at distance d, (projected distance / d)^2 follows a chi-square law with DIMS degrees of freedom,
so once the next leaf lies beyond d * sqrt(quantile) a nearer row is left with probability 1 - CONFIDENCE only.

First each query searches its own cell, which bounds its k-th distance; then only those other cells that the test
does not rule out. Rows of one vector are one index entry that keeps the smallest k + 1 ids, all that a ranking by
distance and id can use, so a vector that many rows share is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

DIMS = 8
CONFIDENCE = 0.97
SEED = 20240607
#: Rows of the sample on which the cuts of the coarse tree are fitted.
MOST_FITTED = 100_000
#: Rows that a cell should hold, and rows of the sample that every cell needs for its cuts to be balanced.
CELL_ROWS = 4096
LEAST_FITTED = 32
#: Rows of a task: where the sample allows no more cells, a cell is dealt out in parts, each with a tree of its own.
PART_ROWS = 65_536
LEAF = 64


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square law by bisection on the regularised incomplete gamma function."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        for _ in range(500):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-14:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 20.0 * k + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


def directions(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


class Tree:
    """A kd-tree over points (n, dims): leaves of at most `leaf` points unless they coincide, with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            part = points[rows]
            spread = part.max(axis=0) - part.min(axis=0)
            if len(rows) <= leaf or not spread.any():
                self.leaves.append(rows)
                continue
            axis = int(spread.argmax())
            order = rows[np.argsort(part[:, axis], kind="stable")]
            stack += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])

    def distances(self, at: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        return (np.maximum(0, np.maximum(self.low - at, at - self.high)) ** 2).sum(axis=1)


def nearest(tree: Tree, vectors: np.ndarray, ids: list, query: np.ndarray, at: np.ndarray, k: int, quantile: float, bound: float) -> list[tuple[float, int]]:
    """The k + 1 best (distance, id) found in a cell; bound: a k-th distance that is known already."""
    boxes = tree.distances(at)
    order = np.argsort(boxes, kind="stable")
    best: list[tuple[float, int]] = []
    reach = bound
    for i in order:
        if boxes[i] > quantile * reach * reach:
            break
        rows = tree.leaves[i]
        d = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        close = np.nonzero(d <= reach)[0]
        if len(close) == 0:
            continue
        best += [(float(d[j]), x) for j in close for x in ids[rows[j]]]
        best = sorted(best)[: k + 1]
        if len(best) > k:
            reach = min(reach, best[k][0])
    return best


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows whose vectors take part: not null, not empty, all finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(finite & F.exists("v", lambda x: x != 0))
    )


def search(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """For each row of queries its k nearest rows of `rows` found, itself left out: (query_id, rank, vec_id, score).

    Both tables hold key and vector; vectors that are null, zero, of another width than the most common one, or hold
    null or non-finite components take no part; an empty table gives an empty one. Ties go to the smaller id. Repeated (id, vector) rows count once.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    base = usable(rows, key, vector)
    first = base.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = first.n
    base = base.where(F.size("v") == width).distinct()
    # one entry per distinct vector; only its smallest k + 1 ids can ever be reported
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        base.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    plane = directions(width, dims)
    quantile = chi_square_quantile(confidence, dims)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = np.stack(pdf["v"].to_numpy()) @ plane
                yield pdf.assign(p=list(at))

    index = scratch.keep(entries.mapInPandas(project, "v array<double>, ids array<long>, p array<double>"))
    total = index.count()
    share = min(1.0, 1.2 * MOST_FITTED / max(1, total))
    fitted = index.select("p") if share >= 1 else index.where(F.pmod(F.xxhash64("p"), F.lit(1_000_000)) < int(share * 1_000_000)).select("p")
    sample = np.array([r.p for r in fitted.limit(MOST_FITTED).collect()]).reshape(-1, dims)
    depth = max(0, min(math.ceil(math.log2(max(1, total / CELL_ROWS))), math.floor(math.log2(max(1, len(sample) / LEAST_FITTED)))))
    cuts = _cuts(sample, depth)
    parts = max(1, math.ceil(total / 2**depth / PART_ROWS))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def deal(p: pd.Series) -> np.ndarray:
        return _cell(np.stack(p.to_numpy()), cuts, depth)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=deal(pdf["p"]))

    cells = index.mapInPandas(celled, "v array<double>, ids array<long>, p array<double>, cell int")
    cells = scratch.keep(cells.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int")))
    boxes = _boxes(cells, dims)

    asked = usable(queries, key, vector).where(F.size("v") == width).distinct()
    asked = asked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("askers"))
    asked = scratch.keep(
        asked.withColumn("q", F.sha2(F.concat_ws(",", "v"), 256))
        .mapInPandas(project, "v array<double>, askers array<long>, q string, p array<double>")
        .mapInPandas(celled, "v array<double>, askers array<long>, q string, p array<double>, cell int")
    )

    def look(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            points, vectors = np.stack(left["p"].to_numpy()), np.stack(left["v"].to_numpy())
            tree, ids = Tree(points, LEAF), left["ids"].tolist()
            for v, q, p, bound in zip(right["v"], right["q"], right["p"], right["bound"]):
                out += [(q, int(x), d) for d, x in nearest(tree, vectors, ids, v, p, k, quantile, bound)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    answer = "q string, vec_id long, score double"
    far = F.lit(float("inf"))
    own = scratch.keep(
        cells.groupBy("cell", "part").cogroup(asked.select("v", "q", "p", "cell", every_part.alias("part"), far.alias("bound")).groupBy("cell", "part")).applyInPandas(look, answer)
    )
    # the (k + 1)-th distance in the own cell bounds the search elsewhere
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id")))
    bounds = ranked.where(F.col("n") == k + 1).select("q", F.col("score").alias("bound"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                low = (np.maximum(0, np.maximum(boxes[1] - row.p, row.p - boxes[2])) ** 2).sum(axis=1)
                go = (low <= quantile * row.bound * row.bound) & (boxes[0] != row.cell)
                if go.any():
                    n = int(go.sum())
                    yield pd.DataFrame({"v": [row.v] * n, "q": row.q, "p": [row.p] * n, "cell": boxes[0][go], "bound": row.bound})

    trips = asked.join(bounds, "q", "left").select("v", "q", "p", "cell", F.coalesce("bound", far).alias("bound"))
    trips = trips.mapInPandas(visit, "v array<double>, q string, p array<double>, cell int, bound double")
    trips = trips.withColumn("part", every_part)
    other = cells.groupBy("cell", "part").cogroup(trips.groupBy("cell", "part")).applyInPandas(look, answer)
    best = own.unionByName(other).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    each = asked.select("q", F.explode("askers").alias("query_id")).join(best, "q").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cuts(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and median of every inner node of a full binary tree, level by level."""
    cuts: list[tuple[int, float]] = []
    parts = [sample]
    for _ in range(depth):
        following = []
        for part in parts:
            axis = int(part.var(axis=0).argmax()) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, at))
            left = part[:, axis] <= at if len(part) else np.zeros(0, bool)
            following += [part[left], part[~left]]
        parts = following
    return cuts


def _cell(points: np.ndarray, cuts: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes, at = np.array([a for a, _ in cuts], int), np.array([x for _, x in cuts])
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > at[node])
    return (node - (2**depth - 1)).astype(np.int32)


def _boxes(cells: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers and their bounding boxes; at most MOST_FITTED / LEAST_FITTED cells."""
    edge = [f(F.element_at("p", i + 1)).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    rows = cells.groupBy("cell").agg(*edge).collect()
    return (
        np.array([r.cell for r in rows]),
        np.array([[r[f"low{i}"] for i in range(dims)] for r in rows]),
        np.array([[r[f"high{i}"] for i in range(dims)] for r in rows]),
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)
