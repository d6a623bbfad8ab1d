"""Hard-negative mining by angular triangle filtering.

Every row stores its angles to REFERENCES directions (centres fitted on a bounded sample) and its norm. The angle between
an anchor and a row lies between the largest difference and the smallest sum of their angles to a reference, so its
cosine has an interval, and the norms make it an interval of scores, rounded outwards by more than the error of the
stored angles. Only rows whose interval overlaps a window of scores that an anchor asks for are scored, in integers.

Rows are dealt to cells (class of labels, nearest reference): small cells are put together to one place, large ones cut
into parts of PART_ROWS. An anchor first visits the places of its own cell, which raises the least score that can still
matter, and then only those whose interval, from the ranges of their rows' angles and norms, overlaps what is left. A
task joins one part with one team of anchors: a block of anchors against a block of rows. Windows follow from the scores of the positives, so there are two such
searches: positives of the same label first, then negatives of other labels in the windows that the positives set.

Rows of one label and vector are one entry that keeps its smallest ids, all that a ranking by score and id can use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import Scratch

REFERENCES = 32
#: Rows of the sample that the references are fitted on, and its rounds.
MOST_FITTED, ROUNDS = 20_000, 8
#: Classes of labels that cells are told apart by, rows of a part and anchors of a team.
CLASSES, PART_ROWS, TEAM_ROWS = 16, 4096, 1024
#: Anchors that are scored at once.
CHUNK = 64
#: More than the error of an angle in single precision and of the cosine bounds, in radians.
SLACK = 2e-6
#: Longer integer vectors take no part: their products may not fit a long.
LONGEST = 2.0**61
SEED = 20240611
HOT = 1000

ENTRY = "e string, label long, q array<long>, ids array<long>, norm double, angles array<float>, cell int"
FOUND = "e string, asked long, vec_id long, score long"


def references(vectors: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """n unit directions, rows: centres of the sample by spherical k-means, or fixed random ones for an empty sample."""
    rng = np.random.default_rng(SEED)
    width = vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    units = vectors[length > 0] / length[length > 0, None]
    centres = rng.standard_normal((n, width))
    if len(units):
        centres[: min(n, len(units))] = units[rng.permutation(len(units))[:n]]
    for _ in range(ROUNDS if len(units) else 0):
        near = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres[moved] = sums[moved]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def angles(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every reference in single precision; a zero vector has right angles."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    cosine = (vectors @ centres.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def score_bounds(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score at angles from low to high and products of norms from least to most.

    Safe for rounding: angles are widened by SLACK, products by a relative 1e-12, and the bounds go outwards.
    """
    top, bottom = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, math.pi))
    upper = np.where(top > 0, top * most, top * least)
    lower = np.where(bottom > 0, bottom * least, bottom * most)
    room = 1e-12 * most
    return np.floor(lower - room), np.ceil(upper + room)


def place_bounds(norm: float, at: np.ndarray, places: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of one anchor with the rows of each place, from the ranges of their angles and norms."""
    low = np.maximum(0, np.maximum(places["low"] - at, at - places["high"])).max(axis=1)
    high = np.minimum(math.pi, np.minimum(at + places["high"], 2 * math.pi - at - places["low"])).min(axis=1)
    return score_bounds(low, np.maximum(low, high), norm * places["least"], norm * places["most"])


def row_bounds(norm: np.ndarray, at: np.ndarray, norms: np.ndarray, held: np.ndarray, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (rows of the result) with rows, by their angles to the references `used`."""
    low = np.zeros((len(norm), len(norms)), np.float32)
    high = np.full((len(norm), len(norms)), math.pi, np.float32)
    for r in used:
        a, x = at[:, r, None], held[None, :, r]
        np.maximum(low, np.abs(a - x), out=low)
        total = a + x
        np.minimum(high, np.minimum(total, np.float32(2 * math.pi) - total), out=high)
    product = norm[:, None] * norms[None, :]
    return score_bounds(low.astype(np.float64), np.maximum(low, high).astype(np.float64), product, product)


def best_of(scores: np.ndarray, ids: list, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k (score, id), by greater score and smaller id, of entries `rows`."""
    if len(rows) > k:
        rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]  # ties stay
    return sorted(((int(scores[j]), int(x)) for j in rows for x in ids[j][:k]), key=lambda r: (-r[0], r[1]))[:k]


def scan(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The first k rows of each asked window of each anchor within one block, of the anchor's label or of others."""
    out: list[tuple] = []
    if len(anchors) and len(rows):
        a, x = np.stack(anchors["q"].to_numpy()), np.stack(rows["q"].to_numpy())
        na, nx = anchors["norm"].to_numpy(), rows["norm"].to_numpy()
        if na.max() * nx.max() < 2.0**52:  # then sums of products are whole numbers in double precision, too
            a, x = a.astype(np.float64), x.astype(np.float64)
        at, held = np.stack(anchors["angles"].to_numpy()), np.stack(rows["angles"].to_numpy())
        label, labels, ids, names = anchors["label"].to_numpy(), rows["label"].to_numpy(), rows["ids"].tolist(), anchors["e"].tolist()
        windows = anchors["windows"].tolist()
        used = sorted(set(anchors["home"]) | set(rows["cell"]))
        for first in range(0, len(a), CHUNK):
            part = slice(first, first + CHUNK)
            fits = (label[part, None] == labels[None, :]) == same
            lower, upper = row_bounds(na[part], at[part], nx, held, used)
            overlaps = np.zeros_like(fits)
            for i, asked in enumerate(windows[part]):
                for w in asked:
                    overlaps[i] |= (upper[i] >= w["low"]) & (lower[i] <= w["high"])
            overlaps &= fits
            columns = np.flatnonzero(overlaps.any(axis=0))
            if not len(columns):
                continue
            scores = a[part] @ x[columns].T
            for i, asked in enumerate(windows[part]):
                for w in asked:
                    s = scores[i]
                    good = np.flatnonzero(overlaps[i, columns] & (s >= w["low"]) & (s <= w["high"]))
                    if len(good):
                        whole = np.zeros(len(x), s.dtype)
                        whole[columns] = s
                        out += [(names[first + i], w["asked"], v, n) for n, v in best_of(whole, ids, columns[good], k)]
    return pd.DataFrame(out, columns=["e", "asked", "vec_id", "score"])


def _filled(counts: list[tuple[object, int]], most: int) -> list[int]:
    """Numbers that put neighbouring cells (class, rows) of one class together up to `most` rows; a larger one is alone."""
    out, kind, held = [], None, 0
    for k, n in counts:
        new = not out or k != kind or held + n > most
        out.append(out[-1] + new if out else 0)
        kind, held = k, n if new else held + n
    return out


class Index:
    """Entries dealt to places (cells of one class, together up to a part's rows), and what bounds the scores of each."""

    def __init__(self, entries: DataFrame, width: int, scratch: Scratch, part_rows: int = PART_ROWS):
        self.scratch = scratch
        total = entries.count()
        share = min(1.0, 1.2 * MOST_FITTED / max(1, total))
        fitted = entries.select("q").where(F.pmod(F.xxhash64("e"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
        sample = fitted.limit(MOST_FITTED).toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, width)
        centres = references(sample.astype(np.float64))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    norm, at = angles(np.stack(pdf["q"].to_numpy()).astype(np.float64), centres)
                    yield pdf.assign(norm=norm, angles=list(at), cell=at.argmin(axis=1).astype(np.int32))

        placed = scratch.keep(entries.mapInPandas(place, ENTRY).withColumn("kind", F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int")))
        edges = [f(F.element_at("angles", i + 1)).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(REFERENCES)]
        told = placed.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), *edges)
        rows = told.orderBy("kind", "cell").collect()  # at most CLASSES * REFERENCES
        at = _filled([(r.kind, r.n) for r in rows], part_rows)
        held = [[r for r, x in zip(rows, at) if x == i] for i in range(max(at, default=-1) + 1)]
        self.places = {"kind": np.array([p[0].kind for p in held]), "parts": np.array([-(-sum(r.n for r in p) // part_rows) for p in held])}
        self.places |= {c: np.array([f(r[c] for r in p) for p in held]) for c, f in (("least", min), ("most", max))}
        self.places |= {c: np.array([[f(r[f"{c}{i}"] for r in p) for i in range(REFERENCES)] for p in held], np.float64) for c, f in (("low", min), ("high", max))}
        self.homes = np.zeros((REFERENCES, len(held)), bool)  # the places that hold rows of a cell
        for r, x in zip(rows, at):
            self.homes[r.cell, x] = True
        spots = scratch.spark.createDataFrame([(r.kind, r.cell, x, int(self.places["parts"][x])) for r, x in zip(rows, at)], "kind int, cell int, place int, parts int")
        dealt = placed.join(F.broadcast(spots), ["kind", "cell"]).withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int")).drop("parts")
        self.rows = scratch.keep(dealt)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(e, asked, vec_id, score): the first k of every window of anchors (ENTRY, kind, team, windows).

        A window is a struct (asked, low, high): its name, and the least and greatest score that it takes.
        """
        own = self._visit(anchors, k, same, home=True)
        # a full window asks elsewhere for scores from its k-th on only
        order = Window.partitionBy("e", "asked").orderBy(F.desc("score"), "vec_id")
        full = own.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("e", "asked", F.col("score").alias("kth"))
        each = anchors.select("*", F.explode("windows").alias("w")).withColumn("asked", F.col("w.asked")).join(full, ["e", "asked"], "left")
        w = F.struct("asked", F.greatest(F.col("w.low"), F.coalesce("kth", F.col("w.low"))).alias("low"), F.col("w.high").alias("high"))
        left = each.groupBy("e").agg(F.collect_list(w).alias("windows"))  # few windows to an anchor
        elsewhere = self._visit(anchors.drop("windows").join(left, "e"), k, same, home=False)
        both = own.unionByName(elsewhere).withColumn("n", F.row_number().over(order))
        return self.scratch.keep(both.where(F.col("n") <= k).drop("n"))

    def _visit(self, anchors: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        places, homes = self.places, self.homes

        def trips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                goes = []
                for row in pdf.itertuples():
                    lower, upper = place_bounds(row.norm, np.asarray(row.angles, np.float64), places)
                    some = np.zeros(len(lower), bool)
                    for w in row.windows:
                        some |= (upper >= w["low"]) & (lower <= w["high"])
                    some &= (homes[row.cell] == home) & ((places["kind"] == row.kind) | (not same))
                    goes.append(list(np.flatnonzero(some)))
                yield pdf[["e", "team"]].assign(goes=goes)

        if not homes.size:
            return self.scratch.spark.createDataFrame([], FOUND)
        parts = F.broadcast(self.scratch.spark.createDataFrame([(i, int(n)) for i, n in enumerate(places["parts"])], "place int, parts int"))
        went = anchors.mapInPandas(trips, "e string, team string, goes array<int>").select("e", "team", F.explode("goes").alias("place"))
        went = self.scratch.keep(went.join(parts, "place").select("e", "team", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        wanted = went.select("place", "part", F.col("team").alias("by")).distinct()
        asked = anchors.select("e", "label", "q", "norm", "angles", "windows", F.col("cell").alias("home")).join(went, "e")
        left, right = asked.groupBy("place", "part", "team"), self.rows.join(wanted, ["place", "part"]).groupBy("place", "part", "by")
        return self.scratch.keep(left.cogroup(right).applyInPandas(lambda a, r: scan(a, r, k, same), FOUND))


def usable(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, q): rows that take part, with whole numbers floor(scale * x) for components x."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LONGEST))
    kind = F.col(label).cast("long") if isinstance(rows.schema[label].dataType, IntegralType) else F.xxhash64(label)
    fine = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    short = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < LONGEST
    return fine.select(F.col(key).cast("long").alias("vec_id"), kind.alias("label"), v.alias("q")).where(short)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", part_rows: int = PART_ROWS, team_rows: int = TEAM_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` marks.

    A score is the inner product of whole-number vectors floor(scale * x). An anchor's positives are the first rows of
    its label by score, itself left out; each brings the first rows of other labels whose score lies in the window of
    per cents of the positive's. Ties go to the smaller id. anchors is a condition on the column vec_id.

    Rows with a null key, label or vector, or with null or non-finite components, take no part, nor do those of another
    width than the most common one (the smaller, if two are) and those whose whole-number vector is longer than 2 ** 30,
    since scores of such may not fit a long. Zero vectors score 0 with all rows. Repeated rows of one id, label and
    vector count once; an id that has several vectors or labels is as many rows. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    base = usable(rows, key, vector, label, scale)
    first = base.groupBy(F.size("q").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if first is None or not first.width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = base.where(F.size("q") == first.width).withColumn("e", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>")).cast("binary")))
    named = scratch.keep(named.dropDuplicates(["e", "vec_id"]))
    held = max(positives + 1, negatives)
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("n") <= held)
    entries = scratch.keep(ranked.groupBy("e").agg(F.first("label").alias("label"), F.first("q").alias("q"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = Index(entries, first.width, scratch, part_rows)

    askers = scratch.keep(named.where(anchors).select("vec_id", "e"))
    number = askers.groupBy("e").agg(F.count("*").alias("askers"))
    asked = index.rows.join(number, "e").drop("part")
    sizes = asked.groupBy("cell").count().orderBy("cell").collect()  # at most REFERENCES
    teams = _filled([(0, r["count"]) for r in sizes], team_rows)
    spots = spark.createDataFrame([(r.cell, t, -(-r["count"] // team_rows)) for r, t in zip(sizes, teams)], "cell int, t int, salts int")
    asked = asked.drop("place").join(F.broadcast(spots), "cell").withColumn("team", F.concat_ws(":", "t", F.pmod(F.xxhash64("e"), "salts"))).drop("t", "salts")
    whole = F.struct(F.lit(0).cast("long").alias("asked"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))
    asked = scratch.keep(asked.withColumn("windows", F.array(whole)))
    near = index.search(asked, positives + 1, same=True)  # the anchor itself may be among them

    low, high = window
    score = F.col("score").cast("decimal(38,0)")
    ends = F.struct(F.col("score").alias("asked"), F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    windows = near.where("score >= 0").select("e", "score").distinct().groupBy("e").agg(F.collect_list(ends).alias("windows"))
    far = index.search(scratch.keep(asked.drop("windows").join(windows, "e")), negatives, same=False)

    listed = far.groupBy("e", "asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("negatives"))
    pairs = near.join(listed, (near.e == listed.e) & (near.score == listed.asked), "left").select(near.e, F.struct((-F.col("score")).alias("s"), "vec_id", "negatives").alias("p"))
    answers = scratch.keep(pairs.groupBy("e").agg(F.sort_array(F.collect_list("p")).alias("p")).join(number, "e"))
    total = askers.count()
    often = F.broadcast(answers.where(F.col("askers") * HOT > total).drop("askers"))  # fewer than HOT rows
    rest = answers.where(F.col("askers") * HOT <= total).drop("askers")
    each = askers.join(often, "e").unionByName(askers.join(often, "e", "left_anti").join(rest, "e"))
    mates = each.select(F.col("vec_id").alias("anchor_id"), F.explode(F.slice(F.filter("p", lambda p: p["vec_id"] != F.col("vec_id")), 1, positives)).alias("p"))
    told = mates.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.s")).alias("positive_score"), F.posexplode("p.negatives").alias("at", "n"))
    return told.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 hard negatives for each of 5 positives of every row whose id is divisible by 100.

    Where the id is divisible by 7 the label is moved on by one. Nulls, ties, repeated rows, empty tables: see mine.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.own <> n.label AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10
"""
