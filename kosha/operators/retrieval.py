"""Vector search, reranking and fusion over tables of vectors."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Words whose place a worker keeps, and texts that are counted at a time.
KNOWN_WORDS, TEXT_BLOCK = 1 << 16, 512


class _Places(dict):
    """The place at which a word counts: its dimension, `dims` further on if it counts down."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        at = self[word] = h % self.dims + (0 if h >> 63 else self.dims)
        return at


_places = functools.cache(_Places)


def hashed(texts: list[str], dims: int) -> np.ndarray:
    """Signed counts of hashed words, of unit length: a row for each text."""
    place = _places(dims).__getitem__
    out = np.zeros((len(texts), dims))
    for at in range(0, len(texts), TEXT_BLOCK):
        words = [t.lower().split() for t in texts[at : at + TEXT_BLOCK]]
        found = np.fromiter(map(place, itertools.chain.from_iterable(words)), np.int64)
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        told = np.bincount(row * 2 * dims + found, minlength=len(words) * 2 * dims).reshape(len(words), 2, dims)
        out[at : at + len(words)] = told[:, 0] - told[:, 1]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def hashed_words(c: Column, dims: int = 64) -> Column:
    """embed's default vector of a text as a column: no join brings it back to its row, and it is computed only where used."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed(texts.tolist(), dims).astype(np.float32)))

    return vectors.asNondeterministic()(c)  # a filter on the vector does not compute it once more


def embed(rows: DataFrame, key: str, text: str, dims: int = 64, batch=None) -> DataFrame:
    """(key, vector, raw text) of rows with text; batch: list of texts to an array of vectors, by default hashed words.

    The default maps words to dims signed counts of unit length, so that the pipeline runs without a model.
    """
    encode = batch or (lambda texts: hashed(texts, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = encode(b.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors.tolist(), pa.list_(pa.float32())), b.column(1)], [key, "vector", text])

    kind = rows.schema[key].dataType.simpleString()
    kept = rows.where(F.trim(text) != "").select(key, F.col(text))
    return kept.mapInArrow(run, f"{key} {kind}, vector array<float>, {text} string")


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a direction: not null, not empty, all finite, not all zero."""
    v = F.col(vector)
    good = F.size(v) > 0
    good = good & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & good)


def filtered(rows: DataFrame, any_of: dict[str, list] | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """rows that pass every filter of a search: columns with one of some values, of at least, and of at most a value.

    A filter comes before the ranking, so a search still gives k results where as many rows pass; None filters nothing.
    """
    for column, values in (any_of or {}).items():
        rows = rows if values is None else rows.where(F.col(column).isin(list(values)))
    for column, value in (least or {}).items():
        rows = rows if value is None else rows.where(F.col(column) >= value)
    for column, value in (most or {}).items():
        rows = rows if value is None else rows.where(F.col(column) <= value)
    return rows


#: Queries that one task holds, vectors that it compares with them, and scores that it has in memory at a time.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 32_768
CELLS = 1 << 20


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best of x by cosine for every row of q, ties to smaller ids; CELLS scores at a time."""
    step = max(1, CELLS // max(1, len(x)))
    parts = [(at, _best_of(q[at : at + step], x, ids, k, least)) for at in range(0, len(q), step)]
    if not parts:
        return np.zeros(0, int), ids[:0], np.zeros(0)
    return np.concatenate([at + p[0] for at, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


def _best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sims = q @ x.T
    score = np.round(sims, 9)
    near = np.ones(score.shape, bool) if least is None else sims >= least
    if k < score.shape[1]:  # what reaches the k-th best score, ties and all, is then put in order
        near &= score >= np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    del score
    rows, at = np.nonzero(near)
    order = np.lexsort((ids[at], -np.round(sims[rows, at], 9), rows))
    rows, at = rows[order], at[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(q)))[:-1]])
    keep = np.arange(len(rows)) - first[rows] < k
    rows, at = rows[keep], at[keep]
    return rows, ids[at], sims[rows, at]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, most_queries: int = QUERY_BLOCK, least: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): cosine, highest first; queries (query_id, q) and vectors (vec_id, v).

    A query table of at most most_queries rows goes to every partition of vectors; a larger one is cut into blocks, and
    each task compares one block of queries with one block of vectors. Either way a task keeps its own best k of each
    query before rows are shuffled. least: scores below it do not count. Vectors without a direction take no part.
    """
    queries, vectors = usable(queries, "q").select("query_id", "q"), usable(vectors, "v").select("vec_id", "v")
    held = queries.limit(most_queries + 1).collect()
    answer = "query_id long, vec_id long, score double"
    if not held:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(held) <= most_queries:
        names, q = np.array([r.query_id for r in held]), _unit(r.q for r in held)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            for pdf in batches:
                if len(pdf):
                    rows, ids, score = _best(q, _unit(pdf["v"]), pdf["vec_id"].to_numpy(), k, least)
                    both = pd.concat([kept, pd.DataFrame({"query_id": names[rows], "vec_id": ids, "score": score})]) if len(kept) else pd.DataFrame({"query_id": names[rows], "vec_id": ids, "score": score})
                    both = both.assign(s=both["score"].round(9)).sort_values(["s", "vec_id"], ascending=[False, True])
                    kept = both.groupby("query_id", sort=False).head(k)[["query_id", "vec_id", "score"]]
            yield kept

        found = vectors.mapInPandas(best, answer)
    else:
        found = _blocked(queries, vectors, k, least)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocked(queries: DataFrame, vectors: DataFrame, k: int, least: float | None) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in every block of vectors, a task a pair of blocks."""
    across, down = (max(1, math.ceil(t.count() / n)) for t, n in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("i", own("query_id", across)).withColumn("j", every(down))
    right = vectors.withColumn("j", own("vec_id", down)).withColumn("i", every(across))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            rows, found, score = _best(_unit(a["q"]), _unit(b["v"]), b["vec_id"].to_numpy(), k, least)
            out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "query_id long, vec_id long, score double")


def near_k(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, fitted: int = 20_000, tried: int = 200, seed: int = 7) -> DataFrame:
    """Approximate top_k: vectors are dealt out to cells by their nearest centre, and a query searches its nearest cells.

    Centres (one for about 256 rows, at most 4,096) are fitted by a few rounds of spherical k-means on at most `fitted`
    rows chosen by a hash of their id, and every row is indexed. How many cells a query searches is measured: `tried`
    queries, chosen by a hash too, are answered exactly, and the nearest cells that hold the share `recall` of their
    neighbours are what every query searches.
    """
    queries, vectors = usable(queries, "q").select("query_id", "q"), usable(vectors, "v").select("vec_id", "v")
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fitted).select("v").collect()
    if not sample:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = _unit(r.v for r in sample)
    cells = max(1, min(4096, len(points), round(n / 256)))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:cells]]
    for _ in range(8):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    asking = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(tried)
    asked_of = {r.query_id: r.q for r in asking.collect()}
    if not asked_of:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    told = queries.sparkSession.createDataFrame(list(asked_of.items()), queries.schema)
    pairs = top_k(told, vectors, k).join(vectors, "vec_id").select("query_id", "v").collect()  # at most tried * k
    visited = np.argsort(-(_unit(asked_of[r.query_id] for r in pairs) @ centres.T), axis=1, kind="stable")
    homes = (_unit(r.v for r in pairs) @ centres.T).argmax(axis=1)
    most = 1 + int(np.quantile((visited == homes[:, None]).argmax(axis=1), recall, method="higher"))

    def deal(column: str, keep: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    near = np.argsort(-(_unit(pdf[column]) @ centres.T), axis=1, kind="stable")[:, :keep]
                    yield pdf.assign(cells=list(near.astype(np.int32)))

        return run

    dealt = vectors.mapInPandas(deal("v", 1), "vec_id long, v array<double>, cells array<int>").select("vec_id", "v", F.element_at("cells", 1).alias("cell"))
    asked = queries.mapInPandas(deal("q", most), "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))
    # a large cell is several tasks
    parts = max(1, math.ceil(n / cells / VECTOR_BLOCK))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows, ids, score = _best(_unit(a["q"]), _unit(b["v"]), b["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "vec_id": ids, "score": score})

    found = asked.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Comparisons of sketches, and directions of a row's projections, that cost as much as a shuffled row.
COMPARED, PROJECTED = 256, 128
#: The least and most bits of a cell's number.
LEAST_BITS, MOST_BITS = 14, 16
#: Signs of a row's sketch, by which most candidates are ruled out where they meet.
SKETCH = 256
#: Rows of one short key that make a group, and the most groups that have a leader.
GROUP, LEADERS = 8, 4096


def _above(t: float, cosine: float = 1.0) -> float:
    """The probability that the projections of a vector, or of two vectors of a cosine, on a normal direction are above t."""
    tail = lambda x: math.erfc(x / math.sqrt(2)) / 2
    if cosine >= 1:
        return tail(t)
    step, spread = 0.01, math.sqrt(2 * math.pi)
    points = (t + step * (i + 0.5) for i in range(800))
    return sum(step * math.exp(-x * x / 2) / spread * tail((t - cosine * x) / math.sqrt(1 - cosine * cosine)) for x in points)


def reach(cells: int, threshold: float, recall: float) -> float:
    """The projection from which a row is in the cell of a random direction, so that a pair at the threshold shares one of the cells with probability recall."""
    low, high = 0.0, 8.0
    for _ in range(40):
        t = (low + high) / 2
        low, high = (t, high) if -cells * math.log1p(-_above(t, threshold)) >= -math.log(1 - recall) else (low, t)
    return low


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, copies): a row is in about `copies` of 2**bits cells, which find a pair at the threshold with probability recall at the least cost.

    The cost is that of a row: its projections, a shuffled copy for each cell that it is in, and the comparisons with
    rows that share a cell by chance. No fewer than LEAST_BITS, so what is shuffled for a row stays the same up to about
    a million rows, and grows little after that.
    """
    copies = {b: math.ceil(2**b * _above(reach(2**b, threshold, recall))) for b in range(LEAST_BITS, MOST_BITS + 1)}
    bits = min(copies, key=lambda b: 2**b / PROJECTED + copies[b] * (1 + n * copies[b] / 2**b / COMPARED))
    return bits, copies[bits]


def similar_pairs(vectors: DataFrame, threshold: float, k: int, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(a, b, score): pairs of vectors (vec_id, v) of a cosine of at least threshold, at most k kept from either side.

    Dense groups have leaders, and whatever can be near a row of a group is compared with it in blocks of which only the
    best k of a row leave a task: _beside. Rows beside no leader meet in cells of random directions: a row is in those
    on which it projects far enough that a pair at the threshold shares one with probability `recall`. It carries a
    sketch of SKETCH signs; candidates whose sketches differ in more signs than a pair at the threshold does by 6.5
    standard deviations are ruled out where they meet, the others are scored exactly. Where that costs no less than
    comparing each row with all (a low threshold, a small table), every row is a query of top_k instead. Rows of one
    vector are one entry: each is tied to the smallest id among them, so a vector that many rows share makes no pairs.
    Vectors without a direction take no part.
    """
    vectors = usable(vectors, "v")
    marked = vectors.withColumn("__h", F.xxhash64("v"))
    sizes = marked.groupBy("__h").agg(F.count("*").alias("n"))
    n, doubled = sizes.agg(F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    # a vector is shuffled only if another has its hash
    shared = sizes.where("n > 1").select("__h")
    shared = F.broadcast(shared) if doubled <= WORD_BLOCK else shared
    many = marked.join(shared, "__h", "left_semi").select("vec_id", "v")
    copies = many.groupBy("v").agg(F.min("vec_id").alias("least"))
    base = vectors.select("vec_id", "v")
    if doubled:
        base = marked.join(shared, "__h", "left_anti").select("vec_id", "v").unionByName(copies.select(F.col("least").alias("vec_id"), "v"))
    bits, cells = plan_tables(n, threshold, recall)
    if cells * (1 + n * cells / 2**bits) * 4 >= n:  # a candidate costs several times what a cell of a matrix product does
        found = top_k(base.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), base, k + 1, least=threshold)
        found = found.where("query_id <> vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score")
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
    else:
        leaders = _leaders(base, threshold, n, seed)
        found = _met(base, leaders, threshold, bits, reach(2**bits, threshold, recall), seed)
        if len(leaders):
            found = found.unionByName(_beside(base, leaders, threshold, k)).groupBy("a", "b").agg(F.max("score").alias("score"))
    found = strongest(found, k)
    if not doubled:
        return found
    same = many.join(copies, "v").where("vec_id <> least").select(F.col("least").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("score"))
    return found.unionByName(same)


def _marks(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 1]).standard_normal((width, SKETCH))


def _leaders(base: DataFrame, threshold: float, n: int, seed: int) -> np.ndarray:
    """Unit vectors that lead the dense groups of base, at most LEADERS, no two of them as near as the threshold.

    Rows that share a short key of signs, of GROUP at least, have the least of them as a leader; rows that are near
    nothing hardly ever share such keys. Nothing is lost where a group has no leader, it only costs more.
    """
    if 2 * threshold * threshold - 1 < 0.5:  # beside a leader there would be much else
        return np.zeros((0, 0))
    short = (1 << min(62, max(LEAST_BITS, math.ceil(math.log2(n)) + 4))) - 1

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                told = np.packbits(x @ _marks(x.shape[1], seed) > 0, axis=1).view(np.int64)[:, :2] & short
                yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), 2), "view": np.tile([0, 1], len(pdf)), "key": told.ravel()})

    groups = base.mapInPandas(keys, "vec_id long, view int, key long").groupBy("view", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    size = {r.vec_id: r.n for r in groups.where(F.col("n") >= GROUP).orderBy(F.desc("n"), "vec_id").limit(LEADERS).collect()}
    if not size:
        return np.zeros((0, 0))
    told = base.sparkSession.createDataFrame([(i,) for i in size], "vec_id long")
    rows = {r.vec_id: r.v for r in base.join(F.broadcast(told), "vec_id").collect()}
    points = _unit(rows[i] for i in sorted(rows, key=lambda i: (-size[i], i)))
    near, kept = points @ points.T >= threshold, []
    for i in range(len(points)):
        if not near[i, kept].any():
            kept.append(i)
    return points[kept]


def _beside(base: DataFrame, leaders: np.ndarray, threshold: float, k: int) -> DataFrame:
    """(a, b, score): the best k of at least threshold of each row of base beside a leader, of pairs of which a row is at home there.

    A row is at home with its nearest leader, if it is as near to it as the threshold. Whatever is near such a row is
    within twice that angle of the leader, so it comes there, too, and no pair is lost. Rows of a leader are dealt out in
    blocks, and a task compares one block of those that come with one of those at home.
    """
    wide = 2 * threshold * threshold - 1 - 1e-6

    def come(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, CELLS // len(leaders))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                near = _unit(part["v"]) @ leaders.T
                rows, to = np.nonzero(near >= wide)
                if len(rows):
                    home = (near.argmax(axis=1)[rows] == to) & (near[rows, to] >= threshold)
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[rows], "v": part["v"].to_numpy()[rows], "at": to.astype(np.int32), "home": home})

    here = base.mapInPandas(come, "vec_id long, v array<double>, at int, home boolean")
    here = here.join(F.broadcast(here.groupBy("at").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n"))), "at")
    own, every = F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = here.withColumn("i", own).withColumn("j", every).select("vec_id", "v", "at", "i", "j")
    right = here.where("home").withColumn("j", own).withColumn("i", every).select("vec_id", "v", "at", "i", "j").toDF(*left.columns)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            for q, x in ((a, b), (b, a)):
                mine = q["vec_id"].to_numpy()
                rows, ids, score = _best(_unit(q["v"]), _unit(x["v"]), x["vec_id"].to_numpy(), k + 1, threshold)
                other = mine[rows] != ids
                out[0].append(np.sort(np.stack([mine[rows], ids], axis=1)[other], axis=1))
                out[1].append(score[other])
        pairs = np.concatenate(out[0])
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "score": np.concatenate(out[1])})

    return left.groupBy("at", "i", "j").cogroup(right.groupBy("at", "i", "j")).applyInPandas(best, "a long, b long, score double")


def _met(base: DataFrame, leaders: np.ndarray, threshold: float, bits: int, least: float, seed: int) -> DataFrame:
    """(a, b, score): pairs of at least threshold of rows of base at home with no leader, that meet in a cell: similar_pairs."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions = marks = None
        for pdf in batches:
            x = _unit(pdf["v"]) if len(pdf) else np.zeros((0, 1))
            if len(leaders) and len(x):
                free = np.concatenate([(x[at : at + 256] @ leaders.T).max(axis=1) for at in range(0, len(x), 256)]) < threshold + 1e-6
                pdf, x = pdf[free], x[free]
            if not len(x):
                continue
            if directions is None:
                directions = np.random.default_rng([seed, 0]).standard_normal((x.shape[1], 1 << bits), dtype=np.float32)
                marks = _marks(x.shape[1], seed)
            told = np.packbits(x @ marks > 0, axis=1).view(np.int64)
            step = max(1, CELLS >> bits)
            keys = []
            for at in range(0, len(x), step):
                rows, cells = np.nonzero(x[at : at + step].astype(np.float32) @ directions >= least)
                keys += np.split(cells, np.searchsorted(rows, np.arange(1, min(step, len(x) - at))))
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "keys": keys, "s": list(told)})

    off = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    most = math.ceil(SKETCH * off + 6.5 * math.sqrt(SKETCH * off * (1 - off)))
    words = range(SKETCH // 64)
    keyed = base.mapInPandas(sign, "vec_id long, keys array<int>, s array<long>")
    rows = keyed.select(F.explode("keys").alias("key"), F.col("vec_id").alias("a"), *[F.col("s")[i].alias(f"s{i}") for i in words])
    x, y = rows.alias("x"), rows.alias("y")
    differ = F.expr(" + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in words))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.a") < F.col("y.a")) & (differ <= most))
    pairs = met.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()
    scored = pairs.join(base.withColumnsRenamed({"vec_id": "a", "v": "va"}), "a").join(base.withColumnsRenamed({"vec_id": "b", "v": "vb"}), "b")
    return scored.select("a", "b", cosine("va", "vb").alias("score")).where(F.col("score") >= threshold)


def strongest(pairs: DataFrame, k: int) -> DataFrame:
    """Of unordered pairs (a, b, score) those among the k best of one of their ends; score rounded to 4 digits."""
    both = pairs.select(F.col("a").alias("me"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("me"), F.col("a").alias("other"), "score"))
    order = Window.partitionBy("me").orderBy(F.round("score", 9).desc(), "other")
    kept = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return kept.groupBy(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).agg(F.round(F.max("score"), 4).alias("score"))


def weighted(vector: Column, citation: Column, kind: Column, chapter: Column) -> Column:
    return 0.5 * vector + 0.2 * citation + 0.2 * kind + 0.1 * chapter


#: Words of queries up to which they go to every task, and documents that one task scores.
WORD_BLOCK, DOC_BLOCK = 200_000, 2048


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): docs (doc_id, words array), queries (query_id, words array).

    Documents are dealt out by id in parts of about DOC_BLOCK, and up to WORD_BLOCK words of queries go to every part,
    so a document's words are counted and its scores summed where it is: no word or query brings its rows to one task.
    More words than that are joined by a shuffle.
    """
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("w"))
    few = asked.limit(WORD_BLOCK + 1).count() <= WORD_BLOCK
    told = F.broadcast if few else (lambda t: t)
    dealt = docs.select("doc_id", "words").repartition(max(1, math.ceil(size.n / DOC_BLOCK)), "doc_id")
    words = dealt.select("doc_id", F.size("words").alias("len"), F.explode("words").alias("w"))
    tf = words.join(told(asked.select("w").distinct()), "w").groupBy("doc_id", "len", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (size.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / size.mean))
    return tf.join(told(asked.join(df, "w")), "w").withColumn("part", part).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def fuse(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score) by reciprocal rank from two rankings (query_id, doc_id, rank)."""
    each = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = left.withColumnRenamed("rank", "l").join(right.withColumnRenamed("rank", "r"), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", (each("l") + each("r")).alias("score"))


#: Marks that one automaton holds, and their characters together.
MARK_BLOCK, MARK_CHARS = 50_000, 2_000_000


def containing(texts: DataFrame, key: str, body: str, marks: DataFrame, mark_id: str, mark: str, every: bool = False) -> DataFrame:
    """(mark_id, key, body, mark): texts that contain a mark as a substring; with `every`, each text once more without a mark.

    Marks that fit in one automaton are looked for in one pass over the texts, without a shuffle. Of more marks, one's
    longest inner word (whole in any text that contains the mark) is an equality key, so texts meet only the marks that
    share it; those of fewer than three words have no inner word and are looked for by automata of at most MARK_BLOCK
    marks. An empty mark is in every text.
    """
    known = marks.where(F.col(mark).isNotNull()).select(mark_id, mark)
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(mark)), F.lit(0)).alias("chars")).first()
    if size.n <= MARK_BLOCK and size.chars <= MARK_CHARS:
        return _seen(texts.select(key, body), body, known, mark_id, mark, every)
    words = F.split(F.col(mark), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = known.select(mark_id, mark, longest.alias("__w"))
    met = texts.select(key, F.explode(F.array_distinct(F.split(body, r"\s+"))).alias("__w")).join(keyed.where("__w is not null"), "__w")
    pairs = met.select(key, mark_id, mark)
    found = texts.select(key, body).join(pairs, key).where(F.contains(body, mark)).select(mark_id, key, body, mark)
    short = keyed.where("__w is null").select(mark_id, mark)
    blocks = math.ceil(short.count() / MARK_BLOCK)
    for i in range(blocks):
        found = found.unionByName(_seen(texts.select(key, body), body, short.where(F.pmod(F.xxhash64(mark), F.lit(blocks)) == i), mark_id, mark))
    plain = {t: F.lit(None).cast(marks.schema[t].dataType).alias(t) for t in (mark_id, mark)}
    return found.unionByName(texts.select(plain[mark_id], key, body, plain[mark])) if every else found


def _seen(texts: DataFrame, body: str, held: DataFrame, mark_id: str, mark: str, every: bool = False) -> DataFrame:
    """containing, of so few marks as one automaton holds."""
    told = [r[0] for r in held.select(mark).distinct().collect()]
    names = _finder([None] * every + told)(body)
    return texts.select("*", F.explode(names).alias(mark)).join(F.broadcast(held), mark, "left").select(mark_id, *texts.columns, mark)


def _finder(told: list[str | None]):
    """A function of a text: the marks in it, each once, and a null if it is among the marks."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for m in told:
            if m:
                automaton.add_word(m, m)
        automaton.make_automaton()
        always, empty = [None] * (None in told), [""] * ("" in told)
        seen = (lambda t: sorted({m for _, m in automaton.iter(t)})) if len(automaton) else (lambda t: [])
        for texts in batches:
            yield pd.Series([always if t is None else always + empty + seen(t) for t in texts], dtype=object)

    return found.asNondeterministic()  # explode's own filter does not search the texts once more
