"""Toxicity by maximum-scoring segments of token log-odds.

Training: on labelled rows, the presence of words and word beginnings in toxic and other texts gives log-odds with an
informative Dirichlet prior, taken relative to what common words show (long texts hold more of everything). Features
far above chance make the lexicon of toxic words; words far below it keep their own negative log-odds; all other words
share one class, whose log-odds compare its share of the tokens inside toxic passages with its share in other texts.

Scoring: every token of a text carries its log-odds; one linear scan finds every maximal scoring segment. By the
extreme-value law of such segments a null text of n tokens holds K n exp(-decay x) segments of score x by chance; decay
is the positive root of the null's moment generating function, K is fitted on other texts. Segments that chance hardly
explains are passages. A text's evidence is the negative log of the chance of its best segments together, which a
logistic curve fitted on the training rows turns into a score from 0 to 1.

The model is fitted on at most MOST_TRAINED labelled rows, chosen by a hash of their id, which bounds the lexicon that
goes to the workers: it holds words that at least LEAST_ROWS of these rows share. Every row is scored over its whole
text. Training and scoring cut texts into words by one function, tokens().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

MOST_TRAINED = 20_000
#: Rows of its kind that a feature must occur in, and how far from chance it must lie, in standard errors.
LEAST_ROWS = 3
LEAST_Z = 3.0
#: Log-odds from which on a feature belongs to the lexicon of toxic words.
LEAST_SCORE = 2.0
PRIOR = 50.0
#: Null segments that must reach the score at which K is fitted.
LEAST_TAIL = 20
#: Share of rows from which on a word is common, so that its log-odds tell how much longer toxic texts are.
COMMON = 0.05
BEGINNINGS = (3, 4, 5)
#: Log-odds of the class of ordinary words before it is fitted, and the range that fitting may give.
DRIFT = -0.2
DRIFTS = (-1.0, -0.05)
SIGNIFICANT = 1e-2
THRESHOLD = 0.3
#: Words that a worker remembers the scores of.
MOST_KNOWN = 500_000
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a text; combining marks belong to their word."""
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Scores by feature (=word or ^beginning), those of all other words, the null's law, and the curve to a score.

    ordinary: features of words that share a beginning with toxic ones and are known to be of the ordinary class.
    """

    scores: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    drift: float = DRIFT
    decay: float = 1.0
    k: float = 1.0
    bias: float = -10.0
    slope: float = 0.0

    def token(self, word: str) -> float:
        """The word's own log-odds; the best of its beginnings where it is too rare to have any of its own."""
        own = "=" + word
        if own in self.scores:
            return self.scores[own]
        if own in self.ordinary:
            return self.drift
        return max(self.scores.get("^" + word[:k], self.drift) if len(word) >= k else self.drift for k in BEGINNINGS)

    def known(self) -> Known:
        return Known(self)

    def passages(self, words: list[str], known: Known) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first token, end token, score), in one pass over the tokens."""
        values = list(map(known.__getitem__, words))
        if not values or max(values) <= 0:
            return []
        cuts: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last cut of a lower sum before
        total = 0.0
        for i, s in enumerate(values):
            if s <= 0:
                total += s
                continue
            start, before = i, total
            total += s
            back = len(cuts) - 1
            while True:
                while back >= 0 and cuts[back][2] >= before:
                    back = cuts[back][4]
                if back < 0 or cuts[back][3] >= total:
                    cuts.append((start, i + 1, before, total, back))
                    break
                start, _, before, _, after = cuts[back]
                del cuts[back:]
                back = after
        return [(a, b, high - low) for a, b, low, high, _ in cuts]

    def log_chance(self, score: float, n: int) -> float:
        """Natural log of the expected number of segments of at least this score in a null text of n tokens."""
        return math.log(self.k * max(n, 1)) - self.decay * score

    def evidence(self, scores: list[float], n: int) -> float:
        """Negative log of the chance of a text's best segments, given their scores, at least 0.

        By the Poisson law of high-scoring segments, r of them reach the r-th best score with a chance near E**r / r!,
        where E is the expected number of that score; the r that is least likely counts.
        """
        best, log_factorial = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            log_factorial += math.log(r)
            log_e = self.log_chance(score, n)
            if log_e >= 0:
                break
            best = max(best, log_factorial - r * log_e)
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * evidence))))


class Known(dict):
    """Scores of the words met so far."""

    def __init__(self, model: Model):
        super().__init__()
        self._score = model.token

    def __missing__(self, word: str) -> float:
        if len(self) >= MOST_KNOWN:
            self.clear()
        found = self[word] = self._score(word)
        return found


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def features(text: str | None) -> set[str]:
    """The words of a text and their beginnings, each once."""
    words = set(tokens(text))
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in BEGINNINGS if len(w) >= k}


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, c1, c0): toxic and other rows (toxic, text) that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(), Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[toxic == 1].update(features(text.as_py()))
            names = list(held[0] | held[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h[n] for n in names], pa.int64()) for h in (held[1], held[0]))], ["feature", "c1", "c0"])

    return rows.select("toxic", "text").mapInArrow(run, "feature string, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_TRAINED) -> DataFrame:
    """(toxic, text) of the labelled rows that are not held out, those of the `most` smallest hashes of their id."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the rows with the smallest hashes: a bounded sample that does not depend on how the table is stored
    chosen = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), body.alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_TRAINED) -> Model:
    """A model from the labelled rows that are not held out; without both labels among them, one that finds nothing.

    Null texts count as empty, null keys and labels are left out, of several labels the greatest counts, repeated rows
    of docs each count.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(labelled(docs, labels, key, text, most))
    size = rows.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = size.n1 or 0, size.n - (size.n1 or 0)
    if not n1 or not n0:
        return Model()
    # log-odds of presence with a Dirichlet prior centred on the feature's rate in all rows
    a = PRIOR * (F.col("c1") + F.col("c0")) / (n1 + n0)
    odds = lambda c, n: F.log(c + a) - F.log(n + PRIOR - c - a)
    delta = odds(F.col("c1"), n1) - odds(F.col("c0"), n0)
    error = F.sqrt(1 / (F.col("c1") + a) + 1 / (F.col("c0") + a))
    told = scratch.keep(_counted(rows).select("feature", "c1", "c0", delta.alias("delta"), error.alias("error")))
    common = told.where((F.col("c1") + F.col("c0") >= COMMON * (n1 + n0)) & F.startswith("feature", F.lit("=")))
    weight = 1 / (F.col("error") * F.col("error"))
    shift = common.agg(F.sum(weight * F.col("delta")) / F.sum(weight)).first()[0] or 0.0
    odd = told.withColumn("delta", F.col("delta") - shift).withColumn("z", F.col("delta") / F.col("error"))
    toxic = (F.col("c1") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_SCORE)
    civil = (F.col("c0") >= LEAST_ROWS) & (F.col("z") <= -LEAST_Z) & F.startswith("feature", F.lit("="))
    lexicon = odd.where(toxic | civil).orderBy("feature").collect()
    model = Model({r.feature: r.delta for r in lexicon})
    if not any(r.delta > 0 for r in lexicon):
        return Model()
    starts = [r.feature for r in lexicon if r.feature[0] == "^"]
    shared = [F.concat(F.lit("^"), F.substring("feature", 2, k)).isin([x for x in starts if len(x) == k + 1]) for k in BEGINNINGS]
    known = odd.where(F.startswith("feature", F.lit("=")) & (F.col("c0") >= LEAST_ROWS) & (F.col("delta") < LEAST_SCORE) & reduce(Column.__or__, shared))
    model.ordinary = frozenset(r.feature for r in known.select("feature").collect() if r.feature not in model.scores)
    # once with the class at its first guess, to find passages, then with what these hold
    inside, null = (_tally(rows.where(w), model, i) for w, i in (("toxic = 1", True), ("toxic <> 1", False)))
    share = (inside["ordinary"] + 0.5) / (sum(inside.values()) + 1), (null["ordinary"] + 0.5) / (sum(null.values()) + 1)
    model.drift = max(DRIFTS[0], min(DRIFTS[1], math.log(share[0] / share[1])))
    # how often the null brings each score: what was seen, and one more hit shared by all toxic features
    n = sum(null.values()) + 2
    civil = [(r.delta, null[r.feature] / n) for r in lexicon if r.delta < 0]
    hits = [(r.delta, (null[r.feature] + 1 / len(lexicon)) / n) for r in lexicon if r.delta > 0]
    model.decay = _decay(hits + civil, model.drift)
    found = scratch.keep(_segments(rows, model))
    model.k = _constant(found.where("toxic <> 1"), model)
    bins = _evidence(found, model).groupBy(F.col("toxic").alias("label"), F.round(F.least("evidence", F.lit(60.0)) * 4).alias("bin")).count().collect()
    model.bias, model.slope = _curve([(r.bin / 4, 1.0 if r.label == 1 else 0.0, r["count"]) for r in bins])
    return model


def _tally(rows: DataFrame, model: Model, inside: bool) -> Counter:
    """Tokens by the feature that gives their score, `ordinary` for the class of the others; of passages only if inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0):
                words = tokens(text.as_py())
                if inside:
                    words = [w for a, b, _ in model.passages(words, known) for w in words[a:b]]
                held.update(words)
            by: Counter = Counter()
            for w, n in held.items():
                names = ["=" + w, *("^" + w[:k] for k in BEGINNINGS if len(w) >= k)]
                by[next((f for f in names if f in model.scores and model.scores[f] == known[w]), "ordinary")] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), pa.int64())], ["feature", "n"])

    told = rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return Counter({r.feature: r.n for r in told.collect()})


def _segments(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, tokens, scores): the scores of the segments of each row (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            words = [tokens(t.as_py()) for t in batch.column(1)]
            scores = [[s for _, _, s in model.passages(w, known)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "tokens", "scores"])

    kind = rows.schema["toxic"].dataType.simpleString()
    return rows.select("toxic", "text").mapInArrow(run, f"toxic {kind}, tokens long, scores array<double>")


def _evidence(found: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.evidence(s, n) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["toxic", "evidence"])

    return found.mapInArrow(run, f"toxic {found.schema['toxic'].dataType.simpleString()}, evidence double")


def _constant(null: DataFrame, model: Model) -> float:
    """K of the extreme-value law: null segments (tokens, scores) of a high score as a share of what the law expects.

    The level is the highest that LEAST_TAIL null segments reach, as the law is about the tail, or else the least toxic
    score; half a segment more on both sides, so that a null without any is no certainty.
    """
    least = min(s for s in model.scores.values() if s > 0)
    levels = null.select(F.explode("scores").alias("s")).groupBy(F.greatest(F.floor(F.col("s") * 2) / 2, F.lit(least)).alias("s")).count().orderBy(F.desc("s")).collect()
    seen, level = 0, least
    for row in levels:
        seen, level = seen + row["count"], row.s
        if seen >= LEAST_TAIL:
            break
    n = null.agg(F.sum("tokens")).first()[0] or 0
    return (seen + 0.5) / (n * math.exp(-model.decay * level) + 0.5)


def _decay(null: list[tuple[float, float]], drift: float) -> float:
    """The positive root of the null's moment generating function.

    null: (score, rate per token) of the features; all other tokens score drift.
    """
    rest = 1 - min(0.9, sum(rate for _, rate in null))
    mean = lambda x: sum(rate * math.exp(x * s) for s, rate in null) + rest * math.exp(x * drift) - 1
    low, high = 1e-6, 10.0
    if mean(low * 10) >= 0:
        return 1e-3  # the null gains on average: segments carry hardly any evidence
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def _curve(points: list[tuple[float, float, int]]) -> tuple[float, float]:
    """Logistic curve through (evidence, label, rows), with smoothed targets so that separable rows stay finite."""
    good = sum(n for _, y, n in points if y)
    rest = sum(n for _, y, n in points if not y)
    target = {1.0: (good + 1) / (good + 2), 0.0: 1 / (rest + 2)}
    a, b = math.log((good + 1) / (rest + 1)), 0.0
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x))))
            w = n * max(p * (1 - p), 1e-9)
            g0 += n * (target[y] - p)
            g1 += n * (target[y] - p) * x
            h00 += w
            h01 += w * x
            h11 += w * x * x
        h00, h11 = h00 + 1e-6, h11 + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 0.0)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, score, passages) of every row; null and empty texts have no passages and the lowest score.

    Passages are (first token, end token, score) of the segments that chance explains with less than SIGNIFICANT.
    Null keys and repeated rows stay; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, limit = model.known(), math.log(SIGNIFICANT)
        for batch in batches:
            out = []
            for cell in batch.column(1):
                words = tokens(cell.as_py())
                found, n = model.passages(words, known), len(words)
                kept = [{"first": a, "end": b, "score": s} for a, b, s in found if model.log_chance(s, n) <= limit]
                out.append((n, model.score(model.evidence([s for _, _, s in found], n)), kept))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "tokens", "score", "passages"])

    kinds = [pa.int64(), pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))]
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, tokens long, score double, passages array<struct<first:int,end:int,score:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; learnt from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages"
    )


def keep_civil(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns stay as they are.

    Rows with null and empty texts have the lowest score and stay, and so do null keys and repeated rows of civil
    texts; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            keep = []
            for cell in batch.column(batch.schema.get_field_index(text)):
                words = tokens(cell.as_py())
                evidence = model.evidence([s for _, _, s in model.passages(words, known)], len(words))
                keep.append(model.score(evidence) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
