"""Quality classifier: interpolated modified Kneser-Ney models of character trigrams, trained on trusted text.

Every language has two models, each trained on one half of its trusted documents (labelled good), dealt out by a hash of
the text; a document of either half is scored by the model of the other one. So no document is scored by a model that
saw it or an exact copy of it, and thresholds come from trusted documents outside the training half.

Texts are read once, in slices of documents of one language and half. A slice keeps, packed, its distinct trigrams with
the documents that hold them and how often, so a trigram that every text holds is one entry per slice. Trusted documents
add their counts to the training table; continuation counts, context sums and discounts come from joins and aggregates
sharded by model and trigram, context or suffix; every trigram of the corpus gets its log-probability from those joins,
a further sharded join returns it to the slices, and sums by document give perplexities. The tables of trigrams grow
with the corpus and are never broadcast by request or collected.

A document is rejected when its perplexity lies above the quantile of the trusted documents of its language, by more
than its length lets chance explain, going by how much characters vary in trusted text. The other tail needs a measure
of its own, since repeated words are made of common characters: a document is also rejected when the entropy of its own
trigrams lies below the low quantile of trusted documents of its language and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Documents and code points of a slice at most; a longer text is a slice of its own.
SLICE_DOCS = 2048
SLICE_CHARS = 4_000_000
QUANTILE = 0.995
LOW_QUANTILE = 0.01
#: Standard errors of its mean that a text must lie above the quantile, or below the low one.
MARGIN = 3.0
LOW_MARGIN = 3.0
#: Trusted documents that a language needs for a quantile of its own; with fewer it has its own mean, and above that the
#: quantile of all languages' distances from their means.
LEAST_TRUSTED = 30
_BITS = 21
_LOW = (1 << _BITS) - 1
_PAD = 1  # stands before the first character; U+0001 in a text counts as the same


def trigrams(text: str) -> np.ndarray:
    """Trigrams of a text's code points, two pads before the first, each packed into one number."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    c = np.concatenate([[_PAD, _PAD], c])
    return (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]


def _postings(grams: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct trigrams of a slice, how many entries each has, and the entries: steps between documents, and counts.

    Last, by document, the entropy of its own trigrams and the standard error of it.
    """
    sizes = [len(g) for g in grams]
    distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
    pair, count = np.unique(at * np.int64(len(grams)) + np.repeat(np.arange(len(grams)), sizes), return_counts=True)
    at, log = pair % len(grams), np.log(count)
    n = np.maximum(sizes, 1)
    mean, square = (np.bincount(at, count * x, len(grams)) / n for x in (log, log * log))
    own, spread = np.log(n) - mean, np.sqrt(np.maximum(square - mean * mean, 0) / n)
    full = count > 65535
    while full.any():  # a count too large for 16 bits is several entries
        pair, count = np.concatenate([pair, pair[full]]), np.concatenate([np.where(full, 65535, count), count[full] - 65535])
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        full = count > 65535
    gram, doc = pair // len(grams), pair % len(grams)
    starts = np.searchsorted(gram, np.arange(len(distinct) + 1))
    step = np.diff(doc, prepend=0)
    step[starts[:-1]] = doc[starts[:-1]]
    return distinct, np.diff(starts), step, count, own, spread


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(kind)).tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).astype(np.int64)


def sliced(docs: DataFrame, key: str, text: str, lang: str, mark: Column) -> DataFrame:
    """One row per slice: its model, its distinct trigrams, their entries by document, packed, and its documents' keys.

    model: 0 or 1 for the half, then the language; a slice's documents are scored by the model of that name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[tuple]] = {}
        grams: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(model: str) -> pa.RecordBatch:
            nonlocal number
            rows, each = held.pop(model), grams.pop(model)
            size.pop(model)
            none, zeros = np.zeros(0, np.int64), np.zeros(len(each))
            found = _postings(each) if any(len(g) for g in each) else (none, none, none, none, zeros, zeros)
            blobs = [_pack(np.diff(found[0], prepend=0), "<i8"), _pack(found[1], "<u4"), _pack(found[2], "<u2"), _pack(found[3], "<u2")]
            owns = zip(rows, each, found[4].tolist(), found[5].tolist())
            keys = [{"lang": x, "mark": m, "n": len(g), "own": own, "own_spread": spread} for (_, x, m), g, own, spread in owns]
            cells = pa.array(keys, pa.struct(kinds))
            ids = pa.concat_arrays([r[0] for r in rows])
            cells = pa.StructArray.from_arrays([ids, *cells.flatten()], ["doc_id", *(n for n, _ in kinds)])
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), cells)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([task | number], pa.int64()), pa.array([model]), *(pa.array([b], pa.binary()) for b in blobs), lists], names)

        for batch in batches:
            for i, (t, x, m, model) in enumerate(zip(batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                body = t.as_py() or ""
                if model in held and (len(held[model]) >= SLICE_DOCS or size[model] + len(body) > SLICE_CHARS):
                    yield flush(model)
                held.setdefault(model, []).append((batch.column(0).slice(i, 1), x, m))
                grams.setdefault(model, []).append(trigrams(body))
                size[model] = size.get(model, 0) + len(body)
                if sum(size.values()) > 2 * SLICE_CHARS or len(held) > SLICE_DOCS:  # many languages at once
                    yield flush(max(size, key=size.get))
        for model in list(held):
            yield flush(model)

    names = ["slice", "model", "grams", "entries", "steps", "counts", "keys"]
    kinds = [("lang", pa.string()), ("mark", pa.string()), ("n", pa.int64()), ("own", pa.float64()), ("own_spread", pa.float64())]
    body = F.col(text).cast("string")
    half = F.pmod(F.xxhash64(F.coalesce(body, F.lit(""))), F.lit(2)).cast("string")
    model = F.concat(half, F.coalesce(F.col(lang).cast("string"), F.lit("")))
    narrow = docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.col(lang).cast("string").alias("lang"), mark.cast("string").alias("mark"), model.alias("model"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"slice long, model string, grams binary, entries binary, steps binary, counts binary, keys array<struct<doc_id:{kind},lang:string,mark:string,n:long,own:double,own_spread:double>>"
    )


def _other_half(model: Column) -> Column:
    return F.concat(F.when(F.left(model, F.lit(1)) == "0", "1").otherwise("0"), F.substring(model, F.lit(2), F.length(model)))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, model, ix, gram) of slices (slice, model, grams)."""
    for batch in batches:
        for number, model, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            grams = np.cumsum(_unpack(blob.as_py(), "<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), number)), pa.array([model] * len(grams), pa.string()), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(grams)], ["slice", "model", "ix", "gram"]
            )


def _entries(entries: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Document of every entry: steps add up within a trigram."""
    total, ends = np.cumsum(steps), np.cumsum(entries)
    return total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), entries)


def _trusted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, gram, n) in the trusted documents of slices (model, grams, entries, steps, counts, who)."""
    for batch in batches:
        for row in batch.to_pylist():
            grams, entries, steps, counts = (_unpack(row[c], k) for c, k in (("grams", "<i8"), ("entries", "<u4"), ("steps", "<u2"), ("counts", "<u2")))
            if len(grams):
                mask = np.zeros(65536, np.int64)
                mask[row["who"]] = 1
                n = np.add.reduceat(counts * mask[_entries(entries, steps)], np.concatenate([[0], np.cumsum(entries)[:-1]]))
                found = n > 0
                yield pa.RecordBatch.from_arrays([pa.array([row["model"]] * int(found.sum()), pa.string()), pa.array(np.cumsum(grams)[found]), pa.array(n[found])], ["model", "gram", "n"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, pos, logsum, squares) of slices (slice, entries, steps, counts, logp array in the order of trigrams)."""
    for batch in batches:
        for row in batch.to_pylist():
            entries, steps, counts = (_unpack(row[c], k) for c, k in (("entries", "<u4"), ("steps", "<u2"), ("counts", "<u2")))
            doc, logp = _entries(entries, steps), np.repeat(np.array(row["logp"]), entries)
            size = int(doc.max()) + 1
            sums, squares = np.bincount(doc, counts * logp, size), np.bincount(doc, counts * logp * logp, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, row["slice"])), pa.array(np.arange(size, dtype=np.int32)), pa.array(sums), pa.array(squares)], ["slice", "pos", "logsum", "squares"]
            )


class KneserNey:
    """Sharded tables of interpolated modified Kneser-Ney trigram models over counts (model, gram, n)."""

    def __init__(self, counts: DataFrame):
        low = F.lit(_LOW)
        self.tri = counts
        self.bi = counts.groupBy("model", F.col("gram").bitwiseAND(F.lit((1 << 2 * _BITS) - 1)).alias("suffix")).agg(F.count("*").alias("n"))
        self.uni = self.bi.groupBy("model", F.col("suffix").bitwiseAND(low).alias("last")).agg(F.count("*").alias("n"))
        self.ctx3 = self._contexts(counts, F.shiftright("gram", _BITS), "ctx3")
        self.ctx2 = self._contexts(self.bi, F.shiftright("suffix", _BITS), "ctx2")
        self.laws = self._discounts(self.tri, "d3").join(self._discounts(self.bi, "d2"), "model").join(self._discounts(self.uni, "d1"), "model")
        total = self.uni.groupBy("model").agg(F.sum("n").alias("total"), *[k.alias(f"k{i}") for i, k in enumerate(self._kinds(), 1)])
        gamma1 = sum((F.col("d1")[i] * F.col(f"k{i + 1}") for i in range(3)), F.lit(0.0)) / F.col("total")
        self.laws = self.laws.join(total, "model").select("model", "d3", "d2", "d1", "total", (F.col("k1") + F.col("k2") + F.col("k3")).alias("types"), gamma1.alias("gamma1"))

    @staticmethod
    def _kinds() -> list[Column]:
        n = F.col("n")
        return [F.sum((n == 1).cast("long")), F.sum((n == 2).cast("long")), F.sum((n >= 3).cast("long"))]

    def _contexts(self, counts: DataFrame, context: Column, name: str) -> DataFrame:
        kinds = [k.alias(f"{name}_{i}") for i, k in enumerate(self._kinds(), 1)]
        return counts.groupBy("model", context.alias(name)).agg(F.sum("n").alias(f"{name}_n"), *kinds)

    @staticmethod
    def _discounts(counts: DataFrame, name: str) -> DataFrame:
        """(model, array of the discounts of counts 1, 2 and more), fixed ones where a count does not occur."""
        told = counts.groupBy("model").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)])
        n1, n2, n3, n4 = (F.col(f"n{i}") for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        bounded = F.array(*[F.least(F.greatest(d, F.lit(0.05)), F.lit(float(i))) for i, d in enumerate(found, 1)])
        return told.select("model", F.when((n1 > 0) & (n2 > 0) & (n3 > 0), bounded).otherwise(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias(name))

    @staticmethod
    def _left(n: Column, d: Column) -> Column:
        return n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """(model, gram, logp) for every one of grams (model, gram) whose model has counts; seen in training or not."""
        g = F.col("gram")
        asked = grams.select(
            "model", g, F.shiftright(g, _BITS).alias("ctx3"), g.bitwiseAND(F.lit((1 << 2 * _BITS) - 1)).alias("suffix"), g.bitwiseAND(F.lit(_LOW)).alias("last")
        ).withColumn("ctx2", F.shiftright("suffix", _BITS))
        joined = (
            asked.join(self.tri.select("model", "gram", F.col("n").alias("n3")), ["model", "gram"], "left")
            .join(self.ctx3, ["model", "ctx3"], "left")
            .join(self.bi.select("model", "suffix", F.col("n").alias("n2")), ["model", "suffix"], "left")
            .join(self.ctx2, ["model", "ctx2"], "left")
            .join(self.uni.select("model", "last", F.col("n").alias("n1")), ["model", "last"], "left")
            .join(self.laws, "model")
        )

        def level(n: str, d: Column, context: str, below: Column) -> Column:
            gamma = sum((d[i] * F.col(f"{context}_{i + 1}") for i in range(3)), F.lit(0.0)) / F.col(f"{context}_n")
            seen = F.coalesce(self._left(F.col(n), d), F.lit(0.0)) / F.col(f"{context}_n")
            return F.when(F.col(f"{context}_n").isNull(), below).otherwise(seen + gamma * below)

        p1 = F.coalesce(self._left(F.col("n1"), F.col("d1")), F.lit(0.0)) / F.col("total") + F.col("gamma1") / (F.col("types") + 1)
        p2 = level("n2", F.col("d2"), "ctx2", p1)
        return joined.select("model", "gram", F.log(level("n3", F.col("d3"), "ctx3", p2)).alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", mark: Column | None = None) -> DataFrame:
    """(doc_id, lang, mark, n, own, own_spread, log_ppl, spread, trusted) of every row of docs.

    n: trigrams; own: entropy of the document's own trigrams; log_ppl: mean negative log-probability, null for null and
    empty texts and where the other half of the language has nothing trusted; the spreads: their standard errors. Null
    keys, null languages (a language of their own) and repeated rows stay; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    parts = scratch.keep_bucketed(sliced(docs, key, text, lang, F.lit(None) if mark is None else mark), "slice")
    names = parts.select("slice", F.posexplode("keys").alias("pos", "k")).select("slice", "pos", "k.*")
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    names = scratch.keep(names.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))).select("slice", "pos", "doc_id", "lang", "mark", "n", "own", "own_spread", "trusted"))
    trusted = names.where("trusted and n > 0").groupBy("slice").agg(F.sort_array(F.collect_list("pos")).alias("who"))
    training = parts.select("slice", _other_half(F.col("model")).alias("model"), "grams", "entries", "steps", "counts").join(trusted, "slice").drop("slice")
    training = scratch.keep(training.mapInArrow(_trusted_counts, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n")))
    if training.isEmpty():
        return names.select("doc_id", "lang", "mark", "n", "own", "own_spread", F.lit(None).cast("double").alias("log_ppl"), F.lit(None).cast("double").alias("spread"), "trusted")
    grams = parts.select("slice", "model", "grams").mapInArrow(_grams_of, "slice long, model string, ix int, gram long")
    table = scratch.keep(KneserNey(training).log_probabilities(grams.select("model", "gram").distinct()))
    back = F.transform(F.sort_array(F.collect_list(F.struct("ix", "logp"))), lambda x: x["logp"])
    told = grams.join(table, ["model", "gram"]).groupBy("slice").agg(back.alias("logp"))
    sums = parts.select("slice", "entries", "steps", "counts").join(told, "slice").mapInArrow(_sums, "slice long, pos int, logsum double, squares double")
    mean = -F.col("logsum") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n"))
    some = F.col("n") > 0
    return names.join(sums, ["slice", "pos"], "left").select(
        "doc_id", "lang", "mark", "n", "own", "own_spread", F.when(some, mean).alias("log_ppl"), F.when(some, spread).alias("spread"), "trusted"
    )


def judged(found: DataFrame, scratch: Scratch, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """found (of perplexities) with threshold, floor and keep.

    Texts without a perplexity are kept, and so are those of languages without a trusted document, which other languages
    say nothing about; for languages with few trusted documents see LEAST_TRUSTED. floor: the low quantile of own in the
    class of trusted documents of equal binary length; own grows with length, so a class with too few documents goes by
    the best shorter one, and a language without any by the classes of all.
    """
    found = scratch.keep(found.withColumn("length", F.when(F.col("n") > 0, F.floor(F.log2("n")).cast("int"))))
    good = found.where("trusted and log_ppl is not null and lang is not null")
    # deviation of one character: a text's own would let texts pass for being uneven
    deviation = F.sqrt(F.sum(F.col("spread") * F.col("spread") * F.col("n") * F.col("n")) / F.sum("n"))
    own = [F.percentile_approx("log_ppl", quantile, 10_000).alias("own_threshold"), F.avg("log_ppl").alias("mean"), deviation.alias("deviation"), F.count("*").alias("held")]
    by_lang = scratch.keep(good.groupBy("lang").agg(*own))
    enough = F.col("held") >= LEAST_TRUSTED
    above = good.join(by_lang.select("lang", "mean"), "lang").agg(F.percentile_approx(F.col("log_ppl") - F.col("mean"), quantile, 10_000).alias("above"))

    def floors_of(*by: str) -> DataFrame:
        classes = good.groupBy(*by, "length").agg(F.percentile_approx("own", LOW_QUANTILE, 10_000).alias("floor"), F.count("*").alias("held")).where(enough)
        return classes.groupBy(*by).agg(F.collect_list(F.struct("length", "floor")).alias("floors"))

    every = above.crossJoin(floors_of().withColumnRenamed("floors", "all_floors"))  # a row each
    by_lang = by_lang.join(floors_of("lang"), "lang", "left").crossJoin(F.broadcast(every))
    threshold = F.when(enough, F.col("own_threshold")).otherwise(F.col("mean") + F.col("above"))
    # of known size, so a few languages are broadcast and a hot one is no hot task
    by_lang = scratch.keep(by_lang.select("lang", threshold.alias("threshold"), "deviation", F.when(enough, F.coalesce("floors", "all_floors")).otherwise(F.col("all_floors")).alias("floors")))
    shorter = F.filter("floors", lambda x: x["length"] <= F.col("length"))
    out = found.join(by_lang, "lang", "left").withColumn("floor", F.array_max(F.transform(shorter, lambda x: x["floor"])))
    bad = F.col("log_ppl") - margin * F.col("deviation") / F.sqrt("n") > F.col("threshold")
    dull = F.col("own") + LOW_MARGIN * F.col("own_spread") < F.col("floor")
    verdict = F.coalesce(bad, F.lit(False)) | F.coalesce(dull & F.col("log_ppl").isNotNull(), F.lit(False))
    return out.withColumn("keep", ~verdict).drop("deviation", "floors", "length")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = perplexities(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = judged(found, Scratch(spark, "quality"))
    return out.select("doc_id", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")


def keep_fluent(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay as they are.

    The verdict depends on text and language alone, so rows are matched by a digest of both.
    """
    mark = F.sha2(F.concat_ws("|", F.coalesce(lang, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    scratch = Scratch(docs.sparkSession, "quality")
    bad = judged(perplexities(docs, labels, text=text, lang=lang, mark=mark), scratch).where(~F.col("keep"))
    bad = scratch.keep(bad.select(F.col("mark").alias("__kosha_mark")).distinct())
    marked = docs.withColumn("__kosha_mark", mark)
    # rejects grow with the corpus, so they are never broadcast, however small a table is
    return marked.join(bad.hint("merge"), "__kosha_mark", "left_anti").select(*docs.columns)
