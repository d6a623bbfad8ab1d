"""Toxicity: segments, model and scores against brute force, held-out accuracy, other scripts, odd rows."""

import collections
import math
import random
import time
import zlib

import numpy as np
import pytest

from kosha.llm import toxicity

from .test_operators import DOCS, ODD, empty, odd  # noqa: F401

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def brute_segments(score):
    """All maximal scoring segments by their definition: repeatedly the best one, then both sides of it."""
    best, at = 0.0, None
    for a in range(len(score)):
        total = 0.0
        for b in range(a, len(score)):
            total += score[b]
            if total > best + 1e-9:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    left, right = brute_segments(score[: at[0]]), brute_segments(score[at[1] :])
    return left + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in right]


def test_segments_equal_definition():
    model = toxicity.Model({"=x": 1.03, "=y": 0.51, "=m": -0.77, "^abc": 0.4}, ordinary=frozenset(["=abcd"]), drift=-0.21)
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["x", "y", "m", "abcd", "abce", "z", "z", "z"]) for _ in range(rng.randint(0, 25))]
        score = [{"x": 1.03, "y": 0.51, "m": -0.77, "abce": 0.4}.get(w, -0.21) for w in words]
        found = model.passages(words, model.known())
        assert [f[:2] for f in found] == [f[:2] for f in brute_segments(score)]
        assert [f[2] for f in found] == pytest.approx([sum(score[a:b]) for a, b, _ in found])


def test_scan_is_linear():
    model = toxicity.Model({"=x": 1.0}, drift=-0.2)
    words = (["x"] + ["z"] * 20) * 40_000  # sums before the hits fall all the time
    began = time.perf_counter()
    assert len(model.passages(words, model.known())) == 40_000 and time.perf_counter() - began < 5


def brute_model(rows):
    """Scores, ordinary words and drift from (toxic, text), by the formulas of the docstring."""
    n1, n0 = sum(t == 1 for t, _ in rows), sum(t != 1 for t, _ in rows)
    held = {True: collections.Counter(), False: collections.Counter()}
    for t, text in rows:
        words = set(toxicity.tokens(text))
        held[t == 1].update({"=" + w for w in words} | {"^" + w[:k] for w in words for k in (3, 4, 5) if len(w) >= k})
    told = {}
    for f in held[True] | held[False]:
        c1, c0 = held[True][f], held[False][f]
        a = toxicity.PRIOR * (c1 + c0) / (n1 + n0)
        delta = math.log((c1 + a) / (n1 + toxicity.PRIOR - c1 - a)) - math.log((c0 + a) / (n0 + toxicity.PRIOR - c0 - a))
        told[f] = c1, c0, delta, math.sqrt(1 / (c1 + a) + 1 / (c0 + a))
    common = [(d, e) for f, (c1, c0, d, e) in told.items() if f[0] == "=" and c1 + c0 >= toxicity.COMMON * (n1 + n0)]
    shift = sum(d / e**2 for d, e in common) / sum(1 / e**2 for _, e in common) if common else 0.0
    told = {f: (c1, c0, d - shift, (d - shift) / e) for f, (c1, c0, d, e) in told.items()}
    scores = {f: d for f, (c1, c0, d, z) in told.items() if (c1 >= 3 and z >= 3 and d >= 2) or (c0 >= 3 and z <= -3 and f[0] == "=")}
    ordinary = {f for f, (c1, c0, d, _) in told.items() if f[0] == "=" and f not in scores and c0 >= 3 and d < 2 and any(len(f) > k and scores.get("^" + f[1 : k + 1], -1) > 0 for k in (3, 4, 5))}
    return scores, ordinary


def mean(score, rest, drift, x):
    return sum(r * math.exp(x * s) for s, r in score) + rest * math.exp(x * drift)


def test_model_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    told = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = [(told[r.doc_id], r.text) for r in docs.collect() if r.doc_id in told]
    scores, ordinary = brute_model(rows)
    assert set(model.scores) == set(scores) and model.ordinary == ordinary
    assert all(model.scores[f] == pytest.approx(s) for f, s in scores.items())
    # the class of ordinary words: its share inside first passages against its share in the others
    first = toxicity.Model(model.scores, model.ordinary)
    known, plain, inside = first.known(), [0, 0], [0, 0]
    hits = collections.Counter()
    for t, text in rows:
        words = toxicity.tokens(text)
        if t == 1:
            held = [w for a, b, _ in first.passages(words, known) for w in words[a:b]]
            inside[0] += sum(known[w] == first.drift for w in held)
            inside[1] += len(held)
        else:
            plain[0] += sum(known[w] == first.drift for w in words)
            plain[1] += len(words)
            hits.update(known[w] for w in words if known[w] != first.drift)
    drift = math.log((inside[0] + 0.5) / (inside[1] + 1) / ((plain[0] + 0.5) / (plain[1] + 1)))
    assert model.drift == pytest.approx(max(-1.0, min(-0.05, drift)))
    # decay: the null's moment generating function is 1 there, with one more hit shared by all toxic features
    n, toxic = plain[1] + 2, [s for s in model.scores.values() if s > 0]
    rates = [(s, c / n) for s, c in hits.items()] + [(s, 1 / len(scores) / n) for s in toxic]
    assert mean(rates, 1 - sum(r for _, r in rates), model.drift, model.decay) == pytest.approx(1, abs=1e-6)


def test_curve_is_the_likeliest():
    rng = random.Random(1)
    points = [(x / 4, float(y), rng.randint(1, 30)) for x in range(40) for y in (0, 1)]
    good, rest = (sum(n for _, y, n in points if y == v) for v in (1, 0))

    def loss(a, b):
        target = {1.0: (good + 1) / (good + 2), 0.0: 1 / (rest + 2)}
        p = [1 / (1 + math.exp(-a - b * x)) for x, _, _ in points]
        return -sum(n * (target[y] * math.log(q) + (1 - target[y]) * math.log(1 - q)) for (_, y, n), q in zip(points, p))

    points = [(x, y, n if (y == 1) == (x > 5) else 1) for x, y, n in points]
    good, rest = (sum(n for _, y, n in points if y == v) for v in (1, 0))
    a, b = toxicity._curve(points)
    assert b > 0 and all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_words_of_other_scripts(spark):
    assert toxicity.tokens("हिन्दी में, किताब! École_1 ИДИОТ") == ["हिन्दी", "में", "किताब", "école_1", "идиот"]
    rng = random.Random(4)
    letters, signs = "कखगघचछजझतथदधनपफबभमयरलवशसह", "ािीुूेैोौं"
    vocabulary = ["".join(rng.choice(letters) + rng.choice(signs) for _ in range(rng.randint(2, 4))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60) + (["दुष्टात्मा"] * (i % 8 == 0)) + rng.choices(vocabulary, k=20))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(2000)], LABELS)
    model = toxicity.train(docs, labels)
    assert model.scores["=दुष्टात्मा"] > 2
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.scored(docs, model).collect()}
    assert got == {i: i % 8 == 0 for i in range(2000)}


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in bad]) > 0.8 and np.mean([r.predicted for r in good]) < 0.01


def test_odd_rows(spark, odd, empty):  # noqa: F811
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 0, 1), (5, 1, None)], LABELS)
    model = toxicity.train(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == len(ODD) and {(r.tokens, r.score) for r in rows if r.doc_id in (1, 2, 7)} == {(0, model.score(0.0))}
    model = toxicity.Model({"=word": 3.0}, drift=-0.5, bias=-5.0, slope=1.0)
    gone = {r.doc_id for r in toxicity.scored(odd, model).where("score >= 0.3").collect()}
    kept = toxicity.keep_civil(odd, model)
    assert gone == {5} and kept.columns == odd.columns
    want = [r for r in odd.collect() if r.doc_id != 5]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))
    assert toxicity.train(odd, labels.limit(0)) == toxicity.train(empty, labels) == toxicity.Model()
    assert toxicity.scored(empty, model).count() == toxicity.keep_civil(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "word " * 2_000_000 + "end", None, None, None)], DOCS)
    assert toxicity.scored(docs, model).first().tokens == 2_000_001
