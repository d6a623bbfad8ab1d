"""Hard-negative mining against brute force, safe bounds, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kosha.llm import negatives

from ..oracle import compare

ROWS = "vec_id long, embedding array<double>, label int"


def by_hand(rows, step, positives=5, negatives_=10, low=30, high=90):
    """All answers by scores of all pairs; rows (vec_id, embedding, label) that take part."""
    whole = sorted({(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows})
    out = []
    for i, v, c in whole:
        if i % step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in whole if j != i), key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2] == c][:positives]:
            fit = [(n, x) for n, x, d in scored if d != c and low * -s <= 100 * -n <= high * -s]
            out += [(i, j, k, x, -s, -n) for k, (n, x) in enumerate(fit[:negatives_], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def made(n, width, spread, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    return [(i, [float(x) for x in centres[i % 6] + spread * rng.standard_normal(width)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("spread,part_rows,team_rows", [(0.1, 40, 5), (2.0, 1000, 1000)])
def test_equals_brute_force(spark, spread, part_rows, team_rows):
    """Dense clusters, where the filter leaves most rows out, and wide ones; small parts and teams; integer ties."""
    rows = made(500, 8, spread, 3)
    rows += [(1000 + i, [round(x) / 4 for x in v], c) for i, v, c in rows[:200]] + [(2000 + i, rows[0][1], 1) for i in range(40)] + [(3000 + i, [0.0] * 8, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, ROWS)
    assert told(negatives.mine(df, F.col("vec_id") % 20 == 0, part_rows=part_rows, team_rows=team_rows)) == by_hand(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = made(30, 4, 1.0, 5, labels=2)
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [nan, 0.0, 0.0, 0.0], 1), (103, [inf, 0.0, 0.0, 0.0], 0), (104, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    odd += [(105, [], 1), (106, [1.0, 2.0], 0), (107, [1e300, 0.0, 0.0, 0.0], 0), fine[0], fine[0]]
    df = spark.createDataFrame(fine + odd, ROWS).selectExpr("*", "1 as e", "2 as score", "3 as cell", "4 as part", "5 as q", "6 as ids")
    assert told(negatives.mine(df, F.col("vec_id") % 3 == 0)) == by_hand(fine, 3)
    words = spark.createDataFrame([(i, v, f"label {c}") for i, v, c in fine], "vec_id long, embedding array<float>, label string")
    close = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in fine]
    assert told(negatives.mine(words, F.col("vec_id") % 3 == 0)) == by_hand(close, 3)


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], ROWS)
    assert told(negatives.mine(none, F.col("vec_id") % 2 == 0)) == []
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], ROWS)
    assert told(negatives.mine(one, F.col("vec_id") % 2 == 0)) == []
    assert told(negatives.mine(spark.createDataFrame(made(20, 4, 1.0, 5), ROWS), F.col("vec_id") == 999)) == []


def test_whole_tables_equal_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert compare(spark, "op11", negatives.op11_negatives, negatives.SQL, f"/root/testdata/{sf}") == ""


def test_bounds_hold_every_score():
    """Also for vectors that are equal, opposite, zero or nearly so, where angles are least exact."""
    rng = np.random.default_rng(2)
    random.seed(2)
    x = np.floor(256 * rng.standard_normal((400, 16)))
    x[:50] = x[50:100] + rng.integers(-1, 2, (50, 16))
    x[100:150] = -x[150:200]
    x[200:205] = 0
    x[205:210] = x[210:215]
    x[215:220] = 1000 * x[220:225]
    centres = negatives.references(x)
    norm, at = negatives.angles(x, centres)
    scores = x.astype(np.int64) @ x.astype(np.int64).T
    for used in ([0], [3, 7], list(range(negatives.REFERENCES))):
        lower, upper = negatives.row_bounds(norm, at, norm, at, used)
        assert (lower <= scores).all() and (scores <= upper).all()
    places = {"low": at.min(axis=0)[None, :].astype(float), "high": at.max(axis=0)[None, :].astype(float), "least": np.array([norm.min()]), "most": np.array([norm.max()])}
    for i in range(len(x)):
        lower, upper = negatives.place_bounds(norm[i], at[i].astype(float), places)
        assert lower[0] <= scores[i].min() and scores[i].max() <= upper[0]


def test_clusters_leave_most_pairs_unscored():
    """What the filter is for: tight groups of directions, and windows that other groups cannot reach."""
    x = np.floor(256 * np.array([v for _, v, _ in made(600, 16, 0.05, 1)]))
    norm, at = negatives.angles(x, negatives.references(x))
    lower, upper = negatives.row_bounds(norm, at, norm, at, list(range(negatives.REFERENCES)))
    best = norm[:, None] ** 2
    assert ((upper >= 0.3 * best) & (lower <= 0.9 * best)).mean() < 0.5
