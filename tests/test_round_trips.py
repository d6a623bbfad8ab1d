"""Merging of concepts, subgraphs, pairing of stages, review samples, usage and retrieval metrics on small cases."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from kosha.operators import analytics as A
from kosha.operators import chunks as C
from kosha.operators import facts as K
from kosha.operators import graph as G


def test_chains_of_renames_end_at_their_last_key(spark):
    edges = spark.createDataFrame([("a", "x", "R"), ("x", "b", "R"), ("b", "c", "R"), ("c", "y", "R"), ("a", "y", "R")], "src string, dst string, rel string")
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("q", "q"), (None, "z")], "old string, new string")
    assert {tuple(r) for r in G.merge(edges, moves, ["rel"]).collect()} == {("c", "x", "R"), ("x", "c", "R"), ("c", "y", "R")}
    long = spark.range(1, 1000).selectExpr("concat('k', id) as old", "concat('k', id - 1) as new")
    assert {r.new for r in G.resolved(long).collect()} == {"k0"} and G.resolved(long).count() == 999
    for bad in ([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], [("a", "b"), ("a", "c")]):
        with pytest.raises(ValueError):
            G.resolved(spark.createDataFrame(bad, "old string, new string"))
    assert G.resolved(moves.limit(0)).count() == 0


def test_merged_concepts_keep_labels_books_and_units(spark):
    nodes = spark.createDataFrame(
        [("a", "Ay", None, ["1", "2"], 5), ("b", "Bee", "bi", ["2"], 3), ("c", "Cee", None, ["9"], 7), ("d", None, None, [], 1)],
        "key string, label_en string, label_mr string, books array<string>, first_seen int",
    )
    edges = spark.createDataFrame([("a", "d", "R"), ("b", "d", "R"), ("b", "c", "R")], "src string, dst string, rel string")
    units = spark.createDataFrame([(1, "a", "d"), (2, "d", "b"), (3, None, "c")], "u int, subject string, object string")
    moves = spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string")
    n, e, u = G.merge_concepts(nodes, edges, units, moves, ["label_en", "label_mr"], ["subject", "object"], ["rel"])
    assert {r.key: (r.label_en, r.label_mr, r.books, r.first_seen, r.aliases) for r in n.collect()} == {"c": ("Cee", "bi", ["1", "2", "9"], 3, ["Ay", "Bee"]), "d": (None, None, [], 1, [])}
    assert [tuple(r) for r in e.collect()] == [("c", "d", "R")]
    assert sorted(map(tuple, u.collect()), key=repr) == [(1, "c", "d"), (2, "d", "c"), (3, None, "c")]


def test_subgraph_against_breadth_first_search(spark):
    rng = random.Random(8)
    links = list({(rng.randrange(40), rng.randrange(40), rng.choice("RST")) for _ in range(70)})
    df = spark.createDataFrame(links + links[:5], "src int, dst int, rel string")
    for hops, kinds in ((1, None), (3, ["R", "S"]), (4, ["T"])):
        kept = [x for x in links if kinds is None or x[2] in kinds]
        near = collections.defaultdict(set)
        for a, b, _ in kept:
            near[a].add(b)
            near[b].add(a)
        hop, front = {0: 0, 7: 0}, [0, 7]
        for h in range(1, hops + 1):
            front = [y for x in front for y in near[x] if y not in hop and not hop.update({y: h})]
        want = {(a, b, r, min(hop[a], hop[b]) + 1) for a, b, r in kept if a in hop and b in hop and min(hop[a], hop[b]) < hops}
        got = G.subgraph(df, spark.createDataFrame([(0,), (7,)], "node int"), hops, kinds).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stages_pair_one_to_one(spark):
    inputs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (None, "y")], "id int, book string")
    outputs = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id int")
    rows = {(r.id, r.book): r.error for r in C.pairing(inputs, outputs, "id", "book").collect()}
    assert rows == {(1, "x"): "doubled", (2, "x"): None, (3, "y"): "missing", (9, None): "foreign", (None, "y"): None}
    told = {r.book: tuple(r)[1:] for r in C.count_guard(C.pairing(inputs, outputs, "id", "book"), "book").collect()}
    assert told == {"x": (2, 3, 0, 1, 0, True), "y": (2, 1, 1, 0, 0, True), None: (0, 1, 0, 0, 1, True)}
    assert not C.count_guard(C.pairing(inputs, inputs.select("id"), "id", "book"), "book").where("failed").count()


def test_conditions_keep_their_case(spark):
    rows = [("In Maharashtra during Kharif 2019 season.",), ("Nothing of the kind",), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "s string").select(K.condition(F.col("s")).alias("c")).collect()]
    assert got == ["In Maharashtra during Kharif 2019 season", None, None]


def test_samples_do_not_depend_on_partitions(spark):
    units = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None) for i in range(200)] + [(None, "a"), (5, "c")], "u int, s string")
    seen = spark.createDataFrame([(w, i) for w in (1, 2) for i in range(0, 200, w + 1)], "w int, u int")
    some = lambda n, parts: {tuple(r) for r in K.review_sample(units.repartition(parts), seen, [1, 2], "s", "u", "w", n).collect()}
    ten = some(10, 1)
    assert ten == some(10, 7) and {r for r in ten if r[3] <= 4} == some(4, 3)
    assert not {(w, u) for w, _, u, _ in ten} & {(w, i) for w in (1, 2) for i in range(0, 200, w + 1)}
    held = collections.Counter((w, s) for w, s, _, _ in ten)
    free = collections.Counter((w, "abc"[i % 3] if i % 10 else None) for w in (1, 2) for i in range(200) if i % (w + 1))
    assert held == {k: min(10, n) for k, n in free.items()}


def test_usage_by_three_keys(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("embed", "b1", 1, 10, at(30)), ("embed", None, 1, 5, at(29)), (None, None, 2, 1, at(1)), ("chat", "b1", None, 7, at(2)), ("chat", "b9", 3, 99, datetime.datetime(2023, 12, 1)), ("chat", "b9", 3, 99, None)]
    df = spark.createDataFrame(rows, "op string, book string, who int, tokens int, ts timestamp")
    cost = F.col("tokens").cast("double")
    told = {(r.grouped_by, r.k): (r.calls, r.cost) for r in A.usage(df, {"op": "op", "book": "book", "who": "who"}, {"cost": cost}, "ts", until=F.lit(at(31))).collect()}
    assert told == {
        ("op", "embed"): (2, 15.0), ("op", "unknown"): (1, 1.0), ("op", "chat"): (1, 7.0), ("book", "b1"): (2, 17.0), ("book", "unknown"): (2, 6.0),
        ("who", "1"): (2, 15.0), ("who", "2"): (1, 1.0), ("who", "unknown"): (1, 7.0), ("total", "total"): (4, 23.0),
    }
    none = A.usage(df.limit(0), {"op": "op"}, {"cost": cost}, "ts", until=F.lit(at(31))).collect()
    assert none == []


def test_retrieval_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1, True), (1, 11, 0.5, 2, False), (2, 12, 0.7, 1, None)], "query_id int, vec_id int, score double, book int, cited boolean")
    truth = spark.createDataFrame([(1, 10), (1, 99), (3, 5)], "query_id int, vec_id int")
    books = spark.createDataFrame([(1, 1), (1, 3), (3, 1)], "query_id int, book int")
    got = {r.query_id: tuple(r)[1:] for r in A.retrieval_metrics(hits, truth, 0.5, books=books).collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.7, 0.5, True), 2: (1.0, 0.0, 1.0, 0.7, 0.0, False), 3: (0.0, 0.0, 0.0, None, 0.0, False)}
