"""Assignment of facts, chunk signals and coverage by variant against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kosha.operators import evaluation as V


GOLDEN = "golden_id long, book string, subject string, predicate string, object string, type string, floor double, v array<double>"
MINED = GOLDEN.replace("golden_id", "mined_id").replace("floor", "confidence")


def most_pairs(golden, mined, key):
    """Size of the largest one-to-one matching, by augmenting paths."""
    fits = {g[0]: [m[0] for m in mined if key(g) == key(m) and None not in key(g) and m[6] >= g[6]] for g in golden}
    mate = {}

    def place(g, seen):
        for m in fits[g]:
            if m not in seen:
                seen.add(m)
                if m not in mate or place(mate[m], seen):
                    mate[m] = g
                    return True
        return False

    return sum(place(g, set()) for g in fits)


def made_facts(rng, n, first):
    out = []
    for i in range(n):
        v = [float(x) for x in np.random.default_rng(rng.randrange(6)).standard_normal(6) + 0.15 * np.array([rng.gauss(0, 1) for _ in range(6)])]
        out.append((first + i, rng.choice("ab"), rng.choice("xyz"), rng.choice(["is", "has"]), rng.choice(["p", "q", None]), rng.choice(["claim", "rule"]), rng.choice([0.2, 0.5, 0.5, 0.9]), v))
    return out


def greedy(golden, mined, least):
    """The fuzzy level: pairs of one book taken by cosine and ids while both are free."""
    def cos(a, b):
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    pairs = sorted((-cos(g[7], m[7]), g[0], m[0]) for g, m in itertools.product(golden, mined) if g[1] == m[1] and m[6] >= g[6] and cos(g[7], m[7]) > least)
    seen, out = set(), set()
    for _, g, m in pairs:
        if ("g", g) not in seen and ("m", m) not in seen:
            out.add((g, m))
            seen |= {("g", g), ("m", m)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_levels_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)  # books are dealt out in blocks
    rng = random.Random(seed)
    golden, mined = made_facts(rng, 40, 0), made_facts(rng, 50, 1000)
    g, m = spark.createDataFrame(golden, GOLDEN), spark.createDataFrame(mined, MINED)
    made = {x: set() for x in ("exact", "fuzzy", "partial")}
    for r in V.assignments(g, m).collect():
        made[r.level].add((r.golden_id, r.mined_id))
    of_g, of_m = {r[0]: r for r in golden}, {r[0]: r for r in mined}
    used = [x for level in made.values() for x in level]
    assert len({a for a, _ in used}) == len({b for _, b in used}) == len(used)
    exact, partial = (lambda r: r[1:5]), (lambda r: r[1:4])
    assert all(exact(of_g[a]) == exact(of_m[b]) and of_m[b][6] >= of_g[a][6] for a, b in made["exact"])
    assert len(made["exact"]) == most_pairs(golden, mined, exact)
    free = lambda rows, i, levels: [r for r in rows if r[0] not in {p[i] for x in levels for p in made[x]}]
    assert made["fuzzy"] == greedy(free(golden, 0, ["exact"]), free(mined, 1, ["exact"]), 0.85)
    rest = free(golden, 0, ["exact", "fuzzy"]), free(mined, 1, ["exact", "fuzzy"])
    assert len(made["partial"]) == most_pairs(*rest, partial)
    told = {(r.book, r.level): r for r in V.extraction_report(g, m, V.assignments(g, m)).collect()}
    for book in "ab":
        n, k = sum(r[1] == book for r in golden), sum(r[1] == book for r in mined)
        found = typed = 0
        for level in ("exact", "fuzzy", "partial"):
            here = [(a, b) for a, b in made[level] if of_g[a][1] == book]
            found, typed = found + len(here), typed + sum(of_g[a][5] == of_m[b][5] for a, b in here)
            r = told[book, level]
            assert (r.golden, r.mined, r.found, r.typed) == (n, k, found, typed)
            assert (r.precision, r.recall, r.f1) == (round(found / k, 6), round(found / n, 6), round(2 * found / (n + k), 6))


def test_one_sided_books_and_no_facts(spark):
    g = spark.createDataFrame([(1, "only golden", "s", "is", "o", "claim", 0.5, [1.0])], GOLDEN)
    m = spark.createDataFrame([(9, "only mined", "s", "is", "o", "claim", 0.5, [1.0]), (10, None, "s", "is", "o", "claim", 0.5, [0.0])], MINED)
    rows = {(r.book, r.level): r for r in V.extraction_report(g, m, V.assignments(g, m)).collect()}
    assert rows["only golden", "exact"].recall == 0 and rows["only golden", "exact"].precision is None and rows["only mined", "partial"].recall is None
    assert V.assignments(g.limit(0), m.limit(0)).count() == 0


def test_chunk_signals(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for doc in range(3):
        chunks = [[rng.standard_normal(5) for _ in range(rng.integers(1, 5))] for _ in range(4)]
        for c, vectors in enumerate(chunks):
            rows += [(doc, c, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
            u = [v / np.linalg.norm(v) for v in vectors]
            pairs = [float(a @ b) for a, b in itertools.combinations(u, 2)]
            after = chunks[c + 1][0] / np.linalg.norm(chunks[c + 1][0]) if c + 1 < len(chunks) else None
            want[doc, c] = (len(u), np.mean(pairs) if pairs else None, float(u[-1] @ after) if after is not None else None)
    rows.append((0, 0, 99, [0.0] * 5))  # has no direction
    df = spark.createDataFrame(rows, "doc int, chunk int, pos int, v array<double>").orderBy(F.rand(3))
    got = {(r.doc, r.chunk): (r.n, r.coherence, r["drop"]) for r in V.chunk_signals(df, "doc", "chunk", "pos", "v", 5).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w) if None not in w else [x is None for x in got[k]] == [x is None for x in w]
    [one] = V.chunk_quality(V.chunk_signals(df.where("doc = 1"), "doc", "chunk", "pos", "v", 5), "doc").collect()
    assert one.chunks == 4 and one.edges == 3 and one["drop"] == pytest.approx(np.mean([want[1, c][2] for c in range(3)]))


def test_coverage_counts_a_mark_once(spark):
    chunks = spark.createDataFrame([("a", "x", "1234"), ("a", "y", "12"), ("b", "x", "1")], "variant string, source string, text string")
    found = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("a", "y", 2)], "variant string, source string, mark int")
    got = {(r.variant, r.source, r.grouped): (r.chunks, r.mean_length, r.covered, r.share) for r in V.coverage_by_variant(chunks, found, 4, "source").collect()}
    assert got["a", None, 1] == (2, 3.0, 2, 50.0) and got["a", "y", 0] == (1, 2.0, 2, 50.0) and got["b", "x", 0] == (1, 1.0, 0, 0.0) and got["b", None, 1] == (1, 1.0, 0, 0.0)


def test_variants_are_cut_and_searched_in_one_pass(spark):
    """No text is shuffled or joined, and windows are cut once: F16."""
    from kosha.plans import registry

    registry.load()
    frame = registry.QUERIES["j6_variants"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Join ") == 1 and "Window" not in plan
    assert "BroadcastHashJoin" in frame._jdf.queryExecution().executedPlan().toString()


def test_variants_of_odd_texts_equal_sql(spark, tmp_path):
    """Headings first, last, doubled and before a carriage return; empty texts; null ids, sources, texts and marks; final sigmas; equal, empty and many heads."""
    from kosha.plans import registry

    from .oracle import compare

    registry.load()
    long = "The same passage of forty characters or so, whole. " * 60
    texts = ["Head.\nbody of it\nNext.\n\nmore", "a\nEnd.", "One.\nTwo.\nThree.\n", "word.\r\nword.\nx y.", "", "\n\n", None, long, "ΟΔΟΣ. " * 700, "½.\nx\nक_1.\ny", "a. b.\nX.", long + "\nA.\n" + long, "Mark me here. Mark\nme\t here."]
    rows = [(i, t, "xy"[i % 2] if i % 5 else None) for i, t in enumerate(texts)] + [(None, "Head.\nof no id\nNext.\nmark me here", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/d")
    heads = ["passage of forty characters or so, whole. The same", "Mark  me\nhere", "mark me here", "body of it next.", "absent", None, "οδο", "a. οδος", "x", "b."]
    for name, marks in (("some", heads), ("none", []), ("blank", [*heads, ""])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(list(enumerate(marks)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}_b")
        next((tmp_path / f"{name}_b").glob("*.parquet")).rename(tmp_path / name / "benchmark.parquet")
        (tmp_path / name / "documents.parquet").write_bytes(next((tmp_path / "d").glob("*.parquet")).read_bytes())
        assert compare(spark, "j6", registry.QUERIES["j6_variants"], registry.ORACLE_SQL["j6_variants"], f"{tmp_path}/{name}") == ""


def test_vectors_come_without_a_join(spark):
    """Sentences keep their row while they get a vector, and facts are written once before they are matched."""
    from kosha.operators import retrieval as R
    from kosha.plans import registry

    registry.load()
    sf = "/root/testdata/sf0.001"
    plan = registry.QUERIES["j9_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    plan = registry.QUERIES["j8_extraction"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan
    rows = spark.createDataFrame([(1, "soil and water"), (2, "Rice rice")], "id long, s string")
    one = {r.id: list(r.vector) for r in R.embed(rows, "id", "s").collect()}
    assert {r.id: list(r.v) for r in rows.withColumn("v", R.hashed_words(F.col("s"))).collect()} == one


def test_chunks_are_digested_where_they_lie(spark, monkeypatch):
    """No sentence is a row of its own: F3; a digest of a chunk's sentences gives the signals of their vectors, to the last bit."""
    import xxhash

    from kosha.functions.text import sentences
    from kosha.operators import retrieval as R
    from kosha.plans import registry

    registry.load()
    plan = registry.QUERIES["j9_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Rice", "rice", "ΟΔΟΣ", "क", "-", "½", "a b"]
    h = {w: xxhash.xxh64_intdigest(w) for w in (f"z{i}" for i in range(3000))}
    up = {w: x % 64 for w, x in h.items() if x >> 63}
    gone = next(f"{a} {b}" for a, x in h.items() if not x >> 63 for b, at in up.items() if at == x % 64)  # their counts cancel
    said = lambda: "; ".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))) + "."
    rows = [(d, c, said()) for d in range(30) for c in range(12)]
    rows += [(100, 0, "one two."), (100, 1, gone), (100, 2, "two one. " + gone), (100, 3, ""), (100, 4, None), (100, 5, " - \n"), (100, 6, "one"), (101, 0, gone), (102, 0, None)]
    chunks = spark.createDataFrame(rows, "doc long, chunk int, text string").coalesce(2)
    told = chunks.select("doc", "chunk", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).withColumn("v", R.hashed_words(F.col("s")))
    want = {(r.doc, r.chunk): tuple(r) for r in V.chunk_signals(told, "doc", "chunk", "pos", "v", 64).collect()}
    for size in (1, 7, 256):
        monkeypatch.setattr(V, "CHUNK_BLOCK", size)
        made = chunks.select("doc", "chunk", V.sentence_digest(sentences(F.col("text"))).alias("d")).select("doc", "chunk", "d.*")
        assert {(r.doc, r.chunk): tuple(r) for r in V.digest_signals(made, "doc", "chunk").collect()} == want
    assert {k[1] for k in want if k[0] >= 100} == {0, 2, 6} and len(want) == 363
    assert V.digest_signals(made.limit(0), "doc", "chunk").count() == 0


def test_hashed_words_are_counted_in_blocks(monkeypatch):
    import xxhash

    from kosha.operators import retrieval as R

    monkeypatch.setattr(R, "TEXT_BLOCK", 3)
    monkeypatch.setattr(R, "KNOWN_WORDS", 5)
    texts = ["", "a B a", "  ", *(" ".join(f"w{i * j % 17}" for i in range(j)) for j in range(20)), "ΟΔΟΣ क x"]
    want = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            want[i, h % 16] += 1 if h >> 63 else -1
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert (R.hashed(texts, 16) == want / np.where(length > 0, length, 1)).all() and R.hashed([], 16).shape == (0, 16)
