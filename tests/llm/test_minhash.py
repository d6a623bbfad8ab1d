"""MinHash near-duplicates against brute force over all pairs, and odd rows."""

import itertools
import random

import numpy as np
import pytest

from kosha.llm import minhash
from kosha.llm.simhash import shingle_hashes

from ..oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if w else set()


def by_hand(rows, words=4, share=80):
    """Sorted (doc_id, n_shingles, component_id, kept) over all pairs of rows (doc_id, text)."""
    sets = [shingles(t, words) for _, t in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= share * (len(sets[i]) + len(sets[j]) - common):
            lead[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


ODD = [
    (1, ""), (2, None), (None, "null key has a few words"), (None, "alone and null"), (3, "same text here"), (3, "same text here"), (4, "Same  TEXT\there"), (5, "word " * 400_000),
    (6, "word " * 300_000), (7, "漢字 🙂 é\x01"), (8, "   \t\n "), (9, "\xa0"), (10, "null key has a few words"), (11, "a" * 2_000_000), (12, " " * 2_000_000), (13, "x"), (14, "X"),
    (15, "é É"), (16, "é é"), (17, "one two three four"), (18, "one two three four"),
]


def test_odd_rows(spark):
    rows = [(d, t, "en", "s", 0) for d, t in ODD]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as set_id", "2 as rid", "3 as bucket", "4 as component_id", "5 as n", "6 as halves", "7 as kept")
    assert told(minhash.near_groups(docs, words=4)) == by_hand(ODD)


def test_empty_table_and_no_links(spark):
    none = spark.createDataFrame([], DOCS)
    assert told(minhash.near_groups(none)) == []
    apart = spark.createDataFrame([(1, "all of these words differ"), (2, "from any other text around")], "doc_id long, text string")
    assert told(minhash.near_groups(apart)) == [(1, 1, 1, True), (2, 1, 2, True)]


def edits(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("most_mated", "most_held"), [(2, 256), (24, 256), (24, 4)])
def test_equals_brute_force_over_edited_families(spark, most_mated, most_held):
    """Families of edits around the threshold, a shared passage, copies; also with all buckets on the exact way and with frequent halves."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for size in (60, 25, 8, 3):
        texts += edits(rng, [word() for _ in range(rng.randrange(60, 120))], size)
    passage = " ".join(word() for _ in range(30))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randrange(4, 40)))}" for _ in range(60)]
    texts += texts[:10] + ["short text of five words"] * 30
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(minhash.near_groups(docs, words=4, most_mated=most_mated, most_held=most_held)) == by_hand(rows)


def test_whole_tables_equal_sql(spark):
    assert compare(spark, "op12", minhash.op12_minhash, minhash.SQL, "/root/testdata/sf0.001") == ""


def test_recall_of_the_tables():
    """Pairs at 0.8 meet in some table, and far fewer of those at 0.2 do."""
    rng = np.random.default_rng(1)
    met = {0.8: 0, 0.2: 0}
    for s in met:
        for _ in range(400):
            common = round(2 * 1000 * s / (1 + s))  # of two sets of 1,000
            every = rng.integers(0, 2**63, 2000 - common, dtype=np.uint64)
            a, b = every[:1000], every[1000 - common :]
            x, y = minhash.halves(a), minhash.halves(b)
            same = x == y
            met[s] += bool(same[: minhash.TABLES].any() and same[minhash.TABLES :].any())
    assert met[0.8] == 400 and met[0.2] < 120


def test_halves_need_no_more_values_than_named():
    h = shingle_hashes("some words that make a few shingles", 4)
    assert len(minhash.halves(h)) == 2 * minhash.TABLES and len(minhash.halves(h[:0])) == 0
