"""Fill-in-middle against a row-by-row version, round trips, and odd rows."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kosha.llm import infill

from ..oracle import compare

MARKS = (infill.PREFIX, infill.SUFFIX, infill.MIDDLE)
UNIT = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def units_of(text, unit):
    return re.findall(UNIT[unit], text)


def by_hand(key, text, unit="char", seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units_of(text, unit)
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return len(parts), "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < 20:
        return len(parts), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (None, "null key", "en", "s", 8), (3, "same text", "en", "s", 9), (3, "same text", "en", "s", 9),
    (4, "has <S> in it", "en", "s", 9), (5, "ends with <P", "en", "s", 9), (6, "<M<P<S", "en", "s", 6), (7, "漢字 🙂 é\x00\x01", "xx", "s", 8), (8, "\n\n \t", "en", "s", 4),
    (9, "é‍🙂" * 700_000, "xx", "s", 9), (10, " " * 2_000_000, "en", "s", 9), (11, "a" * 2_000_000, "en", "s", 9), (12, "line of words\n" * 150_000, "en", "s", 9),
] + [(i, f"text {i} <" + "ab ç\n" * (i % 7), "en", "s", 9) for i in range(20, 140)]


@pytest.mark.parametrize("unit", infill.UNITS)
def test_odd_rows(spark, unit):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "'x' as output", "1 as n", "'y' as form", "2 as h1")
    got = infill.fill_in_middle(docs, unit).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    told = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got.collect()), key=repr)
    want = sorted(((d, *by_hand(d, t, unit)) for d, t, *_ in ODD), key=repr)
    assert told == want
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = sorted((r.back for r in got.select("back").collect()), key=repr)
    assert back == sorted((t or "" for _, t, *_ in ODD), key=repr)


def test_empty_table_and_unknown_unit(spark):
    none = spark.createDataFrame([], DOCS)
    assert infill.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(none, "page")


def test_whole_tables_equal_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert compare(spark, "op13", infill.op13_infill, infill.SQL, f"/root/testdata/{sf}") == ""


TEXTS = st.lists(st.text(st.sampled_from("ab <>PSM\n\té漢🙂"), max_size=40), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(infill.UNITS), st.integers(4, 50), st.integers(0, 3))
def test_any_block_and_slice(texts, unit, block, skip):
    """Results do not depend on how texts are dealt to runs and segments."""
    whole = pa.array(["skipped"] * skip + texts, pa.string()).slice(skip)
    for part in [whole] + [whole.slice(i, 1) for i in range(len(texts))]:
        told = part.to_pylist()
        run = infill.Run(part, unit, block)
        assert run.counts().tolist() == [len(units_of(t, unit)) for t in told]
        cuts = [(len(units_of(t, unit)) // 3, len(units_of(t, unit)) * 2 // 3) for t in told]
        found = run.pieces(tuple(pa.array([c[i] for c in cuts], pa.int64()) for i in range(2)))
        for t, (a, b), *three in zip(told, cuts, *(f.to_pylist() for f in found)):
            u = units_of(t, unit)
            assert three == ["".join(u[:a]), "".join(u[a:b]), "".join(u[b:])]
