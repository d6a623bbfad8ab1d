"""The pipeline's stages, each on its own input, against brute force."""

import collections

import pytest

import corpus_pipeline
from kosha.llm import secrets, toxicity
from kosha.llm.common import Scratch

from .test_operators import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.keep(stage(spark, docs, SF))
    return out


def test_stage_list(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    for name in ("toxicity", "quality", "near_dedup", "secrets"):
        assert stages[name].columns == stages["input"].columns


def test_toxicity_stage(spark, stages):
    docs = stages["input"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.scored(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in stages["toxicity"].collect()} == want


def test_quality_stage_only_drops(stages):
    before, after = ({(r.doc_id, r.text) for r in stages[n].collect()} for n in ("toxicity", "quality"))
    assert after < before


def test_near_dedup_stage(stages):
    def shingles(text):
        w = text.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    rows = {r.doc_id: shingles(r.text) for r in stages["quality"].collect()}
    parent = {d: d for d in rows}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = rows[a], rows[b]
            if len(x & y) >= 0.8 * len(x | y):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for d in ids:
        groups[find(d)].append(d)
    assert {r.doc_id for r in stages["near_dedup"].collect()} == {min(g) for g in groups.values()}


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    after = {r.doc_id: r.text for r in stages["secrets"].collect()}
    assert set(before) == set(after)
    spans = {r.doc_id: r.spans for r in secrets.find_spans(stages["near_dedup"])[0].collect()}
    for d, text in before.items():
        want, at = "", 0
        for s in spans[d]:
            if s.s >= at:
                want += text[at : s.s] + "[secret]"
            at = max(at, s.e)
        assert after[d] == want + text[at:]


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    texts = {r.doc_id: r.text for r in stages["secrets"].collect()}
    check_packing(stages["packing"].collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts)


def test_run_gives_every_piece(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, stages["packing"].select(key).collect()))
