"""The pipeline's stages on odd and empty tables."""

import pytest

import corpus_pipeline as P
from vaksetu.llm.common import materialize

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, near_key string, rlz_key string, found string"


def rows():
    shared = " ".join(f"passage{i}" for i in range(60))
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in ("alpha", "delta"))
    texts = [None, "", " \n ", "one two", "one two", f"{a} {shared} gamma", f"{b} {shared} epsilon zeta", "call 8.8.8.8 or bob@mail.example.com", "word " * 40_000]
    table = [(i, t, "en", "a", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return [*table, table[4], (None, "nobody knows", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    docs = spark.createDataFrame([] if empty else rows(), KIND)
    found = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, DATA), f"test-{name}")
        found[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    if empty:
        assert not any(found.values())
        return
    assert len(found["toxicity"]) == len(rows())
    near = found["near_duplicates"]
    assert sorted((r.doc_id for r in near if r.doc_id is not None)) == [0, 3, 5, 6, 7, 8] and sum(r.doc_id is None for r in near) == 1
    texts = {r.doc_id: r.text for r in found["substring_dedup"]}
    assert texts[5].split() == [*(f"alpha{i}" for i in range(80)), "gamma"] and texts[6].split()[-3:] == ["delta79", "epsilon", "zeta"] and texts[8] == "" and texts[0] is None
    hidden = {r.doc_id: r.text for r in found["pii"]}
    assert "8.8.8.8" not in hidden[7] and "bob@" not in hidden[7] and hidden[7].endswith("@mail.example.com") and hidden[3] == "one two"
    assert len(found["packing"]) >= len(near) and {r.doc_id for r in found["packing"]} == {r.doc_id for r in near}
