"""The scoring queries over whole documents against brute force."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from vaksetu.functions import text
from vaksetu.plans import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents of up to 150 words; doc_id 5 modulo 13 leaves out every seventh word, so errors lie far beyond the first words, too."""
    rng = random.Random(3)
    word = lambda: rng.choice(["Die", "straße,", "well", "a-b", "été", "x"]) if rng.random() < 0.3 else "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    rows = [(i, "en" if i % 2 else "fr", "  ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 31, 32, 33, 60, 100, 150, 90, 70])]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{d}/documents.parquet")
    return d, rows


@pytest.fixture(scope="module")
def counts(documents):
    """doc_id: (bucket, three times (errors, length))."""
    out = {}
    for i, bucket, t in documents[1]:
        toks = t.split()
        place = lambda k: (k + i) % (5 + i % 31)  # noqa: E731, B023
        left = [re.sub(r"\w", queries.FRESH, x) if place(k) == 1 else x for k, x in enumerate(toks, 1) if place(k)]
        plain = lambda ws: " ".join(ws).lower().replace("ß", "ss")
        bare = lambda ws: re.sub(r"[^\w\s]", " ", plain(ws))
        views = (lambda ws: bare(ws).split(), lambda ws: plain(ws).split(), lambda ws: re.sub(r"\s", "", bare(ws)))
        out[i] = (bucket, *((distance(v(toks), v(left)), len(v(toks))) for v in views))
    return out


@pytest.mark.parametrize("at, name", [(1, "wer_pairs"), (2, "wer_punct_pairs"), (3, "cer_pairs")])
def test_pairs(spark, documents, counts, at, name):
    got = {r.doc_id: (r.errors, r.length) for r in queries.QUERIES[f"{name}"](spark, documents[0]).collect()}
    assert got == {i: c[at] for i, c in counts.items()} and max(n for _, n in got.values()) > 100


def test_reports(spark, documents, counts):
    def pooled(rows):
        rows = list(rows)
        return (len(rows), *(round(sum(c[k][0] for c in rows) / sum(c[k][1] for c in rows), 9) for k in (1, 2, 3)))

    want = {b: pooled(c for c in counts.values() if b in (None, c[0])) for b in ("en", "fr", None)}
    rows = lambda name: {r.asDict().get("bucket"): (r.n, r.wer, r.punctuated_wer, r.cer) for r in queries.QUERIES[f"{name}"](spark, documents[0]).collect()}
    assert rows("report_rollup") == want
    assert rows("report_by_bucket") == {b: v for b, v in want.items() if b}
    assert rows("report_overall") == {None: want[None]}


def test_filters(spark, documents, counts):
    run = lambda name: queries.QUERIES[f"{name}"](spark, documents[0]).collect()
    wer = {i: c[1][0] / c[1][1] if c[1][1] else None for i, c in counts.items()}
    assert {r.doc_id: r.passes for r in run("wer_filter")} == {i: w is not None and w <= 0.2 for i, w in wer.items()}
    kept = {i for i, w in wer.items() if w is None or w <= 0.2}
    assert {r.doc_id for r in run("label_stage_filter")} == kept
    (r,) = run("label_drop_rate")
    assert (r.kept, r.dropped) == (len(kept), len(wer) - len(kept))


def test_entry_scores_whole_documents(spark):
    import __spark_entry__

    got = {r.bucket: r for r in __spark_entry__.entry(spark).collect()}
    want = {r.bucket: r for r in queries.QUERIES["report_rollup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and got[None].wer > 0


def test_streaming_report(spark, documents):
    rows = lambda name: {r.bucket: (r.n, *(round(x, 9) for x in (r.wer, r.punctuated_wer, r.cer))) for r in queries.QUERIES[name](spark, documents[0]).collect()}
    got = rows("streaming_report")
    assert got == rows("report_by_bucket") and all(v[1] > 0 for v in got.values())


def test_distance_in_bits():
    rng = random.Random(1)
    for _ in range(500):
        k = rng.randint(1, 5)
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert text.distance_in_bits(a, b) == distance(a, b)


def test_both_ways_agree(spark, monkeypatch):
    """Pairs whose table is small and those whose table is large take different ways to the same counts."""
    rng = random.Random(2)
    sides = [" ".join(rng.choice(["ab", "c", "d,", "ef"]) for _ in range(60)) for _ in range(8)]
    df = spark.createDataFrame(list(zip(sides, sides[1:])), "r string, h string")
    count = lambda: [tuple(r) for r in df.select(text.word_errors(F.col("r"), F.col("h")), text.char_errors(F.col("r"), F.col("h"))).collect()]
    near = count()
    monkeypatch.setattr(text, "MOST_CELLS", 0)
    assert count() == near


def test_a_hypothesis_that_fits_takes_one_pass(monkeypatch):
    """Left-out and foreign items need no table; whatever does not fit still takes one, with the same counts."""
    rng = random.Random(5)
    pairs = [("", ""), ("ab", ""), ("", "ab"), ("a]^-b", "a^-"), ("aab", "aba")]
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        pairs.append((a, "".join(x if rng.random() < 0.8 else rng.choice(["", "z", "a"]) for x in a)))
    for a, b in pairs:
        assert text.distance_of(a, b) == text.distance_of(list(a), list(b)) == distance(a, b)
    monkeypatch.setattr(text, "distance_in_bits", None)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    left = "".join("z" if k % 11 == 0 else x for k, x in enumerate(long) if k % 13)
    want = len(long) - len(left) + left.count("z")
    assert text.distance_of(long, left) == text.distance_of(list(long), list(left)) == want
