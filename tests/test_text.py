import unicodedata

import pytest
from pyspark.sql import functions as F

from vaksetu.functions import text
from vaksetu.functions.itn import write_out
from vaksetu.operators import labels, scoring
from vaksetu.plans.queries import SPOKEN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("ref", "hyp", "want"),
    [("a b c", "a x c", (1, 3)), ("a b c", "a b", (1, 3)), ("a b c", "a b c d", (1, 3)), ("ek do teen chaar", "ek do teen", (1, 4)), ("", "anything", (1, 0)), ("hello, world", "hello world", (0, 2))],
)
def test_word_errors(spark, ref, hyp, want):
    assert tuple(one(spark, text.word_errors(F.lit(ref), F.lit(hyp)))) == want


def test_punctuated_and_characters(spark):
    assert one(spark, text.word_errors(F.lit("hello, world"), F.lit("hello world"), True)).errors == 1
    assert tuple(one(spark, text.char_errors(F.lit("chaar baje"), F.lit("chaarbaje")))) == (0, 9)


def test_rows_fallback_agrees(spark):
    a, b = F.array(*map(F.lit, "kitten")), F.array(*map(F.lit, "sitting"))
    assert one(spark, text._edit_distance_rows(a, b)) == one(spark, text.edit_distance(a, b)) == 3


def test_folding_is_exact(spark):
    texts = ["Straße ÄÖ", "ﬁ ½ ²", "İstanbul ſ", "हज़ार क़", "ÀÉ naïve", "\x1cA\x85b", None, "Ⅳ K Å", "plain ASCII!"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in text.with_folded(d, {"f": "t"}).collect()]
    assert got == [unicodedata.normalize("NFKC", t or "").casefold() for t in texts]


def test_report_pools(spark):
    d = spark.createDataFrame([("a", "a"), ("b c d e f g h i j k", " ".join("x" * 10))], "reference string, hypothesis string").withColumn("bucket", F.lit("all"))
    rows = {r.bucket: r for r in scoring.report(d, bucket="bucket").collect()}
    assert rows[None].wer == pytest.approx(10 / 11) and rows[None].n == 2


def test_report_estimates_buckets(spark):
    d = spark.createDataFrame([("meeting call email", "meeting call email"), ("kal subah jaana", "kal jaana")], "reference string, hypothesis string")
    rows = {r.bucket: r for r in scoring.report(d).collect()}
    assert rows["dense"].wer == 0 and rows["hindi_dominant"].wer == pytest.approx(1 / 3)


def test_pair_raises(spark):
    a, b = spark.createDataFrame([(1, "x")], "u int, r string"), spark.createDataFrame([(2, "x")], "u int, h string")
    with pytest.raises(ValueError):
        scoring.pair(a, b, "u")


def test_entities(spark):
    e = "array<struct<type:string,surface:string>>"
    d = spark.createDataFrame([("call 4:30 baje karna", [("time", "4:30  baje")]), ("call 430 baje karna", [("time", "4:30 baje")])], f"hypothesis string, entities {e}")
    rows = {r.type: (r.hits, r.total) for r in scoring.entity_scores(d).collect()}
    assert rows == {"time": (1, 2), None: (1, 2)}
    with pytest.raises(Exception, match="unknown entity type"):
        scoring.entity_scores(spark.createDataFrame([("x", [("place", "x")])], f"hypothesis string, entities {e}")).collect()


def test_false_triggers(spark):
    d = spark.createDataFrame([("hum", 0, " a b "), ("hum", 1, None), ("hum", 2, "ab")], "condition string, clip_no int, text string")
    assert scoring.false_triggers(d, rollup=False).first().triggered == 1
    assert scoring.false_trigger_examples(d).count() == 1


def test_filters(spark):
    assert one(spark, labels.passes_wer(F.lit("kal meeting hai"), F.lit("Kal meeting hai."))) is True
    assert one(spark, labels.passes_wer(F.lit(""), F.lit("x"))) is False
    d = spark.createDataFrame([(float("nan"),), (0.3,), (0.2,), (None,)], "w double")
    assert d.filter(labels.kept_at_labelling(F.col("w"))).count() == 3


def test_calibration(spark):
    d = spark.createDataFrame(list(zip([0.1, 0.5, 0.9, 2.0, 3.0], [True, True, True, False, False], strict=True)), "entropy double, keep boolean")
    assert labels.calibrate_entropy(d).first().threshold == 0.9


@pytest.mark.parametrize(("spoken", "written"), SPOKEN)
def test_itn(spoken, written):
    assert write_out(spoken) == written


def test_itn_without_word():
    assert write_out("saade chaar baje", keep_baje=False) == "4:30"
    assert write_out("  ") == "  "
