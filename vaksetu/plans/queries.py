"""The registered queries over the test tables, each with SQL for comparison where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, itn, text
from ..operators import intervals, labels, pack, profile, quota, schema, scoring, vocabulary, window_cost
from ..runtime import shared_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL in pieces
def n_(x: str, strip: bool = True) -> str:
    """Normalised text."""
    t = f"replace(lower({x}), 'ß', 'ss')"
    if strip:
        t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def w_(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


#: A letter that no document has.
FRESH = "\u046b"

#: Pairs: all tokens of a document, and the same with some left out and the letters of some others replaced by ``FRESH``, by place.
#: A token with a fresh letter matches nothing, so at least (reference - hypothesis + fresh) edits are needed, and so many suffice: SQL counts them without a table of distances.
PAIRS_SQL = rf"""
p AS (
    SELECT doc_id, lang AS bucket, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS toks FROM documents
), q AS (
    SELECT doc_id, bucket, array_to_string(toks, ' ') AS reference, array_to_string(list_filter(list_transform(toks, lambda t, i:
        CASE (i + doc_id) % (5 + doc_id % 31) WHEN 0 THEN '' WHEN 1 THEN regexp_replace(t, '[\p{{L}}\p{{N}}_]', '{FRESH}', 'g') ELSE t END), lambda t: t <> ''), ' ') AS hypothesis FROM p
)"""


def _pairs(docs: DataFrame) -> DataFrame:
    p = docs.select("doc_id", F.col("lang").alias("bucket"), F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("toks"))
    place = lambda i: (i + 1 + F.col("doc_id")) % (5 + F.col("doc_id") % 31)
    heard = F.transform("toks", lambda t, i: F.when(place(i) == 0, "").when(place(i) == 1, F.regexp_replace(t, r"[\p{L}\p{N}_]", FRESH)).otherwise(t))
    return p.select("doc_id", "bucket", F.array_join("toks", " ").alias("reference"), F.array_join(F.filter(heard, lambda t: t != ""), " ").alias("hypothesis"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(_pairs(table(spark, sf_dir, "documents")))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file are worth dealing out; each task starts Python, so there are a few for each core, not for each shuffle partition."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "doc_id")


def errors_sql(with_rest: str) -> str:
    words = lambda r, h: f"len({r}) - len({h}) + len(list_filter({h}, lambda t: contains(t, '{FRESH}')))"
    return f"""
WITH {PAIRS_SQL}, s AS (
    SELECT doc_id, bucket, {n_("reference")} AS r, {n_("hypothesis")} AS h, {n_("reference", False)} AS rp, {n_("hypothesis", False)} AS hp FROM q
), t AS (
    SELECT *, {w_("r")} AS rt, {w_("h")} AS ht, {w_("rp")} AS rpt, {w_("hp")} AS hpt FROM s
), e AS (
    SELECT doc_id, bucket, {words("rt", "ht")} AS wer_errors, len(rt) AS wer_length, {words("rpt", "hpt")} AS punctuated_wer_errors, len(rpt) AS punctuated_wer_length,
        length(replace(r, ' ', '')) - length(replace(replace(h, ' ', ''), '{FRESH}', '')) AS cer_errors, length(replace(r, ' ', '')) AS cer_length
    FROM t
)
{with_rest}"""


def folded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_folded(pairs(spark, sf_dir), {"r": "reference", "h": "hypothesis"})


def folded(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return text.with_folded(table(spark, sf_dir, name), {"f": "text"})


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_counts(pairs(spark, sf_dir))


# ---------------------------------------------------------------- text
@query(f"SELECT doc_id, {n_('text')} AS norm FROM documents")
def normalise_wer(spark, sf):
    return folded(spark, sf).select("doc_id", text.normalise(F.col("f"), folded=True).alias("norm"))


@query(f"SELECT doc_id, {n_('text', False)} AS norm FROM documents")
def normalise_punct(spark, sf):
    return folded(spark, sf).select("doc_id", text.normalise(F.col("f"), False, True).alias("norm"))


@query(errors_sql("SELECT doc_id, CAST(wer_errors AS BIGINT) AS errors, CAST(wer_length AS BIGINT) AS length FROM e"))
def wer_pairs(spark, sf):
    return folded_pairs(spark, sf).select("doc_id", text.word_errors(F.col("r"), F.col("h"), False, True).alias("e")).select("doc_id", "e.errors", "e.length")


@query(errors_sql("SELECT doc_id, CAST(punctuated_wer_errors AS BIGINT) AS errors, CAST(punctuated_wer_length AS BIGINT) AS length FROM e"))
def wer_punct_pairs(spark, sf):
    return folded_pairs(spark, sf).select("doc_id", text.word_errors(F.col("r"), F.col("h"), True, True).alias("e")).select("doc_id", "e.errors", "e.length")


@query(errors_sql("SELECT doc_id, CAST(cer_errors AS BIGINT) AS errors, CAST(cer_length AS BIGINT) AS length FROM e"))
def cer_pairs(spark, sf):
    return folded_pairs(spark, sf).select("doc_id", text.char_errors(F.col("r"), F.col("h"), True).alias("e")).select("doc_id", "e.errors", "e.length")


_RATES = ", ".join(f"round(CASE WHEN sum({m}_length) > 0 THEN sum({m}_errors) / sum({m}_length) ELSE 0 END, 9) AS {m}" for m in scoring.METRICS)


def _rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(errors_sql(f"SELECT count(*) AS n, {_RATES} FROM e"))
def report_overall(spark, sf):
    return _rounded(scoring.pooled(counted(spark, sf).withColumn("one", F.lit(1)), "one", rollup=False), *scoring.METRICS).drop("one")


@query(errors_sql(f"SELECT bucket, count(*) AS n, {_RATES} FROM e GROUP BY bucket"))
def report_by_bucket(spark, sf):
    return _rounded(scoring.pooled(counted(spark, sf), rollup=False), *scoring.METRICS)


@query(errors_sql(f"SELECT bucket, count(*) AS n, {_RATES} FROM e GROUP BY GROUPING SETS ((bucket), ())"))
def report_rollup(spark, sf):
    return _rounded(scoring.report(pairs(spark, sf), bucket="bucket"), *scoring.METRICS)


_TURNS_SQL = """
WITH s AS (SELECT a.conv_id, a.turn, a.text AS r0, b.text AS h0 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
"""


@query(rf"""{_TURNS_SQL}, t AS (SELECT conv_id, turn, {n_("r0")} AS r, {n_("h0")} AS h FROM s)
SELECT conv_id, turn, len({w_("r")}) AS ref_words, len({w_("h")}) AS hyp_words, length(replace(r, ' ', '')) AS ref_chars FROM t""")
def turn_pair_lengths(spark, sf):
    c = table(spark, sf, "conversations")
    c = text.with_folded(c, {"f": "text"})
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("f").alias("r"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("f").alias("h"))
    r, h = (text.normalise(F.col(x), folded=True) for x in "rh")
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.size(text.tokens(r)).cast("long").alias("ref_words"), F.size(text.tokens(h)).cast("long").alias("hyp_words"), F.char_length(F.replace(r, F.lit(" "), F.lit(""))).cast("long").alias("ref_chars"))


# ---------------------------------------------------------------- filters
@query(errors_sql("SELECT doc_id, wer_length > 0 AND wer_errors / wer_length <= 0.20 AS passes FROM e"))
def wer_filter(spark, sf):
    return folded_pairs(spark, sf).select("doc_id", labels.passes_wer(F.col("r"), F.col("h"), folded=True).alias("passes"))


@query(errors_sql("SELECT doc_id FROM e WHERE coalesce(wer_errors / nullif(wer_length, 0) <= 0.20, true)"))
def label_stage_filter(spark, sf):
    wer = labels.teacher_wer(F.col("r"), F.col("h"), True)
    return folded_pairs(spark, sf).select("doc_id", wer.alias("wer")).filter(labels.kept_at_labelling(F.col("wer"))).select("doc_id")


@query(errors_sql("""SELECT count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS dropped, round(count(*) FILTER (WHERE NOT k) / count(*), 9) AS drop_rate
FROM (SELECT coalesce(wer_errors / nullif(wer_length, 0) <= 0.20, true) AS k FROM e)"""))
def label_drop_rate(spark, sf):
    kept = labels.kept_at_labelling(labels.teacher_wer(F.col("r"), F.col("h"), True))
    return _rounded(labels.drop_rate(folded_pairs(spark, sf).select(kept.alias("kept"))), "drop_rate")


_INDEX_SQL = """
i AS (
    SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL AND d.doc_id % 3 <> 0 THEN (d.doc_id % 41) / 100.0 END AS teacher_wer,
        CASE WHEN d.doc_id % 4 <> 0 THEN (d.doc_id % 37) / 10.0 END AS mean_entropy
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def _index(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    wer = F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 3 != 0), (F.col("doc_id") % 41) / 100.0)
    return d.select("doc_id", wer.alias("teacher_wer"), F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 37) / 10.0).alias("mean_entropy"))


@query(f"WITH {_INDEX_SQL} SELECT doc_id FROM i WHERE CASE WHEN teacher_wer IS NOT NULL THEN teacher_wer <= 0.2 WHEN mean_entropy IS NOT NULL THEN mean_entropy <= 2.5 ELSE true END")
def index_filtered(spark, sf):
    return labels.filtered(_index(spark, sf), 0.2, 2.5).select("doc_id")


@query(f"WITH {_INDEX_SQL} SELECT doc_id FROM i WHERE mean_entropy IS NULL OR mean_entropy <= 2.5")
def index_filtered_entropy_only(spark, sf):
    return labels.filtered(_index(spark, sf), None, 2.5).select("doc_id")


@query(f"WITH {_INDEX_SQL} SELECT count(*) FILTER (WHERE teacher_wer IS NULL AND mean_entropy IS NULL) AS unjudged, count(*) AS n FROM i")
def unjudged_count(spark, sf):
    return labels.unjudged_count(_index(spark, sf), 0.2, 2.5)


_STEPS_SQL = """
st AS (SELECT vec_id, label, list_transform(range(8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: exp(CAST(x AS DOUBLE)))) AS steps FROM embeddings),
en AS (SELECT vec_id, label, list_sum(list_transform(steps, lambda p: -list_sum(list_transform(p, lambda x: x / list_sum(p) * ln(x / list_sum(p)))))) / 8 AS entropy FROM st)"""


def _steps(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return table(spark, sf, "embeddings").select("vec_id", "label", arrays.mean_token_entropy(steps).alias("entropy"))


@query(f"WITH {_STEPS_SQL} SELECT vec_id, round(entropy, 6) AS entropy FROM en")
def token_entropy(spark, sf):
    return _rounded(_steps(spark, sf), "entropy", places=6).drop("label")


@query(f"""WITH {_STEPS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY entropy) - 1 AS i, count(*) OVER () AS n, count(*) FILTER (WHERE label % 2 = 0) OVER () AS k FROM en)
SELECT round(entropy, 6) AS threshold, round(k / n, 9) AS keep_rate, n FROM r WHERE i = greatest(0, least(n - 1, CAST(round_even(k / n * n, 0) AS BIGINT) - 1))""")
def calibrate_entropy(spark, sf):
    rows = _steps(spark, sf).withColumn("keep", F.col("label") % 2 == 0)
    return labels.calibrate_entropy(rows).select(F.round("threshold", 6).alias("threshold"), F.round("keep_rate", 9).alias("keep_rate"), "n")


# ---------------------------------------------------------------- code-mixing, audit, entities, false triggers
#: Frequent words of the test documents, in the place of the English markers.
MARKERS = ["the", "of", "and", "in", "that", "is", "to", "der", "la", "le"]
_MARKED = "[" + ", ".join(f"'{m}'" for m in MARKERS) + "]"
_DENSITY_SQL = f"""
m AS (SELECT doc_id, lang, text, {w_(n_("text"))} AS t FROM documents),
dn AS (SELECT doc_id, lang, text, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: list_contains({_MARKED}, x))) / len(t) ELSE 0 END AS density FROM m),
bk AS (SELECT *, CASE WHEN density < 0.15 THEN 'hindi_dominant' WHEN density < 0.40 THEN 'balanced' ELSE 'dense' END AS bucket FROM dn)"""


@query(f"WITH {_DENSITY_SQL} SELECT doc_id, round(density, 9) AS density FROM dn")
def code_mix_density(spark, sf):
    return folded(spark, sf).select("doc_id", F.round(text.code_mix_density(F.col("text"), MARKERS, F.col("f")), 9).alias("density"))


@query(f"WITH {_DENSITY_SQL} SELECT doc_id, bucket FROM bk")
def code_mix_bucket(spark, sf):
    return folded(spark, sf).select("doc_id", text.code_mix_bucket(text.code_mix_density(F.col("text"), MARKERS, F.col("f"))).alias("bucket"))


@query(f"WITH {_DENSITY_SQL} SELECT bucket, count(*) AS n FROM bk GROUP BY bucket")
def bucket_counts(spark, sf):
    return code_mix_bucket(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_HINGLISH = [("kal subah jaana hai", 0.0, "hindi_dominant"), ("meeting call email project deadline update", 1.0, "dense"), ("मुझे meeting में जाना है", 0.2, "balanced"), ("कल 5 बजे ।", 0.25, "balanced"), ("", 0.0, "hindi_dominant")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({d} AS DOUBLE), '{b}')" for t, d, b in _HINGLISH) + ") v(text, density, bucket)")
def code_mix_hinglish(spark, sf):
    d = spark.createDataFrame([(t,) for t, _, _ in _HINGLISH], "text string").withColumn("density", F.round(text.code_mix_density(F.col("text")), 9))
    return d.withColumn("bucket", text.code_mix_bucket(F.col("density")))


@query(f"WITH {_DENSITY_SQL} SELECT doc_id, bucket FROM bk ORDER BY CASE bucket WHEN 'dense' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END, doc_id LIMIT 50")
def audit_rank_topk(spark, sf):
    return scoring.audit_sample(table(spark, sf, "documents"), "text", "doc_id", 50, MARKERS).select("doc_id", "bucket")


@query(r"SELECT doc_id, regexp_matches(lower(text), '[a-z]') AS latin, regexp_matches(text, '[,.?!]') AS punct FROM documents")
def audit_flags(spark, sf):
    latin, punct = scoring.audit_flags(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", latin.alias("latin"), punct.alias("punct"))


@query(r"SELECT count(*) FILTER (WHERE regexp_matches(lower(text), '[a-z]')) AS latin, count(*) FILTER (WHERE regexp_matches(text, '[,.?!]')) AS punct, count(*) AS n FROM documents")
def audit_counters(spark, sf):
    return audit_flags(spark, sf).agg(F.count_if("latin").alias("latin"), F.count_if("punct").alias("punct"), F.count(F.lit(1)).alias("n"))


_KINDS = "['number', 'time', 'date', 'currency', 'percent']"


@query(rf"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS toks FROM documents),
e AS (SELECT doc_id, text, unnest(range(5)) AS k, toks FROM t),
s AS (SELECT {_KINDS}[CAST(k AS INTEGER) + 1] AS type, coalesce(toks[k * 3 + 1], '') || CASE WHEN (doc_id + k) % 4 = 0 THEN 'zq' ELSE '' END AS surface, text FROM e),
h AS (SELECT type, {n_("surface", False)} AS a, {n_("text", False)} AS b FROM s)
SELECT type, CAST(count(*) FILTER (WHERE a <> '' AND contains(b, a)) AS BIGINT) AS hits, count(*) AS total, round(count(*) FILTER (WHERE a <> '' AND contains(b, a)) / count(*), 9) AS accuracy
FROM h GROUP BY GROUPING SETS ((type), ())""")
def entity_score(spark, sf):
    toks = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    one = lambda k, kind: F.struct(F.lit(kind).alias("type"), F.concat(F.coalesce(F.get("toks", F.lit(3 * k)), F.lit("")), F.when((F.col("doc_id") + k) % 4 == 0, "zq").otherwise("")).alias("surface"))
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("hypothesis"), toks.alias("toks"))
    return _rounded(scoring.entity_scores(d.select("hypothesis", F.array(*[one(k, t) for k, t in enumerate(scoring.ENTITY_TYPES)]).alias("entities"))), "accuracy")


@query(r"""WITH t AS (SELECT role AS condition, CASE WHEN (conv_id + turn) % 5 = 0 THEN '  a ' WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE text END AS text FROM conversations)
SELECT condition, CAST(count(*) FILTER (WHERE length(trim(coalesce(text, ''))) >= 3) AS BIGINT) AS triggered, count(*) AS n, round(count(*) FILTER (WHERE length(trim(coalesce(text, ''))) >= 3) / count(*), 9) AS rate
FROM t GROUP BY GROUPING SETS ((condition), ())""")
def false_trigger_rate(spark, sf):
    c, at = table(spark, sf, "conversations"), F.col("conv_id") + F.col("turn")
    out = c.select(F.col("role").alias("condition"), F.when(at % 5 == 0, "  a ").when(at % 7 == 0, None).otherwise(F.col("text")).alias("text"))
    return _rounded(scoring.false_triggers(out), "rate")


# ---------------------------------------------------------------- profiles
_RANKED = "(SELECT event_type AS source, value / 10 AS d, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"
_PCT = ", ".join(f"round(max(d) FILTER (WHERE i = CAST(round_even({q} * (n - 1), 0) AS BIGINT)), 6) AS {name}" for name, q in profile.LEVELS.items())


def _durations(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("source"), (F.col("value") / 10).alias("duration_s"))


@query(f"SELECT source, {_PCT} FROM {_RANKED} GROUP BY source")
def profile_percentiles(spark, sf):
    return _rounded(profile.nearest_ranks(_durations(spark, sf), "duration_s", ["source"], profile.LEVELS), *profile.LEVELS, places=6)


@query(f"SELECT source, count(*) AS n, round(sum(d) / 3600, 6) AS hours, round(avg(d), 6) AS mean, round(count(*) FILTER (WHERE d > 10) / count(*) * 100, 6) AS over_pct, {_PCT} FROM {_RANKED} GROUP BY source")
def profile_durations(spark, sf):
    return _rounded(profile.durations_profile(_durations(spark, sf), "duration_s", ["source"]), "hours", "mean", "over_pct", *profile.LEVELS, places=6)


@query("SELECT event_type AS source, round(count(*) FILTER (WHERE value / 10 > 10) / count(*), 9) AS share FROM events WHERE value IS NOT NULL GROUP BY event_type")
def over_threshold_share(spark, sf):
    return _durations(spark, sf).filter("duration_s is not null").groupBy("source").agg(F.round(F.count_if(F.col("duration_s") > 10) / F.count(F.lit(1)), 9).alias("share"))


_FLAGS_SQL = rf"""
f AS (SELECT lang, trim(text) = '' AS empty, regexp_matches(text, '[A-Za-z]') AS latin, contains(text, '।') AS danda, contains(text, ',') AS comma,
    len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, density, bucket FROM bk),
fr AS (SELECT lang, words, row_number() OVER (PARTITION BY lang ORDER BY words) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f WHERE NOT empty),
md AS (SELECT lang, max(words) FILTER (WHERE i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS median_words FROM fr GROUP BY lang),
pr AS (SELECT lang, count(*) FILTER (WHERE empty) AS empty, count(*) FILTER (WHERE latin) / greatest(count(*) FILTER (WHERE NOT empty), 1) * 100 AS latin_pct, count(*) FILTER (WHERE danda) AS danda,
    count(*) FILTER (WHERE comma) AS comma, avg(density) FILTER (WHERE NOT empty) AS mean_density, count(*) FILTER (WHERE bucket = 'dense' AND NOT empty) AS dense FROM f GROUP BY lang)"""


@query(f"WITH {_DENSITY_SQL}, {_FLAGS_SQL} SELECT lang, empty, round(latin_pct, 6) AS latin_pct, danda, comma, round(mean_density, 6) AS mean_density, dense, CAST(median_words AS BIGINT) AS median_words FROM pr JOIN md USING (lang)")
def profile_flags(spark, sf):
    p = profile.transcripts_profile(table(spark, sf, "documents"), "text", ["lang"], MARKERS)
    return p.select("lang", "empty", F.round("latin_pct", 6).alias("latin_pct"), "danda", "comma", F.round("mean_density", 6).alias("mean_density"), F.coalesce(F.try_element_at("buckets", F.lit("dense")), F.lit(0)).cast("long").alias("dense"), F.col("median_words").cast("long").alias("median_words"))


@query(f"""WITH r AS (SELECT source, max(d) FILTER (WHERE i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS median FROM {_RANKED} GROUP BY source)
SELECT source, CASE WHEN median < 3 THEN 'short' WHEN median > 8 THEN 'near_ceiling' ELSE 'good' END AS win, CASE WHEN length(source) % 2 = 0 THEN 'monolingual' ELSE 'code_mixed' END AS mixing FROM r""")
def profile_readout(spark, sf):
    p = profile.nearest_ranks(_durations(spark, sf), "duration_s", ["source"], {"median": 0.5})
    win, mixing = profile.read_out(F.col("median"), F.when(F.char_length("source") % 2 == 0, 4.9).otherwise(5.0))
    return p.select("source", win.alias("win"), mixing.alias("mixing"))


@query("""SELECT count(value) AS clips, round(sum(value / 10) / 3600, 6) AS hours, round(avg(value / 10), 6) AS mean_s,
CASE WHEN avg(value / 10) < 4.0 THEN 'too_fragmented' WHEN avg(value / 10) > 9.5 THEN 'mostly_at_ceiling' ELSE 'ok' END AS verdict FROM events""")
def acquisition_report(spark, sf):
    return _rounded(profile.acquisition_report(_durations(spark, sf)), "hours", "mean_s", places=6)


# ---------------------------------------------------------------- window cost
_CAND = "(SELECT unnest([4.0, 6.0, 8.0, 10.0]::DOUBLE[]) AS w)"


def _cost_sql(rows: str) -> str:
    """rows: (d, wt)."""
    return f"""SELECT w AS window_s, round(1 - sum(wt * least(d, w)) / (sum(wt) * w), 6) AS padding, round(sum(CASE WHEN d > w THEN wt ELSE 0 END) / sum(wt), 6) AS cut,
round((sum(wt * d) - sum(wt * least(d, w))) / sum(wt * d), 6) AS lost, round(w / 10, 6) AS compute, round((1 - (sum(wt * d) - sum(wt * least(d, w))) / sum(wt * d)) / (w / 10), 6) AS speech_per_compute
FROM {rows} r CROSS JOIN {_CAND} c GROUP BY w"""


def _seg_sql(rows: str) -> str:
    n = lambda w: f"(floor(d / {w}) + CASE WHEN d - {w} * floor(d / {w}) >= 1.0 THEN 1 ELSE 0 END)"
    gone = "CASE WHEN d - w * floor(d / w) >= 1.0 THEN 0 ELSE d - w * floor(d / w) END"
    return f"""SELECT w AS window_s, round(1 - (sum(wt * d) - sum(wt * {gone})) / (sum(wt * {n("w")}) * w), 6) AS padding, round(sum(wt * {gone}) / sum(wt * d), 6) AS dropped,
round(sum(wt * {n("w")}) / sum(wt), 6) AS windows_per_clip, round(sum(wt * {n("w")}) * w / (sum(wt * {n("10.0")}) * 10), 6) AS compute FROM {rows} r CROSS JOIN {_CAND} c GROUP BY w"""


_WC = ("padding", "cut", "lost", "compute", "speech_per_compute")
_SC = ("padding", "dropped", "windows_per_clip", "compute")


@query(_cost_sql("(SELECT l_quantity AS d, 1.0 AS wt FROM lineitem)"))
def window_cost_query(spark, sf):
    return _rounded(window_cost.window_cost(table(spark, sf, "lineitem"), duration="l_quantity"), *_WC, places=6)


@query(_seg_sql("(SELECT l_quantity AS d, 1.0 AS wt FROM lineitem)"))
def segmented_cost_query(spark, sf):
    return _rounded(window_cost.segmented_cost(table(spark, sf, "lineitem"), duration="l_quantity"), *_SC, places=6)


_HOURS_SQL = "hr AS (SELECT event_type AS source, 10.0 * length(event_type) AS hours FROM events WHERE value IS NOT NULL GROUP BY event_type)"
_MIX_SQL = f"""WITH {_HOURS_SQL}, ev AS (SELECT event_type AS source, value / 10 AS d FROM events WHERE value IS NOT NULL), pc AS (SELECT source, count(*) AS n, avg(d) AS mean_s FROM ev GROUP BY source),
cw AS (SELECT source, n, mean_s, hours * 3600 / mean_s AS clip_weight FROM pc JOIN hr USING (source)), mx AS (SELECT d, clip_weight / n AS wt FROM ev JOIN cw USING (source)) """


def _mix(spark, sf):
    rows = _durations(spark, sf).filter("duration_s is not null")
    return rows, rows.select("source").distinct().withColumn("hours", 10.0 * F.char_length("source"))


@query(_MIX_SQL + _cost_sql("mx"))
def mixed_cost(spark, sf):
    return _rounded(window_cost.window_cost(window_cost.weighted(*_mix(spark, sf)), weight="weight"), *_WC, places=6)


@query(_MIX_SQL + _seg_sql("mx"))
def mixed_segmented_cost(spark, sf):
    return _rounded(window_cost.segmented_cost(window_cost.weighted(*_mix(spark, sf)), weight="weight"), *_SC, places=6)


@query(_MIX_SQL + "SELECT source, n AS clips, round(mean_s, 6) AS mean_s, round(clip_weight, 3) AS clip_weight, round(clip_weight / sum(clip_weight) OVER (), 6) AS step_share FROM cw")
def step_share(spark, sf):
    s = window_cost.step_weights(*_mix(spark, sf))
    return s.select("source", "clips", F.round("mean_s", 6).alias("mean_s"), F.round("clip_weight", 3).alias("clip_weight"), F.round("step_share", 6).alias("step_share"))


#: Two published profiles, as (dataset, hours, p10, p25, median, p75, p90, max, share over ten seconds in percent).
PROFILES = [("a", 120.0, 1.71, 2.13, 2.60, 3.79, 6.35, 14.61, 2.0), ("b", 50.0, 0.638, 1.502, 3.517, 7.82, 14.107, 28.917, 19.75)]
_PROFILES_SQL = (
    "WITH pf(source, hours, p10, p25, median, p75, p90, max, over) AS (VALUES " + ", ".join(f"('{s}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in r) + ")" for s, *r in PROFILES) + """),
pt AS (SELECT source, hours, unnest([{'p': 0.10::DOUBLE, 'v': p10}, {'p': 0.25, 'v': p25}, {'p': 0.5, 'v': median}, {'p': 0.75, 'v': p75}, {'p': 0.9, 'v': p90}, {'p': 1.0, 'v': max}, {'p': 1.0 - over / 100, 'v': 10.0}]) AS q FROM pf),
lo AS (SELECT source, hours, q.p AS p, q.v AS v FROM pt UNION ALL SELECT source, hours, 0.0, greatest(0.0, p10 - (p25 - p10) / 0.15 * 0.10) FROM pf),
sg AS (SELECT source, hours, p AS p0, v AS v0, lead(p) OVER w AS p1, lead(v) OVER w AS v1 FROM lo WINDOW w AS (PARTITION BY source ORDER BY p)),
sm AS (SELECT source, hours, i, v0 + (v1 - v0) * ((i + 0.5) / 2000 - p0) / (p1 - p0) AS d FROM sg JOIN (SELECT unnest(range(2000)) AS i) g ON (i + 0.5) / 2000 > p0 AND (i + 0.5) / 2000 <= p1),
cw AS (SELECT source, count(*) AS n, avg(d) AS mean_s, any_value(hours) * 3600 / avg(d) AS clip_weight FROM sm GROUP BY source), mx AS (SELECT d, clip_weight / n AS wt FROM sm JOIN cw USING (source)) """
)


def _profiled(spark):
    cols = "source string, hours double, p10 double, p25 double, median double, p75 double, p90 double, max double, over double"
    p = spark.createDataFrame(PROFILES, cols)
    d = F.struct("p10", "p25", "median", "p75", "p90", "max")
    return p.withColumn("profile", F.struct(d.alias("duration_s"), F.col("over").alias("clips_over_10s_pct")))


def _sampled(spark):
    p = _profiled(spark)
    return p.select("source", F.explode(window_cost.quantile_samples(window_cost.quantile_table(F.col("profile")))).alias("duration_s")), p.select("source", "hours")


@query(_PROFILES_SQL + "SELECT source, CAST(i AS BIGINT) AS i, round(d, 9) AS d FROM sm")
def quantile_samples(spark, sf):
    return _profiled(spark).select("source", F.posexplode(window_cost.quantile_samples(window_cost.quantile_table(F.col("profile")))).alias("i", "d")).select("source", F.col("i").cast("long").alias("i"), F.round("d", 9).alias("d"))


@query(_PROFILES_SQL + _cost_sql("mx"))
def profile_mixed_cost(spark, sf):
    return _rounded(window_cost.window_cost(window_cost.weighted(*_sampled(spark)), weight="weight"), *_WC, places=6)


@query(_PROFILES_SQL + _seg_sql("mx"))
def profile_mixed_segmented_cost(spark, sf):
    return _rounded(window_cost.segmented_cost(window_cost.weighted(*_sampled(spark)), weight="weight"), *_SC, places=6)


# ---------------------------------------------------------------- intervals
_REGIONS = "SELECT user_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) AS b, event_id FROM events WHERE value IS NOT NULL"
#: In milliseconds, so that both engines add integers: at most a million, at least a hundred thousand, gaps up to an hour.
_BOUNDS = {"max_seconds": 150_000.0, "min_seconds": 5_000.0, "max_gap_s": 3_600_000.0}
_MERGE_SQL = f"""
WITH RECURSIVE r0 AS ({_REGIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS i FROM r0 WHERE b > a),
fold AS (
    SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ca, CAST(NULL AS BIGINT) AS cb, CAST([] AS BIGINT[][]) AS outs FROM (SELECT DISTINCT user_id FROM r)
    UNION ALL
    SELECT f.user_id, r.i, CASE WHEN r.b - r.a > 150000 THEN NULL WHEN f.ca IS NOT NULL AND r.a - f.cb <= 3600000 AND r.b - f.ca <= 150000 THEN f.ca ELSE r.a END,
        CASE WHEN r.b - r.a > 150000 THEN NULL ELSE r.b END,
        CASE WHEN r.b - r.a > 150000 THEN list_concat(CASE WHEN f.ca IS NULL THEN f.outs ELSE list_append(f.outs, [f.ca, f.cb]) END,
                list_transform(range(CAST(ceil((r.b - r.a) / 150000.0) AS BIGINT)), lambda k: [r.a + k * 150000, least(r.a + (k + 1) * 150000, r.b)]))
            WHEN f.ca IS NULL OR (r.a - f.cb <= 3600000 AND r.b - f.ca <= 150000) THEN f.outs ELSE list_append(f.outs, [f.ca, f.cb]) END
    FROM fold f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1
), last AS (SELECT user_id, CASE WHEN ca IS NULL THEN outs ELSE list_append(outs, [ca, cb]) END AS outs FROM fold f WHERE i = (SELECT max(i) FROM r WHERE r.user_id = f.user_id)),
clips AS (SELECT user_id, unnest(outs) AS c FROM last), kept AS (SELECT user_id, c[1] AS a, c[2] AS b FROM clips WHERE c[2] - c[1] >= 5000)
"""


def _clips(spark, sf):
    start = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1000)
    r = table(spark, sf, "events").filter("value is not null").select("user_id", "event_id", start.alias("a"), (start + F.round(F.col("value") * 1000).cast("long")).alias("b"))
    regions = F.transform(F.array_sort(F.collect_list(F.struct("a", "event_id", "b"))), lambda x: F.struct(x.a.cast("double").alias("start_s"), x.b.cast("double").alias("end_s")))
    return intervals.clips_of(r.groupBy("user_id").agg(regions.alias("regions")), "user_id", **_BOUNDS)


@query(_MERGE_SQL + "SELECT user_id, a, b FROM kept")
def merge_to_window(spark, sf):
    return _clips(spark, sf).select("user_id", F.col("start_s").cast("long").alias("a"), F.col("end_s").cast("long").alias("b"))


@query(_MERGE_SQL + "SELECT count(*) AS clips, CAST(sum(b - a) AS BIGINT) AS total_ms, CAST(max(b - a) AS BIGINT) AS longest, CAST(min(b - a) AS BIGINT) AS shortest FROM kept")
def merge_stats(spark, sf):
    ms = F.col("duration_s").cast("long")
    return _clips(spark, sf).agg(F.count(F.lit(1)).alias("clips"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest"), F.min(ms).alias("shortest"))


@query("WITH c AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id, CAST(before AS BIGINT) AS before FROM c WHERE before < 1000000")
def cumulative_stop(spark, sf):
    return intervals.until_total(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000).select("doc_id", F.col("before").cast("long").alias("before"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("parent_row"))
    return intervals.not_done(table(spark, sf, "documents").select("doc_id"), done, "doc_id")


@query("SELECT count(DISTINCT doc_id) AS parents, CAST(sum(quality) AS DOUBLE) AS kept_s, count(*) AS clips FROM labels")
def resume_progress(spark, sf):
    return intervals.progress(table(spark, sf, "labels").select(F.col("doc_id").alias("parent_row"), F.col("quality").cast("double").alias("duration_s")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) WHERE i > 100")
def skip_rows(spark, sf):
    return intervals.skip(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 400")
def take_rows(spark, sf):
    return intervals.take(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 400)


@query("SELECT event_id, printf('ev_hi_%06d_%02d', event_id, event_id % 7) AS clip_id FROM events")
def clip_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", intervals.clip_id("ev_hi", F.col("event_id"), F.col("event_id") % 7).alias("clip_id"))


# ---------------------------------------------------------------- schema discovery
@query(r"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE lang END AS transcript, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS text FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(transcript, '')) <> '' THEN 'transcript' WHEN trim(coalesce(text, '')) <> '' THEN 'text' ELSE 'transcript' END AS key,
coalesce(nullif(trim(transcript), ''), nullif(trim(text), ''), '') AS value FROM v""")
def find_transcript_key_rows(spark, sf):
    i = F.col("doc_id")
    v = table(spark, sf, "documents").select("doc_id", F.when(i % 3 == 0, None).when(i % 3 == 1, "  ").otherwise(F.col("lang")).alias("transcript"), F.when(i % 5 == 0, "").otherwise(F.col("source")).alias("text"))
    names = ["transcript", "text"]
    return v.select("doc_id", schema.transcript_key_of_row(names).alias("key"), schema.transcript_of_row(names).alias("value"))


# ---------------------------------------------------------------- packing
_MEL_SQL = "ml AS (SELECT vec_id, list_transform(range(8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: CAST(x AS DOUBLE))) AS mel, embedding FROM embeddings)"


def _mels(spark, sf):
    mel = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    ids = F.transform(F.slice("embedding", 1, 5), lambda x: F.floor(x * 10).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("clip_id"), mel.alias("mel"), ids.alias("token_ids"))


@query(f"""WITH {_MEL_SQL}, fl AS (SELECT vec_id, mel, list_max(flatten(mel)) - 2.0 AS fl FROM ml)
SELECT vec_id, round(fl, 6) AS floor, round(list_sum(flatten(list_transform(mel, lambda r: list_concat(r, list_transform(range(4), lambda i: fl))))), 4) AS total, CAST(12 AS INTEGER) AS width FROM fl""")
def floor_and_pad(spark, sf):
    padded = arrays.pad_features(F.col("mel"), 12)
    return _mels(spark, sf).select("vec_id", F.round(arrays.feature_floor(F.col("mel")), 6).alias("floor"), F.round(arrays.total(F.flatten(padded)), 4).alias("total"), F.size(F.get(padded, 7)).alias("width"))


_PER = pack.clips_per_shard(20_000, 8, 12, 7)


@query(f"WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT vec_id, CAST(i // {_PER} AS INTEGER) AS shard, CAST(i % {_PER} AS INTEGER) AS row FROM r")
def shard_assign(spark, sf):
    return pack.assign_shards(table(spark, sf, "embeddings").select("vec_id"), "vec_id", _PER).select("vec_id", "shard", "row")


@query(f"WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT CAST(i // {_PER} AS INTEGER) AS shard, count(*) AS clips FROM r GROUP BY 1")
def shard_stats(spark, sf):
    return pack.shard_sizes(pack.assign_shards(table(spark, sf, "embeddings").select("vec_id"), "vec_id", _PER))


@query(f"""WITH {_MEL_SQL}, r AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: CAST(floor(CAST(x AS DOUBLE) * 10) AS INTEGER)) AS ids, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM ml)
SELECT vec_id, CAST(i // {_PER} AS INTEGER) AS shard, CAST(i % {_PER} AS INTEGER) AS row, CAST(8 AS INTEGER) AS n_frames, CAST(5 AS INTEGER) AS n_tokens, array_to_string(list_concat(ids, [-100, -100]), ',') AS tokens FROM r""")
def pack_clips(spark, sf):
    p = pack.pack(_mels(spark, sf).withColumn("token_ids", F.transform(F.slice("token_ids", 1, 5), lambda x: x)), "vec_id", 8, 12, 7, 20_000)
    return p.select("vec_id", "shard", "row", "n_frames", "n_tokens", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_concat(t, list_transform(range(6 - len(t)), lambda i: -100)), ',') AS tokens FROM (SELECT doc_id, list_transform(range(doc_id % 7), lambda i: CAST(i AS INTEGER)) AS t FROM documents)")
def token_pad(spark, sf):
    ids = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < F.col("doc_id") % 7)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(arrays.pad_tokens(ids, 6), lambda x: x.cast("string")), ",").alias("tokens"))


@query("SELECT event_id, CAST(least(1000, round_even(value, 0)) AS INTEGER) AS frames FROM events WHERE value IS NOT NULL")
def speech_frames(spark, sf):
    return table(spark, sf, "events").filter("value is not null").select("event_id", arrays.speech_frames(F.col("value"), 1000, 1).alias("frames"))


# ---------------------------------------------------------------- vocabulary and losses
#: Token ids of the test documents: lengths of words, spread by the word's first byte.
_IDS_SQL = r"""tk AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''), lambda t: CAST(length(t) * 7 + ascii(t) % 7 AS BIGINT)) AS ids FROM documents),
ct AS (SELECT token_id, count(*) AS cnt FROM (SELECT unnest(ids) AS token_id FROM tk) GROUP BY token_id)"""
_KEEP_SQL = _IDS_SQL + ", vo AS (SELECT token_id FROM ((SELECT token_id FROM ct WHERE token_id NOT IN (0, 1) ORDER BY cnt DESC, token_id LIMIT 38) UNION ALL SELECT unnest([0, 1])) x), mp AS (SELECT token_id AS old_id, row_number() OVER (ORDER BY token_id) - 1 AS new_id FROM vo)"


def _ids(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return table(spark, sf, "documents").select("doc_id", F.transform(words, lambda t: (F.char_length(t) * 7 + F.ascii(t) % 7).cast("long")).alias("token_ids"))


@query(f"WITH {_IDS_SQL} SELECT token_id, cnt FROM ct")
def token_counts(spark, sf):
    return vocabulary.token_counts(_ids(spark, sf))


def _kept(spark, sf):
    return vocabulary.select_vocabulary(token_counts(spark, sf), 40, [0, 1])


@query(f"WITH {_KEEP_SQL} SELECT token_id FROM vo")
def select_vocabulary(spark, sf):
    return _kept(spark, sf)


@query(f"WITH {_KEEP_SQL} SELECT old_id, new_id FROM mp")
def vocabulary_map(spark, sf):
    return vocabulary.id_map(_kept(spark, sf))


@query(f"""WITH {_KEEP_SQL}, ex AS (SELECT doc_id, unnest(ids) AS old_id FROM tk), sm AS (SELECT doc_id, CAST(sum(coalesce(new_id, -1)) AS BIGINT) AS total, count(*) AS n FROM ex LEFT JOIN mp USING (old_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN ids IS NOT NULL THEN coalesce(total, 0) END AS total, CASE WHEN ids IS NOT NULL THEN coalesce(n, 0) END AS n FROM tk LEFT JOIN sm USING (doc_id)""")
def remap_labels(spark, sf):
    new = vocabulary.remap(_ids(spark, sf), vocabulary.id_map(_kept(spark, sf)), "doc_id")
    return new.select("doc_id", F.aggregate("token_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("long").alias("n"))


@query(f"WITH {_KEEP_SQL} SELECT token_id, cnt FROM ct WHERE token_id NOT IN (SELECT token_id FROM vo)")
def oov_labels(spark, sf):
    return vocabulary.outside_vocabulary(_ids(spark, sf), vocabulary.id_map(_kept(spark, sf)))


@query(f"WITH {_KEEP_SQL} SELECT new_id AS row_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings JOIN mp ON vec_id = old_id")
def prune_embedding_rows(spark, sf):
    p = vocabulary.prune_rows(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id"), vocabulary.id_map(_kept(spark, sf)))
    return p.select("row_id", "label", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


_LSM = "list_transform({x}, lambda z: z - (list_max({x}) + ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x})))))))"
_PAIR_SQL = "lp AS (SELECT t.vec_id, t.label, list_transform(t.embedding, lambda x: CAST(x AS DOUBLE)) AS t, list_transform(s.embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings t JOIN embeddings s ON s.vec_id = t.vec_id + 1)"


def _logits(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").alias("teacher")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("student")), "vec_id")


@query(f"""WITH {_PAIR_SQL}, h AS (SELECT list_transform(range(32), lambda i: t[2 * i + 1] / 2) AS t, list_transform(s[1:32], lambda x: x / 2) AS s FROM lp), l AS (SELECT {_LSM.format(x="t")} AS t, {_LSM.format(x="s")} AS s FROM h)
SELECT round(sum(list_sum(list_transform(range(1, 33), lambda i: exp(t[i]) * (t[i] - s[i])))) / count(*) * 4, 6) AS kl, count(*) AS n FROM l""")
def restricted_kl(spark, sf):
    rows = _logits(spark, sf).withColumn("student", F.slice("student", 1, 32))
    return _rounded(vocabulary.restricted_kl(rows, list(range(0, 64, 2))), "kl", places=6)


@query(f"""WITH {_PAIR_SQL}, k AS (SELECT s, list_slice(list_reverse_sort(list_transform(range(64), lambda i: {{'value': t[i + 1], 'minus': -i}})), 1, 16) AS e FROM lp),
g AS (SELECT list_transform(s[1:32], lambda x: x / 2) AS s, list_filter(e, lambda z: z.minus % 2 = 0) AS e FROM k), m AS (SELECT {_LSM.format(x="s")} AS s, e, list_transform(e, lambda z: z.value / 2) AS t FROM g WHERE len(e) > 0),
l AS (SELECT s, e, {_LSM.format(x="t")} AS t FROM m)
SELECT round(sum(list_sum(list_transform(range(1, len(e) + 1), lambda i: exp(t[i]) * (t[i] - s[CAST(-e[i].minus // 2 + 1 AS BIGINT)])))) / count(*) * 4, 6) AS kl, count(*) AS n FROM l""")
def topk_kl(spark, sf):
    """Even teacher ids are kept, as student ids of half their value."""
    top = F.transform(arrays.top_entries(F.col("teacher"), 16), lambda e: F.struct(e.value.alias("value"), F.when(e["id"] % 2 == 0, (e["id"] / 2).cast("int")).otherwise(-1).alias("id")))
    return _rounded(vocabulary.topk_kl(_logits(spark, sf).select(top.alias("topk"), F.slice("student", 1, 32).alias("student"))), "kl", places=6)


@query(f"WITH {_PAIR_SQL}, c AS (SELECT label, {_LSM.format(x='s')} AS l FROM lp WHERE vec_id % 5 <> 0) SELECT round(avg(-l[label + 1]), 6) AS ce, count(*) AS n FROM c")
def cross_entropy(spark, sf):
    label = F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label"))
    return _rounded(vocabulary.mean_cross_entropy(_logits(spark, sf).select(F.col("student").alias("logits"), label.alias("label"))), "ce", places=6)


@query(f"WITH {_PAIR_SQL}, c AS (SELECT label, {_LSM.format(x='s')} AS l FROM lp) SELECT round(avg(-l[label + 1] * 0.9 - list_sum(l) / 64 * 0.1), 6) AS ce, count(*) AS n FROM c")
def cross_entropy_smoothed(spark, sf):
    return _rounded(vocabulary.mean_cross_entropy(_logits(spark, sf).select(F.col("student").alias("logits"), "label"), smoothing=0.1), "ce", places=6)


@query("SELECT vec_id, round(list_sum(list_transform(list_slice(list_reverse_sort(embedding), 1, 16), lambda x: CAST(x AS DOUBLE))), 4) AS top16 FROM embeddings")
def step_topk(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.total(F.transform(arrays.top_values(F.col("embedding"), 16), lambda x: x.cast("double"))), 4).alias("top16"))


# ---------------------------------------------------------------- waves
@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[33] AS DOUBLE)) / 2, 6) AS first, round((CAST(embedding[32] AS DOUBLE) + CAST(embedding[64] AS DOUBLE)) / 2, 6) AS last FROM embeddings")
def mono_mix(spark, sf):
    two = F.array(*[F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double")) for a in (1, 33)])
    m = arrays.to_mono(two)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(m, 0), 6).alias("first"), F.round(F.element_at(m, -1), 6).alias("last"))


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, e, unnest(range(128)) AS i FROM w),
x AS (SELECT vec_id, e, i, i * (63 / 127.0::DOUBLE) AS z FROM p), y AS (SELECT vec_id, e[least(CAST(floor(z) AS INTEGER), 63) + 1] AS a, e[least(CAST(floor(z) AS INTEGER) + 1, 63) + 1] AS b, z - least(CAST(floor(z) AS INTEGER), 63) AS f FROM x)
SELECT vec_id, round(sum(a + (b - a) * f), 4) AS total, count(*) AS n FROM y GROUP BY vec_id""")
def resample_wave(spark, sf):
    w = arrays.resample(F.transform("embedding", lambda x: x.cast("double")), 8_000, 16_000)
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.total(w), 4).alias("total"), F.size(w).cast("long").alias("n"))


# ---------------------------------------------------------------- inverse text normalisation
#: Spoken and written forms.
SPOKEN = [
    ("saade chaar baje call karna", "4:30 baje call karna"),
    ("sawa paanch baje nikalna hai", "5:15 baje nikalna hai"),
    ("paune paanch baje pahunchna", "4:45 baje pahunchna"),
    ("chaar bajkar bees minute par alarm", "4:20 baje par alarm"),
    ("shaam saat baje dinner", "7 pm baje dinner"),
    ("do hazaar bees mein hua tha", "2020 mein hua tha"),
    ("teen sau paanch rupaye", "₹305"),
    ("bees percent discount", "20% discount"),
    ("pandrah August ko chhutti hai", "15 August ko chhutti hai"),
    ("paune ek baje", "12:45 baje"),
    ("chaar log aaye the", "4 log aaye the"),
    ("chaar baje.", "4 baje."),
    ("bees percent!", "20%!"),
    ("चार बजे मीटिंग", "4 baje मीटिंग"),
    ("४ बजे", "4 baje"),
    ("do sau hazaar", "1200"),
    ("ek do teen", "6"),
    ("20, percent", "20%"),
    ("yahan kuchh nahin", "yahan kuchh nahin"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPOKEN) + ") v(spoken, written)")
def itn_golden(spark, sf):
    return spark.createDataFrame([(a,) for a, _ in SPOKEN], "spoken string").withColumn("written", itn.inverse_normalise(F.col("spoken")))


@query()
def itn_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", itn.inverse_normalise(F.col("text")).alias("written"))


# ---------------------------------------------------------------- grids
@query("""WITH g AS (SELECT a, b FROM (SELECT unnest(range(1, 40)) AS a) CROSS JOIN (SELECT unnest(range(1, 40)) AS b) WHERE b <= a)
SELECT CAST(a AS INTEGER) AS n_from, CAST(b AS INTEGER) AS n_to, CASE WHEN b = 1 THEN '0' ELSE array_to_string(list_transform(range(b), lambda i: CAST(round_even(i * (a - 1) / (b - 1), 0) AS INTEGER)), ',') END AS places FROM g""")
def max_spaced_indices(spark, sf):
    grid = [(a, b) for a in range(1, 40) for b in range(1, a + 1)]
    places = arrays.spaced_indices(F.col("n_from"), F.col("n_to"))
    return spark.createDataFrame(grid, "n_from int, n_to int").select("n_from", "n_to", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


_PROBES = [(float(d), s, float(m), g) for d in range(0, 130, 3) for s in (1, 2) for m in (15, 27) for g in (1, 2)]


@query("""WITH p AS (SELECT CAST(d AS DOUBLE) AS delta, CAST(s AS INTEGER) AS sessions, CAST(m AS DOUBLE) AS minutes, CAST(g AS INTEGER) AS gpus FROM (SELECT unnest(range(0, 130, 3)) AS d) CROSS JOIN (SELECT unnest([1, 2]) AS s) CROSS JOIN (SELECT unnest([15, 27]) AS m) CROSS JOIN (SELECT unnest([1, 2]) AS g)),
w AS (SELECT *, sessions * minutes AS wall, sessions * minutes * gpus AS per FROM p),
b AS (SELECT *, CASE WHEN abs(delta - (wall + per) / 2) <= (wall + per) / 2 * 0.35::DOUBLE * 0.5 OR delta < wall * (1 - 0.35::DOUBLE) OR delta > per * (1 + 0.35::DOUBLE) THEN 'ambiguous' WHEN delta < (wall + per) / 2 THEN 'wall_clock' ELSE 'per_gpu' END AS billing FROM w)
SELECT delta, sessions, minutes, gpus, billing, round(CASE WHEN billing = 'wall_clock' THEN 108.0 / gpus ELSE 108.0 END, 6)::DOUBLE AS quota_hours, round(CASE WHEN billing = 'wall_clock' THEN 108.0 / gpus ELSE 108.0 END / 30, 6)::DOUBLE AS weeks FROM b""")
def quota_verdict(spark, sf):
    p = spark.createDataFrame(_PROBES, "delta double, sessions int, minutes double, gpus int").withColumn("session_minutes", F.lit(None).cast("array<double>"))
    return _rounded(quota.verdicts(p), "quota_hours", "weeks", places=6).select("delta", "sessions", "minutes", "gpus", "billing", "quota_hours", "weeks")


@query("""SELECT CAST(d AS DOUBLE) AS delta, CAST(s AS INTEGER) AS sessions, CAST(g AS INTEGER) AS gpus, CAST(d AS DOUBLE) AS if_wall_clock, round(d / g, 6) AS if_per_gpu, round(d / g / s, 6) AS each_per_gpu
FROM (SELECT unnest(range(0, 130, 6)) AS d) CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) CROSS JOIN (SELECT unnest([1, 2]) AS g)""")
def implied_runtimes(spark, sf):
    p = spark.createDataFrame([(float(d), s, g) for d in range(0, 130, 6) for s in (1, 2, 3) for g in (1, 2)], "delta double, sessions int, gpus int")
    return _rounded(quota.implied_runtimes(p), "if_per_gpu", "each_per_gpu", places=6).select("delta", "sessions", "gpus", "if_wall_clock", "if_per_gpu", "each_per_gpu")


# ---------------------------------------------------------------- streams
@query(errors_sql(f"SELECT bucket, count(*) AS n, {_RATES} FROM e GROUP BY bucket"))
def streaming_report(spark, sf):
    """Pooled rates of a stream of pairs over the table's files, into a memory sink; the batch form is report_by_bucket."""
    from ..streaming.reports import streaming_report as run

    return _rounded(_streamed(run(_dealt(_pairs(_stream(spark, sf, "documents"))), "bucket"), "streaming_report_out", "complete"), *scoring.METRICS)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stream over just this table, by the directory it lies in."""
    at = f"{sf}/{name}.parquet"
    one = not _is_dir(spark, at)
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet" if one else "*.parquet").parquet(sf if one else at)


def _streamed(rows: DataFrame, name: str, mode: str) -> DataFrame:
    spark, name = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"  # a run of its own, also beside another one
    sink = rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
