"""Registered queries over what the library stores and reads back, over schemas, losses, probes and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import arrays
from ..operators import intervals, pack, profile, quota, schema, scoring, vocabulary, window_cost
from ..runtime import shared_folder
from ..sources import audio, manifests
from ..streaming import reports
from .queries import _KEEP_SQL, _LSM, _MEL_SQL, _PAIR_SQL, _PER, _ids, _kept, _logits, _mels, _rounded, _stream, _streamed, query, table


def _fresh(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- joins
@query("SELECT doc_id, length(text) AS reference_chars, length(text) + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS hypothesis_chars, doc_id % 2 <> 0 AS same FROM documents")
def paired_utterances(spark, sf):
    d = table(spark, sf, "documents")
    both = scoring.pair(d.select("doc_id", F.col("text").alias("r")), d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("h")), "doc_id")
    return both.select("doc_id", F.char_length("r").cast("long").alias("reference_chars"), F.char_length("h").cast("long").alias("hypothesis_chars"), (F.col("r") == F.col("h")).alias("same"))


@query("""SELECT n_name || ':x:train' AS dataset, CAST(n_regionkey + 1 AS DOUBLE) AS hours, true AS profiled FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT n_name, CAST(n_regionkey + 1 AS DOUBLE), false FROM nation WHERE n_nationkey % 3 = 0""")
def declared_profiles(spark, sf):
    n = table(spark, sf, "nation")
    sources = n.select(F.col("n_name").alias("source"), (F.col("n_regionkey") + 1).cast("double").alias("hours"))
    found, without = window_cost.declared(n.filter("n_nationkey % 3 <> 0").select(F.concat("n_name", F.lit(":x:train")).alias("dataset")), sources)
    return found.select("dataset", "hours", F.lit(True).alias("profiled")).unionByName(without.select(F.col("source").alias("dataset"), "hours", F.lit(False).alias("profiled")))


# ---------------------------------------------------------------- storage
@query(f"""WITH {_MEL_SQL}, r AS (SELECT vec_id, mel, list_max(flatten(mel)) - 2.0 AS fl, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM ml)
SELECT vec_id, CAST(i // {_PER} AS INTEGER) AS shard, CAST(i % {_PER} AS INTEGER) AS row, round(list_sum(flatten(mel)) + 32 * fl, 4) AS total, CAST(5 AS INTEGER) AS n_tokens FROM r WHERE vec_id % 3 = 0""")
def fetch_clips(spark, sf):
    """Clips are packed, written as shards and fetched by (shard, row) of a filtered index."""
    path = _fresh(spark, "shards")
    manifests.write_shards(pack.pack(_mels(spark, sf), "vec_id", 8, 12, 7, 20_000), path, max_files=1 << 30)
    index = manifests.read_index(spark, path).filter("vec_id % 3 = 0").select("vec_id", "shard", "row", "n_tokens")
    got = pack.fetch(index, manifests.open_shards(spark, path).select("shard", "row", "mel"))
    return got.select("vec_id", "shard", "row", F.round(arrays.total(F.flatten("mel")), 4).alias("total"), "n_tokens")


_DONE = "(event_id % 2 = 0 OR event_id % 5 = 0)"


@query(f"SELECT event_id, {_DONE} AS done, CASE WHEN {_DONE} THEN printf('ev_%06d_00', event_id) END AS clip_id, CASE WHEN {_DONE} THEN round(value, 3) END AS duration_s FROM events")
def manifest_resume(spark, sf):
    """Two runs append to a manifest; a third one sees which rows are left."""
    path = _fresh(spark, "manifest")
    e = table(spark, sf, "events")
    clips = e.select(intervals.clip_id("ev", F.col("event_id"), F.lit(0)).alias("clip_id"), F.col("value").alias("duration_s"), F.col("event_type").alias("source"), F.col("event_id").alias("parent_row"))
    for part in ("parent_row % 2 = 0", "parent_row % 2 <> 0 and parent_row % 5 = 0"):
        manifests.append_manifest(clips.filter(part), path)
    lines = manifests.read_manifest(spark, path)
    left = intervals.not_done(e.select("event_id"), lines, "event_id").select("event_id", F.lit(False).alias("done"), F.lit(None).cast("string").alias("clip_id"), F.lit(None).cast("double").alias("duration_s"))
    return left.unionByName(lines.select(F.col("parent_row").alias("event_id"), F.lit(True).alias("done"), "clip_id", "duration_s"))


_RANKS = ", ".join(f"max(d) FILTER (WHERE i = CAST(round_even({q} * (n - 1), 0) AS BIGINT)) AS {name}" for name, q in profile.LEVELS.items())


@query(rf"""WITH d AS (SELECT lang || ':x:train' AS dataset, n_chars / 100.0::DOUBLE AS d, text, CASE WHEN doc_id % 3 = 0 THEN 'dict_array' ELSE 'soundfile' END AS how FROM documents WHERE doc_id % 11 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM d)
SELECT dataset, CAST(count(*) AS INTEGER) AS n_rows, round(sum(d) / 3600, 6) AS hours, round(avg(d), 6) AS mean, round(count(*) FILTER (WHERE d > 10) / count(*) * 100, 6) AS over_pct, {_RANKS},
CAST(count(*) FILTER (WHERE trim(text) = '') AS INTEGER) AS empty, CAST(count(*) FILTER (WHERE contains(text, ',')) AS INTEGER) AS comma,
round(count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]')) / greatest(count(*) FILTER (WHERE trim(text) <> ''), 1) * 100, 6) AS latin_pct,
CAST(count(*) FILTER (WHERE how = 'dict_array') AS INTEGER) AS from_arrays, CAST(count(*) FILTER (WHERE how = 'soundfile') AS INTEGER) AS from_files FROM r GROUP BY dataset""")
def profile_document(spark, sf):
    """Whole profile documents, written as JSON and read back; rows that were not decoded do not count."""
    path, i = _fresh(spark, "profile"), F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.concat("lang", F.lit(":x:train")).alias("dataset"), F.when(i % 11 != 0, F.col("n_chars") / 100).alias("duration_s"), "text", F.when(i % 3 == 0, "dict_array").otherwise("soundfile").alias("how")
    )
    manifests.write_profile(profile.whole(rows, "dataset", "duration_s", "text", "how"), path)
    p = manifests.read_profiles(spark, path, lines=True)
    t = F.col("transcripts")
    return p.select(
        "dataset", "n_rows", F.round("hours_sampled", 6).alias("hours"), F.round("duration_s.mean", 6).alias("mean"), F.round("clips_over_10s_pct", 6).alias("over_pct"), *[F.col(f"duration_s.{x}").alias(x) for x in profile.LEVELS],
        t.empty.alias("empty"), t.comma.alias("comma"), F.round(t.latin_pct, 6).alias("latin_pct"), F.col("decode_paths.dict_array").alias("from_arrays"), F.col("decode_paths.soundfile").alias("from_files"),
    )


# ---------------------------------------------------------------- schemas and audio
@query("""SELECT column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type, CASE column_name WHEN 'text' THEN 'text' ELSE 'other' END AS role FROM (DESCRIBE documents)""")
def describe_row(spark, sf):
    return schema.describe_row(table(spark, sf, "documents"))


@query("""SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'dict_array' WHEN 3 THEN NULL ELSE 'soundfile' END AS how, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ValueError' WHEN 2 THEN 'FileNotFoundError' ELSE 'ValueError' END AS error,
CASE WHEN vec_id % 4 = 0 THEN 64 END::INTEGER AS n, CASE WHEN vec_id % 4 = 0 THEN round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 3) END AS total FROM embeddings""")
def decode_audio(spark, sf):
    """Samples, bytes that are no audio, a path that does not exist, and nothing: each has its way of decoding, and its error instead of a wave."""
    k = F.col("vec_id") % 4
    field = F.struct(
        F.when(k == 0, F.transform("embedding", lambda x: x.cast("double"))).alias("array"),
        F.lit(16_000).alias("sampling_rate"),
        F.when(k == 1, F.lit("no audio").cast("binary")).alias("bytes"),
        F.when(k == 2, F.lit("/does/not/exist.wav")).alias("path"),
    )
    got = audio.decode_audio(table(spark, sf, "embeddings").select("vec_id", field.alias("audio")), "vec_id", "audio")
    return got.select("vec_id", "how", "error", F.when(F.col("wave").isNotNull(), F.size("wave")).alias("n"), F.round(arrays.total(F.transform("wave", lambda x: F.abs(x.cast("double")))), 3).alias("total"))


@query("SELECT vec_id, CAST(vec_id % 9 AS INTEGER) AS n, round(coalesce(list_sum(list_transform(embedding[vec_id % 50 + 1 : vec_id % 50 + vec_id % 9], lambda x: CAST(x AS DOUBLE))), 0), 4) AS total FROM embeddings")
def clip_slices(spark, sf):
    start = F.col("vec_id") % 50
    wave = intervals.slice_wave(F.transform("embedding", lambda x: x.cast("double")), start, start + F.col("vec_id") % 9, 1)
    return table(spark, sf, "embeddings").select("vec_id", F.size(wave).alias("n"), F.round(arrays.total(wave), 4).alias("total"))


@query(f"WITH {_MEL_SQL} SELECT vec_id, CAST(5 AS INTEGER) AS width, round(list_sum(flatten(list_transform(mel, lambda r: r[1:5]))), 4) AS total FROM ml")
def crop_features(spark, sf):
    cut = arrays.crop_features(F.col("mel"), 5)
    return _mels(spark, sf).select("vec_id", F.size(F.get(cut, 3)).alias("width"), F.round(arrays.total(F.flatten(cut)), 4).alias("total"))


# ---------------------------------------------------------------- probes

@query("""SELECT condition, CASE condition WHEN 'fan_noise' THEN 20 WHEN 'room_tone' THEN 0 WHEN 'mains_hum' THEN 20 ELSE 0 END::BIGINT AS triggered, 20::BIGINT AS n, CASE WHEN condition IN ('fan_noise', 'mains_hum') THEN 1.0 ELSE 0.0 END::DOUBLE AS rate
FROM (SELECT unnest(['digital_silence', 'room_tone', 'fan_noise', 'mains_hum']) AS condition) UNION ALL SELECT NULL, 40, 80, 0.5""")
def probe_triggers(spark, sf):
    """A function from wave to text over the probe: it says something for loud clips only."""

    def transcribe(wave) -> str:
        return "  loud " if float((wave**2).mean()) ** 0.5 > 0.005 else " "

    return scoring.false_triggers(audio.transcribe_probe(spark, transcribe))


@query(r"""WITH t AS (SELECT role AS condition, conv_id * 1000 + turn AS clip_no, trim(text) AS text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY clip_no, text) AS place FROM t WHERE length(text) >= 3) SELECT condition, clip_no, text, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def false_trigger_examples(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("role").alias("condition"), (F.col("conv_id") * 1000 + F.col("turn")).alias("clip_no"), "text")
    return scoring.false_trigger_examples(c)


# ---------------------------------------------------------------- losses and vocabulary
def _loss_sql(kl: str) -> str:
    return f"""{kl}, c AS (SELECT label % 32 AS label, {_LSM.format(x="s[1:32]")} AS l FROM lp WHERE vec_id % 5 <> 0), ce AS (SELECT avg(-l[label + 1]) AS ce FROM c)
SELECT round(ce, 5) AS ce, round(kl, 5) AS kl, round(ce + 0.8 * kl, 5) AS loss FROM ce CROSS JOIN kl"""


def _positions(spark, sf):
    rows = _logits(spark, sf)
    return rows.withColumn("student", F.slice("student", 1, 32)).withColumn("label", F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label") % 32))


@query(_loss_sql(f"""WITH {_PAIR_SQL}, h AS (SELECT list_transform(range(32), lambda i: t[2 * i + 1] / 2) AS t, list_transform(s[1:32], lambda x: x / 2) AS s FROM lp WHERE vec_id % 5 <> 0),
l AS (SELECT {_LSM.format(x="t")} AS t, {_LSM.format(x="s")} AS s FROM h), kl AS (SELECT sum(list_sum(list_transform(range(1, 33), lambda i: exp(t[i]) * (t[i] - s[i])))) / count(*) * 4 AS kl FROM l)"""))
def distill_loss(spark, sf):
    return _rounded(vocabulary.distill(_positions(spark, sf), True, list(range(0, 64, 2)), teacher="teacher"), "ce", "kl", "loss", places=5)


@query(_loss_sql(f"""WITH {_PAIR_SQL}, k AS (SELECT s, list_slice(list_reverse_sort(list_transform(range(64), lambda i: {{'value': t[i + 1], 'minus': -i}})), 1, 16) AS e FROM lp WHERE vec_id % 5 <> 0),
g AS (SELECT list_transform(s[1:32], lambda x: x / 2) AS s, list_filter(e, lambda z: z.minus % 2 = 0) AS e FROM k), m AS (SELECT {_LSM.format(x="s")} AS s, e, list_transform(e, lambda z: z.value / 2) AS t FROM g WHERE len(e) > 0),
l AS (SELECT s, e, {_LSM.format(x="t")} AS t FROM m), kl AS (SELECT sum(list_sum(list_transform(range(1, len(e) + 1), lambda i: exp(t[i]) * (t[i] - s[CAST(-e[i].minus // 2 + 1 AS BIGINT)])))) / count(*) * 4 AS kl FROM l)"""))
def distill_loss_topk(spark, sf):
    """Stored entries under the teacher's ids, of which the even ones are kept."""
    rows = _positions(spark, sf).withColumn("topk", arrays.top_entries(F.col("teacher"), 16))
    return _rounded(vocabulary.distill(rows, True, list(range(0, 64, 2)), topk="topk", teacher_size=64), "ce", "kl", "loss", places=5)


@query(f"""WITH {_PAIR_SQL}, c AS (SELECT label % 32 AS label, {_LSM.format(x="s[1:32]")} AS l FROM lp WHERE vec_id % 5 <> 0)
SELECT round(avg(-l[label + 1]), 5) AS ce, CAST(NULL AS DOUBLE) AS kl, round(avg(-l[label + 1]), 5) AS loss FROM c""")
def distill_loss_plain(spark, sf):
    return _rounded(vocabulary.distill(_positions(spark, sf)), "ce", "loss", places=5)


@query(f"WITH {_KEEP_SQL} SELECT count(*) AS outside FROM ct WHERE token_id NOT IN (SELECT token_id FROM vo)")
def vocabulary_guard(spark, sf):
    """The kept vocabulary of its own labels lacks these; :func:`vocabulary.require_vocabulary` raises then, and does not for a vocabulary of all."""
    ids = _ids(spark, sf)
    every = vocabulary.id_map(vocabulary.token_counts(ids).select("token_id"))
    vocabulary.require_vocabulary(ids, every)
    return vocabulary.outside_vocabulary(ids, vocabulary.id_map(_kept(spark, sf))).agg(F.count(F.lit(1)).alias("outside"))


# ---------------------------------------------------------------- progress, constants, streams
@query("""WITH r AS (SELECT doc_id, n_chars, doc_id % 5 AS clips, (doc_id + 1) / 10.0::DOUBLE AS el FROM documents), t AS (SELECT doc_id AS row, sum(clips) OVER o AS clips, sum(n_chars) OVER o / 3600 AS kept_h, el AS elapsed_min FROM r WINDOW o AS (ORDER BY doc_id)),
s AS (SELECT *, kept_h / elapsed_min AS rate FROM t WHERE row % 25 = 0) SELECT row, CAST(clips AS BIGINT) AS clips, round(kept_h, 5) AS kept_h, round(elapsed_min, 5) AS elapsed_min, round(rate, 5) AS rate, round((1e8 / 3600 - kept_h) / greatest(rate, 1e-9), 4) AS eta FROM s""")
def heartbeat(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 5).alias("clips"), ((F.col("doc_id") + 1) / 10).alias("el"))
    beats = intervals.heartbeat(rows, "doc_id", "n_chars", "clips", "el", 1e8)
    return _rounded(_rounded(beats, "kept_h", "elapsed_min", "rate", places=5), "eta", places=4)


@query("SELECT max(o_orderkey) AS step, 'run/checkpoint-' || max(o_orderkey) AS path FROM orders")
def latest_checkpoint(spark, sf):
    paths = table(spark, sf, "orders").select(F.concat(F.lit("run/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path")).union(spark.createDataFrame([("run/logs",)], "path string"))
    return schema.latest_checkpoint(paths).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("step"), "path")


@query("SELECT event_id, CAST(event_id % 24 AS INTEGER) * 60 + CAST(event_id % 60 AS INTEGER) AS minutes FROM events")
def clock_minutes(spark, sf):
    clock = F.format_string("%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60)
    return table(spark, sf, "events").select("event_id", quota.minutes_of(clock).alias("minutes"))


@query("""SELECT w AS window_s, CAST(w * 100 AS INTEGER) AS frames, CAST(w * 50 AS INTEGER) AS positions FROM (SELECT unnest([4.0, 6.0, 8.0, 10.0, 30.0]::DOUBLE[]) AS w)""")
def geometry(spark, sf):
    a = DEFAULT.audio
    return spark.createDataFrame([(w, a.n_frames(w), a.n_positions(w)) for w in (4.0, 6.0, 8.0, 10.0, 30.0)], "window_s double, frames int, positions int")


@query("SELECT DISTINCT user_id FROM events")
def streaming_dedup(spark, sf):
    return _streamed(reports.deduplicated(_stream(spark, sf, "events").select("user_id"), "user_id"), "streaming_dedup_out", "append")
