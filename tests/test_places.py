"""Places of wide rows over many partitions, remapping without loss, audio of every shape."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaksetu.operators import intervals, pack, scoring, vocabulary
from vaksetu.sources import audio


def wav(samples, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_places_of_wide_rows(spark):
    """Ranges are sampled; rows and counts must speak of the same ones."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("wide "), 30).alias("w"), "id")
        got = pack.assign_shards(rows, "k", 1000)
        n, places = got.agg(F.count(F.lit(1)), F.countDistinct("shard", "row")).first()
        assert (n, places) == (300_000, 300_000)
        placed = pack.positions(rows, "k").select("k", "i").filter("i % 29999 = 0").orderBy("i").collect()
        assert [r.k for r in placed] == sorted(r.k for r in placed) and [r.i for r in placed] == list(range(0, 300_000, 29_999))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_skip_and_take(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 7, 3)], "at int")
    assert sorted(r["at"] for r in intervals.skip(rows, "at", 2).collect()) == [5, 7, 9]
    assert [r["at"] for r in intervals.take(rows, "at", 3).collect()] == [3, 3, 5]
    assert intervals.skip(rows, "at", 9).count() == intervals.take(rows, "at", 0).count() == 0


def test_remap_keeps_rows(spark):
    mapping = spark.createDataFrame([(2, 0), (5, 1)], "old_id long, new_id long")
    labels = spark.createDataFrame([(1, [2, 5, 9, -100]), (1, []), (2, None), (3, [-7, 10**12, None])], "k int, token_ids array<long>")
    got = sorted([(r.k, r.token_ids) for r in vocabulary.remap(labels, mapping, "k").collect()], key=str)
    assert got == [(1, [0, 1, -1, -100]), (1, []), (2, None), (3, [-1, -1, -1])]
    plan = vocabulary.remap(labels, mapping, "k")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert vocabulary.remap(labels, mapping.limit(0), "k").filter("k = 1 and size(token_ids) = 4").first().token_ids == [-1, -1, -1, -100]
    with pytest.raises(ValueError):
        vocabulary.remap(labels, spark.createDataFrame([(1 << 30, 0)], "old_id long, new_id long"), "k")


def test_entities_by_present(spark):
    rows = [("Call 4:30 baje", [("time", "4:30"), ("number", "")]), (None, [("date", "x")]), ("x", [])]
    d = spark.createDataFrame(rows, "hypothesis string, entities array<struct<type:string,surface:string>>")
    got = {r.type: (r.hits, r.total) for r in scoring.entity_scores(d).collect()}
    assert got == {"time": (1, 1), "number": (0, 1), "date": (0, 1), None: (1, 3)}


def test_audio_of_every_shape(spark, tmp_path):
    tone = np.sin(np.arange(800) / 9) / 2
    path = tmp_path / "a.wav"
    path.write_bytes(wav(tone))
    data = [(0, (wav(tone), None)), (1, (None, str(path))), (2, (None, None)), (3, (b"no sound", None)), (4, (wav(tone), "elsewhere.wav"))]
    got = {r.k: r for r in audio.decode_audio(spark.createDataFrame(data, "k int, audio struct<bytes:binary,path:string>"), "k", "audio", 8000).collect()}
    assert {k: r.how for k, r in got.items()} == {0: "soundfile", 1: "soundfile", 2: None, 3: "soundfile", 4: "soundfile"}
    assert {k: r.error is None for k, r in got.items()} == {0: True, 1: True, 2: False, 3: False, 4: True}
    assert got[0].wave == got[1].wave == got[4].wave and np.allclose(got[0].wave, tone, atol=1e-4)
    paths = spark.createDataFrame([(0, f"file://{path}"), (1, None)], "k int, audio string")
    got = {r.k: r for r in audio.decode_audio(paths, "k", "audio", 16_000).collect()}
    assert got[0].how == "soundfile_path" and len(got[0].wave) == 1600 and got[1].how is None and got[1].error
    arrays = spark.createDataFrame([(0, ([0.0, 1.0, 0.0], 8000)), (1, (None, None))], "k int, audio struct<array:array<double>,sampling_rate:int>")
    got = {r.k: r for r in audio.decode_audio(arrays, "k", "audio", 8000).collect()}
    assert got[0].how == "dict_array" and got[0].wave == [0.0, 1.0, 0.0] and got[1].error
    two = spark.createDataFrame([(0, ([[0.0, 1.0, 0.0], [1.0, 1.0, 0.0]], 8000))], "k int, audio struct<array:array<array<double>>,sampling_rate:int>")
    assert audio.decode_audio(two, "k", "audio", 8000).first().wave == [0.5, 1.0, 0.0]


def test_probe_clips(spark):
    assert not audio.probe_wave("digital_silence", 3, 0.1).any()
    fan, hum = audio.probe_wave("fan_noise", 0, 0.5), audio.probe_wave("mains_hum", 0, 0.5)
    assert abs(abs(fan).max() - 0.05) < 1e-4 and 0.02 < abs(hum).max() < 0.04
    assert (audio.probe_wave("room_tone", 1, 0.1) != audio.probe_wave("room_tone", 2, 0.1)).any()
    made = audio.transcribe_probe(spark, lambda x: str(round(float(abs(x).max()), 6)), per_condition=2).collect()
    assert {(r.condition, r.clip_no): r.text for r in made} == {(c, i): str(round(float(abs(audio.probe_wave(c, i)).max()), 6)) for c in audio.PROBE for i in range(2)}
