import io
import random
import wave

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaksetu.config import DEFAULT
from vaksetu.functions import arrays
from vaksetu.operators import intervals, labels, pack, profile, quota, schema, vocabulary, window_cost
from vaksetu.sources import audio, manifests

REGIONS = "rec long, regions array<struct<start_s:double,end_s:double>>"


def merged(spark, regions, **kw):
    d = spark.createDataFrame([(1, regions)], REGIONS)
    return [tuple(c) for c in d.select(intervals.merge_to_window(F.col("regions"), **kw).alias("c")).first().c]


def plain_merge(regions, top=10.0, least=1.0, gap=0.6):
    done, now = [], None
    for a, b in sorted(regions, key=lambda r: r[0]):
        if b <= a:
            continue
        if b - a > top:
            done += [now] if now else []
            now = None
            while a < b:
                done.append((a, min(a + top, b)))
                a += top
        elif now and a - now[1] <= gap and b - now[0] <= top:
            now = (now[0], b)
        else:
            done += [now] if now else []
            now = (a, b)
    return [c for c in [*done, *([now] if now else [])] if c[1] - c[0] >= least]


def test_merge_goldens(spark):
    assert [b - a for a, b in merged(spark, [(0.0, 25.0)])] == [10, 10, 5]
    assert merged(spark, [(0.0, 0.3), (5.0, 5.2)]) == []
    assert len(merged(spark, [(8.0, 10.0), (0.0, 2.0)])) == 2
    assert merged(spark, [(0.0, 5.0), (1.0, 2.0)]) == [(0.0, 2.0)]  # a nested region shortens the clip


def test_merge_random(spark):
    rng = random.Random(5)
    rows = [(i, [(a := rng.randrange(0, 60_000) / 1.0, a + rng.choice([0, 300, 1500, 9000, 24_000]) / 1.0) for _ in range(rng.randrange(0, 12))]) for i in range(120)]
    got = intervals.clips_of(spark.createDataFrame(rows, REGIONS), "rec", max_seconds=10_000, min_seconds=1000, max_gap_s=600).collect()
    want = {(i, *c) for i, r in rows for c in plain_merge(r, 10_000.0, 1000.0, 600.0)}
    assert {(r.rec, r.start_s, r.end_s) for r in got} == want


def test_until_total(spark):
    d = spark.createDataFrame([(i, 3) for i in range(200_000, 200_020)], "pos long, s int")
    assert intervals.until_total(d, "pos", "s", 10).count() == 4


def test_windows(spark):
    def seg(*d):
        return window_cost.segmented_cost(spark.createDataFrame([(x,) for x in d], "duration_s double"), [10.0]).first()

    r = window_cost.window_cost(spark.createDataFrame([(20.0,)], "duration_s double"), [10.0]).first()
    assert (r.padding, r.cut, r.lost) == (0, 1, 0.5)
    assert seg(25.0).windows_per_clip == 3 and seg(25.0).padding == pytest.approx(1 - 25 / 30)
    assert seg(20.5).windows_per_clip == 2 and seg(20.5).dropped == pytest.approx(0.5 / 20.5)
    assert seg(0.5).windows_per_clip == 0 and seg(0.5).dropped == 1


def test_published_profile_costs(spark):
    from vaksetu.plans import queries

    got = {r.window_s: r for r in queries.QUERIES["profile_mixed_segmented_cost"](spark, "").collect()}
    for w, want in {4.0: (0.2629, 0.0160, 1.3313, 0.5195), 10.0: (0.6129, 0.0054, 1.0250, 1.0)}.items():
        assert (got[w].padding, got[w].dropped, got[w].windows_per_clip, got[w].compute) == pytest.approx(want, abs=6e-5)


def test_nearest_rank(spark):
    d = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double").withColumn("g", F.lit(1))
    assert profile.nearest_ranks(d, "v", ["g"], {"m": 0.5}).first().m == 3.0


def test_pack_round_trip(spark, tmp_path):
    a = DEFAULT.audio
    assert (a.n_frames(), a.n_positions(), a.cache_bytes(72_000)) == (1000, 500, 11_520_000_000)
    rows = [(f"c{i}", [[0.75] * 3] * 2, [1, 2], 0.05 * i) for i in range(7)]
    clips = spark.createDataFrame(rows, "clip_id string, mel array<array<double>>, token_ids array<int>, teacher_wer double").withColumn("mean_entropy", F.lit(None).cast("double"))
    packed = pack.pack(clips, "clip_id", 2, 5, 4, target_bytes=100)
    manifests.write_shards(packed, str(tmp_path / "s"))
    back = manifests.open_shards(spark, str(tmp_path / "s"))
    assert back.select("shard").distinct().count() > 1
    r = back.filter("clip_id = 'c0'").first()
    assert list(r.mel[0]) == [0.75, 0.75, 0.75, -1.25, -1.25] and list(r.token_ids) == [1, 2, -100, -100] and (r.n_frames, r.n_tokens) == (3, 2)
    assert labels.filtered(manifests.read_index(spark, str(tmp_path / "s")), 0.20).count() == 5
    with pytest.raises(Exception, match="frames"):
        pack.pack(clips, "clip_id", 2, 2, 4, 100).collect()
    with pytest.raises(FileNotFoundError):
        manifests.open_shards(spark, str(tmp_path / "none"))


def test_manifest_tolerates_a_torn_line(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"clip_id":"a","parent_row":1,"duration_s":2.0}\n{"clip_id":"b","par')
    m = manifests.read_manifest(spark, str(tmp_path))
    assert intervals.progress(m).first().clips == 1
    assert intervals.not_done(spark.range(3).withColumnRenamed("id", "row"), m, "row").count() == 2


def test_audio(spark):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[1000, 3000]] * 80, "<i2").tobytes())
    d = spark.createDataFrame([(1, bytearray(buf.getvalue())), (2, bytearray(b"bad")), (3, None)], "id long, b binary")
    got = {r.id: r for r in audio.decode_wav(d, "id", "b").collect()}
    assert len(got[1].wave) == 160 and got[1].wave[0] == pytest.approx(2000 / 32768, abs=1e-6)
    assert got[2].wave is None and got[2].error and got[3].error
    assert audio.mono(np.zeros((2, 9))).shape == audio.mono(np.zeros((9, 2))).shape == (9,)
    assert {k: len(v) for k, v in audio.probe_waves(0.1, 2).items()} == {"digital_silence": 2, "room_tone": 2, "fan_noise": 2, "mains_hum": 2}
    s = spark.createDataFrame([(([0.1], 16000),)], "audio struct<array:array<double>,sampling_rate:int>")
    assert s.select(audio.decode_path(s, "audio").alias("p")).first().p == "dict_array"


def test_probe_transcription(spark):
    out = audio.transcribe_probe(spark, lambda x: "noise!" if abs(x).max() > 0 else "", audio.probe_waves(0.05, 1))
    assert {r.condition: r.text for r in out.collect()}["digital_silence"] == ""


def test_schema_discovery(spark):
    d = spark.createDataFrame([("", "spoken", (None, None))], "transcript string, text string, sound struct<bytes:binary,path:string>")
    assert schema.transcript_key(d) == "text" and schema.audio_key(d) == "sound"
    with pytest.raises(KeyError):
        schema.require_columns(d, ["gone"])
    paths = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-10",), ("o/x",)], "path string")
    assert schema.latest_checkpoint(paths).first().path == "o/checkpoint-10"


def test_vocabulary(spark):
    counts = spark.createDataFrame([(10, 5), (11, 99), (12, 1), (13, 50)], "token_id int, cnt long")
    kept = vocabulary.select_vocabulary(counts, 4, [0, 1])
    assert sorted(r.token_id for r in kept.collect()) == [0, 1, 11, 13]
    with pytest.raises(ValueError):
        vocabulary.select_vocabulary(counts, 1, [0, 1])
    mapping = vocabulary.id_map(kept)
    lab = spark.createDataFrame([(1, [11, -100, 0])], "k int, token_ids array<int>")
    assert list(vocabulary.remap(lab, mapping, "k").first().token_ids) == [2, -100, 0]
    vocabulary.require_vocabulary(lab, mapping)
    with pytest.raises(ValueError):
        vocabulary.require_vocabulary(spark.createDataFrame([(1, [12])], "k int, token_ids array<int>"), mapping)


def test_losses(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 3.0])], "teacher array<double>, student array<double>")
    assert vocabulary.restricted_kl(d, [0, 2]).first().kl == pytest.approx(0, abs=1e-12)
    top = spark.createDataFrame([([(1.0, 0), (9.0, -1)], [5.0, 5.0]), ([(9.0, -1)], [5.0, 5.0])], "topk array<struct<value:double,id:int>>, student array<double>")
    r = vocabulary.topk_kl(top).first()
    assert r.n == 1 and r.kl == pytest.approx(np.log(2) * 4)
    with pytest.raises(Exception, match="beyond the vocabulary"):
        vocabulary.mean_cross_entropy(spark.createDataFrame([([1.0], 5)], "logits array<double>, label int")).collect()


def test_spacing(spark):
    at = lambda a, b: list(spark.range(1).select(arrays.spaced_indices(F.lit(a), F.lit(b)).alias("x")).first().x)
    assert at(12, 4) == [0, 4, 7, 11] and at(32, 2) == [0, 31] and at(5, 1) == [0]


def test_quota(spark):
    def verdict(delta, minutes):
        d = spark.createDataFrame([(float(delta), None, None, 2, [float(m) for m in minutes])], "delta double, sessions int, minutes double, gpus int, session_minutes array<double>")
        r = quota.verdicts(d).first()
        return r.billing, round(r.quota_hours, 6)

    assert verdict(30, [15, 15]) == ("wall_clock", 54.0) and verdict(60, [15, 15]) == ("per_gpu", 108.0)
    assert [verdict(x, [15, 15])[0] for x in (45, 3, 300, 33, 66)] == ["ambiguous", "ambiguous", "ambiguous", "wall_clock", "per_gpu"]
    assert verdict(54, [15, 12])[0] == "per_gpu" and verdict(54, [27, 27])[0] == "wall_clock"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_distance_is_a_metric(spark, a, b):
    from vaksetu.functions.text import edit_distance

    x, y = (F.lit(",".join(map(str, v))) for v in (a, b))
    f = lambda p, q: edit_distance(*(F.filter(F.split(v, ","), lambda t: t != "") for v in (p, q)))
    r = spark.range(1).select(f(x, y).alias("d"), f(y, x).alias("e"), f(x, x).alias("z")).first()
    assert r.d == r.e and r.z == 0 and abs(len(a) - len(b)) <= r.d <= max(len(a), len(b))
