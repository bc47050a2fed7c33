import json

from pyspark.sql import functions as F

from vaksetu.operators import quota, scoring
from vaksetu.plans import render, windows


def profile(path, name):
    d = {"p10": 1.71, "p25": 2.13, "median": 2.6, "p75": 3.79, "p90": 6.35, "max": 14.61, "mean": 3.4}
    path.write_text(json.dumps({"dataset": name, "n_rows": 400, "duration_s": d, "clips_over_10s_pct": 2.0}, indent=1))
    return str(path)


def test_windows_command(spark, tmp_path, capsys):
    assert windows.main(spark, []) == 2
    assert windows.main(spark, [profile(tmp_path / "x.json", "nobody/knows:a:train")]) == 1
    assert windows.main(spark, [profile(tmp_path / "a.json", "ai4bharat/IndicVoices:hindi:train")]) == 0
    out = capsys.readouterr().out
    assert "100.00% of steps" in out and "baseline" in out and "provisional: ARTPARK" in out


def test_rendering(spark):
    d = spark.createDataFrame([("a b", "a x", "dense"), ("c", "c", "balanced")], "reference string, hypothesis string, bucket string")
    lines = render.render_report(scoring.report(d, bucket="bucket")).splitlines()
    assert [x.split()[0] for x in lines] == ["all", "balanced", "dense"] and "33.33%" in lines[0]
    t = spark.createDataFrame([("hum", 0, "noise"), ("hum", 1, "")], "condition string, clip_no int, text string")
    assert "'noise'" in render.render_false_triggers(scoring.false_triggers(t), scoring.false_trigger_examples(t))
    p = spark.createDataFrame([(30.0, 2, 15.0, 2)], "delta double, sessions int, minutes double, gpus int").withColumn("session_minutes", F.lit(None).cast("array<double>"))
    assert "wall_clock, 54 quota hours" in render.render_verdicts(quota.verdicts(p))
