"""Corpus profiles: nearest-rank percentiles, script flags and read-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_mix_bucket, code_mix_density, with_folded
from .scoring import stripped

#: Names and levels of the profile's percentiles.
LEVELS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "max": 1.0}


def nearest_ranks(rows: DataFrame, value: str, by: list[str], levels: dict[str, float]) -> DataFrame:
    """One row for each group with the value at rank round-half-even(q * (n - 1)) for each level.

    Values are counted before they are ranked, so a group's ranks come from running sums over its distinct values: one shuffle with partial counts, then a window
    whose rows are distinct values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    ranked = counted.withColumn("past", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
    place = lambda q: F.rint(F.lit(float(q)) * (F.col("n") - 1)).cast("long")
    hit = lambda q: (F.col("past") > place(q)) & (F.col("past") - F.col("c") <= place(q))
    return ranked.groupBy(*by).agg(*[F.max(F.when(hit(q), F.col(value))).alias(name) for name, q in levels.items()])


def durations_profile(rows: DataFrame, duration: str, by: list[str], over: float = 10.0) -> DataFrame:
    """(by..., n, hours, mean, p10 ... max, over_pct)."""
    sums = rows.filter(F.col(duration).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(duration) / 3600).alias("hours"),
        F.avg(duration).alias("mean"),
        (F.count_if(F.col(duration) > over) / F.count(F.lit(1)) * 100).alias("over_pct"),
    )
    return sums.join(nearest_ranks(rows, duration, by, LEVELS), by)


def transcript_flags(text: Column) -> dict[str, Column]:
    """empty, latin, danda, comma, words of a transcript (stripped first); all but ``empty`` are false or null for empty ones."""
    t = stripped(text)
    return {
        "empty": t == "",
        "latin": t.rlike("[A-Za-z]"),
        "danda": F.contains(t, F.lit("।")),
        "comma": F.contains(t, F.lit(",")),
        "words": F.when(t != "", F.size(F.split(t, "(?U)[\\s\\x1c-\\x1f]+"))),
    }


def transcripts_profile(rows: DataFrame, text: str, by: list[str], markers: list[str] | None = None) -> DataFrame:
    """(by..., empty, latin_pct, danda, comma, mean_density, buckets map, median_words)."""
    flags = transcript_flags(F.col(text))
    flagged = with_folded(rows, {"__f": text}).select(*by, *[c.alias(n) for n, c in flags.items()], code_mix_density(F.col(text), markers, F.col("__f")).alias("density"))
    flagged = flagged.withColumn("bucket", code_mix_bucket(F.col("density")))
    full = ~F.col("empty")
    named = lambda b: F.count_if(full & (F.col("bucket") == b))
    some = F.greatest(F.count_if(full), F.lit(1))
    sums = flagged.groupBy(*by).agg(
        F.count_if("empty").alias("empty"),
        (F.count_if("latin") / some * 100).alias("latin_pct"),
        F.count_if("danda").alias("danda"),
        F.count_if("comma").alias("comma"),
        (F.coalesce(F.sum(F.when(full, F.col("density"))), F.lit(0.0)) / some).alias("mean_density"),
        F.map_filter(F.create_map(*[x for b in ("hindi_dominant", "balanced", "dense") for x in (F.lit(b), named(b))]), lambda _, n: n > 0).alias("buckets"),
    )
    return sums.join(nearest_ranks(flagged, "words", by, {"median_words": 0.5}), by, "left").fillna(0, ["median_words"])


def read_out(median_s: Column, latin_pct: Column) -> tuple[Column, Column]:
    """(what the median clip says about the window, whether code-mixing is usable)."""
    return F.when(median_s < 3, "short").when(median_s > 8, "near_ceiling").otherwise("good"), F.when(latin_pct < 5, "monolingual").otherwise("code_mixed")


def acquisition_report(clips: DataFrame, duration: str = "duration_s") -> DataFrame:
    """(clips, hours, mean_s, verdict) of a manifest."""
    got = clips.agg(F.count(duration).alias("clips"), (F.coalesce(F.sum(duration), F.lit(0.0)) / 3600).alias("hours"), F.coalesce(F.avg(duration), F.lit(0.0)).alias("mean_s"))
    return got.withColumn("verdict", F.when(F.col("clips") == 0, "nothing").when(F.col("mean_s") < 4.0, "too_fragmented").when(F.col("mean_s") > 9.5, "mostly_at_ceiling").otherwise("ok"))


def whole(rows: DataFrame, dataset: str, duration: str, text: str, how: str, markers: list[str] | None = None) -> DataFrame:
    """One profile document for each dataset, as ``sources.manifests.PROFILE``; rows without a duration were not decoded and do not count."""
    rows = rows.filter(F.col(duration).isNotNull()).withColumn("dataset", F.col(dataset))
    paths = rows.groupBy("dataset", F.col(how).alias("how")).agg(F.count(F.lit(1)).cast("int").alias("k")).filter("how is not null")
    paths = paths.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("how", "k"))).alias("decode_paths"))  # a few ways to decode
    both = durations_profile(rows, duration, ["dataset"]).join(transcripts_profile(rows, text, ["dataset"], markers), "dataset").join(paths, "dataset", "left")
    return both.select(
        "dataset",
        F.col("n").cast("int").alias("n_rows"),
        F.col("hours").alias("hours_sampled"),
        F.struct(*[F.col(x).cast("double").alias(x) for x in (*LEVELS, "mean")]).alias("duration_s"),
        F.col("over_pct").alias("clips_over_10s_pct"),
        F.struct(
            F.col("empty").cast("int").alias("empty"),
            F.col("median_words").cast("double").alias("median_words"),
            "latin_pct",
            F.col("danda").cast("int").alias("danda"),
            F.col("comma").cast("int").alias("comma"),
            F.col("mean_density").alias("mean_code_mix_density"),
            F.transform_values("buckets", lambda _, n: n.cast("int")).alias("buckets"),
        ).alias("transcripts"),
        "decode_paths",
    )
