"""What an input window costs: padding, cuts, losses and compute, over measured or reconstructed durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: The baseline window and the candidates.
BASELINE_S = 10.0
CANDIDATES = (4.0, 6.0, 8.0, 10.0)


def quantile_table(profile: Column) -> Column:
    """array<struct<p, v>> of a profile's percentiles, with the measured share over ten seconds as one more point unless its level is taken."""
    d = profile["duration_s"]
    known = F.array(*[F.struct(F.lit(p).alias("p"), d[n].cast("double").alias("v")) for n, p in (("p10", 0.10), ("p25", 0.25), ("median", 0.50), ("p75", 0.75), ("p90", 0.90), ("max", 1.00))])
    share = profile["clips_over_10s_pct"].cast("double")
    p = F.lit(1.0) - share / 100
    extra = share.between(0, 100) & ~F.exists(known, lambda q: q.p == p)
    return F.when(extra, F.concat(known, F.array(F.struct(p.alias("p"), F.lit(BASELINE_S).alias("v"))))).otherwise(known)


def quantile_samples(table: Column, n: int = 2000) -> Column:
    """array<double>: the piecewise-linear inverse distribution at (i + 0.5) / n.

    Below the first point it goes on with the first slope, not under zero; beyond the last it stays.
    """
    def of(pts: Column) -> Column:
        spans = F.zip_with(F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts)), lambda x, y: F.struct(x.p.alias("p0"), x.v.alias("v0"), y.p.alias("p1"), y.v.alias("v1")))
        return let(F.struct(spans.alias("spans"), F.element_at(pts, -1).v.alias("last")), lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(s, (i + 0.5) / n)))

    def value(s: Column, p: Column) -> Column:
        hit = F.get(F.filter(s.spans, lambda x: p <= x.p1), 0)
        inside = lambda x: F.when(x.p1 - x.p0 <= 0, x.v0).otherwise(x.v0 + (x.v1 - x.v0) * (p - x.p0) / (x.p1 - x.p0))
        return let(hit, lambda x: F.when(x.isNull(), s.last).otherwise(inside(x)))

    def with_zero(pts: Column) -> Column:
        a, b = F.get(pts, 0), F.coalesce(F.get(pts, 1), F.get(pts, 0))
        slope = F.when(b.p > a.p, (b.v - a.v) / (b.p - a.p)).otherwise(0.0)
        zero = F.struct(F.lit(0.0).alias("p"), F.greatest(F.lit(0.0), a.v - slope * a.p).alias("v"))
        return F.when(a.p > 0, F.concat(F.array(zero), pts)).otherwise(pts)

    pts = F.array_sort(F.transform(table, lambda q: F.struct(q.p.alias("p"), q.v.alias("v"))))
    return F.when(F.size(table) == 0, F.raise_error(F.lit("no quantiles given")).cast("array<double>")).otherwise(let(let(pts, with_zero), of))


def step_weights(durations: DataFrame, hours: DataFrame, source: str = "source", duration: str = "duration_s") -> DataFrame:
    """(source, clips, mean_s, clip_weight, step_share, weight): a source's weight is its clip count for its target hours, shared by its clips.

    One partial aggregation; a row for each source.
    """
    per = durations.groupBy(source).agg(F.count(F.lit(1)).alias("clips"), F.avg(duration).alias("mean_s")).join(F.broadcast(hours), source)
    per = per.withColumn("clip_weight", F.col("hours") * 3600 / F.col("mean_s"))
    total = per.agg(F.sum("clip_weight").alias("all_weight"))
    return per.join(F.broadcast(total)).select(source, "clips", "mean_s", "clip_weight", (F.col("clip_weight") / F.col("all_weight")).alias("step_share"), (F.col("clip_weight") / F.col("clips")).alias("weight"))


def weighted(durations: DataFrame, hours: DataFrame, source: str = "source", duration: str = "duration_s") -> DataFrame:
    """(duration_s, weight) of a source mix; the sources are few and broadcast."""
    w = step_weights(durations, hours, source, duration).select(source, "weight")
    return durations.join(F.broadcast(w), source).select(F.col(duration).alias("duration_s"), "weight")


def _candidates(rows: DataFrame, candidates) -> DataFrame:
    bad = [w for w in candidates if w <= 0]
    if bad:
        raise ValueError("a window must be longer than zero")
    return rows.withColumn("window_s", F.explode(F.array(*[F.lit(float(w)) for w in candidates])))


def _of(rows: DataFrame, duration: str, weight: str | None) -> DataFrame:
    # equal durations are added up first: rows of the cost are distinct durations
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.select(F.col(duration).cast("double").alias("d"), w.cast("double").alias("w")).groupBy("d").agg(F.sum("w").alias("w"))


def window_cost(rows: DataFrame, candidates=CANDIDATES, duration: str = "duration_s", weight: str | None = None, baseline_s: float = BASELINE_S) -> DataFrame:
    """(window_s, padding, cut, lost, compute, speech_per_compute) if clips are truncated to the window."""
    d, w, win = F.col("d"), F.col("w"), F.col("window_s")
    sums = _candidates(_of(rows, duration, weight), candidates).groupBy("window_s").agg(
        F.sum("w").alias("all"), F.sum(w * F.least(d, win)).alias("kept"), F.sum(w * d).alias("speech"), F.sum(F.when(d > win, w).otherwise(0.0)).alias("over")
    )
    lost = F.when(F.col("speech") != 0, (F.col("speech") - F.col("kept")) / F.col("speech")).otherwise(0.0)
    compute = win / baseline_s
    return sums.select(
        "window_s",
        (1 - F.col("kept") / (F.col("all") * win)).alias("padding"),
        (F.col("over") / F.col("all")).alias("cut"),
        lost.alias("lost"),
        compute.alias("compute"),
        F.when(compute > 0, (1 - lost) / compute).otherwise(0.0).alias("speech_per_compute"),
    )


def emitted(duration: Column, window: Column, min_seconds: float) -> tuple[Column, Column]:
    """(windows, speech dropped) of one clip that is split: a rest of at least ``min_seconds`` gets a window, a shorter one is dropped."""
    full = F.floor(duration / window)
    rest = duration - window * full
    return full + (rest >= min_seconds).cast("int"), F.when(rest >= min_seconds, 0.0).otherwise(rest)


def segmented_cost(rows: DataFrame, candidates=CANDIDATES, duration: str = "duration_s", weight: str | None = None, min_seconds: float = 1.0, baseline_s: float = BASELINE_S) -> DataFrame:
    """(window_s, padding, dropped, windows_per_clip, compute) if long clips are split into windows."""
    d, w, win = F.col("d"), F.col("w"), F.col("window_s")
    n, gone = emitted(d, win, min_seconds)
    base, _ = emitted(d, F.lit(float(baseline_s)), min_seconds)
    sums = _candidates(_of(rows, duration, weight), candidates).groupBy("window_s").agg(
        F.sum("w").alias("all"), F.sum(w * n).alias("windows"), F.sum(w * gone).alias("gone"), F.sum(w * d).alias("speech"), F.sum(w * base).alias("base")
    )
    room = F.col("windows") * win
    return sums.select(
        "window_s",
        F.when(room > 0, 1 - (F.col("speech") - F.col("gone")) / room).otherwise(1.0).alias("padding"),
        F.when(F.col("speech") != 0, F.col("gone") / F.col("speech")).otherwise(0.0).alias("dropped"),
        (F.col("windows") / F.col("all")).alias("windows_per_clip"),
        F.when(F.col("base") > 0, room / (F.col("base") * baseline_s)).otherwise(0.0).alias("compute"),
    )


def declared(profiles: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles with their source's hours, sources without a profile); a profile of no declared source raises. Profiles' dataset is ``id:config:split``."""
    named = profiles.withColumn("source", F.substring_index("dataset", ":", 1))
    unknown = [r.source for r in named.join(F.broadcast(sources), "source", "left_anti").select("source").limit(8).collect()]
    if unknown:
        raise ValueError(f"not declared as sources: {unknown}")
    return named.join(F.broadcast(sources), "source"), sources.join(named, "source", "left_anti")
