"""Merging and splitting of speech regions into bounded clips; acquisition predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pack import positions

_CLIP = "struct<start_s:double,end_s:double>"


def merge_to_window(regions: Column, max_seconds: float = 10.0, min_seconds: float = 1.0, max_gap_s: float = 0.6) -> Column:
    """array<struct<start_s, end_s>> of clips from one recording's regions, a fold in the JVM.

    Regions are taken by start (ties in their given order), empty ones left out. A region over ``max_seconds`` closes the open clip and is cut back to back. Others join
    the open clip if the gap is small enough and the whole stays within ``max_seconds``; the clip then ends where the region ends, even if that is
    earlier. Clips under ``min_seconds`` are left out at the end.
    """
    if max_seconds <= 0 or min_seconds < 0:
        raise ValueError("max_seconds must be positive and min_seconds not negative")
    top, gap = F.lit(float(max_seconds)), F.lit(float(max_gap_s))
    clip = lambda a, b: F.struct(a.alias("start_s"), b.alias("end_s"))
    ordered = F.array_sort(F.transform(regions, lambda r, i: F.struct(r.start_s.cast("double").alias("a"), i.alias("i"), r.end_s.cast("double").alias("b"))))
    ordered = F.filter(ordered, lambda r: r.b - r.a > 0)
    none = F.lit(None).cast(_CLIP)
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    closed = lambda s: F.when(s.now.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.now)))

    def cut(r: Column) -> Column:
        # starts advance by repeated addition, as a reader of the clips would have it
        n = F.ceil((r.b - r.a) / top).cast("int") + 1
        starts = F.aggregate(F.sequence(F.lit(1), n), F.array(r.a), lambda out, _: F.concat(out, F.array(F.element_at(out, -1) + top)))
        return F.transform(F.filter(starts, lambda t: t < r.b), lambda t: clip(t, F.least(t + top, r.b)))

    def step(s: Column, r: Column) -> Column:
        joins = s.now.isNotNull() & (r.a - s.now.end_s <= gap) & (r.b - s.now.start_s <= top)
        return (
            F.when(r.b - r.a > top, state(F.concat(closed(s), cut(r)), none))
            .when(joins, state(s.done, clip(s.now.start_s, r.b)))
            .otherwise(state(closed(s), clip(r.a, r.b)))
        )

    merged = F.aggregate(ordered, state(F.array().cast(f"array<{_CLIP}>"), none), step, closed)
    return F.filter(merged, lambda c: c.end_s - c.start_s >= min_seconds)


def clips_of(recordings: DataFrame, key: str, regions: str = "regions", **bounds) -> DataFrame:
    """One row for each clip: (key, clip_no, start_s, end_s, duration_s)."""
    out = recordings.select(key, F.posexplode(merge_to_window(F.col(regions), **bounds)).alias("clip_no", "c"))
    return out.select(key, "clip_no", "c.start_s", "c.end_s", (F.col("c.end_s") - F.col("c.start_s")).alias("duration_s"))


def clip_id(prefix: str, row: Column, clip_no: Column) -> Column:
    return F.format_string(f"{prefix}_%06d_%02d", row, clip_no)


def slice_wave(wave: Column, start_s: Column, end_s: Column, rate: int = 16_000) -> Column:
    a, b = (F.floor(x * rate).cast("int") for x in (start_s, end_s))
    return F.slice(wave, a + 1, F.greatest(b - a, F.lit(0)))


def running_total(rows: DataFrame, position: str, value: str, chunk: int = 1 << 16) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows with a smaller position, for integer positions.

    Sums of chunks of positions come first (one row for each chunk), so no task sees all rows: within a chunk by a partitioned window, and over
    the chunks by a window of chunk sums.
    """
    chunked = rows.withColumn("__chunk", F.floor(F.col(position) / chunk))
    sums = chunked.groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    past = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("__chunk", F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    out = chunked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(shifts, "__chunk").withColumn("before", F.col("__inside") + F.col("__shift")).drop("__chunk", "__inside", "__shift")


def heartbeat(rows: DataFrame, position: str, kept_s: str, clips: str, elapsed_min: str, target_s: float, every: int = 25) -> DataFrame:
    """(row, clips, kept_h, elapsed_min, rate, eta): progress at every so many positions; hours kept for each minute, and minutes left until ``target_s``."""
    kept = running_total(rows, position, kept_s).withColumnRenamed("before", "__kept")
    both = running_total(kept, position, clips).filter(F.col(position) % every == 0)
    total = F.col("__kept") + F.col(kept_s)
    at = both.select(F.col(position).alias("row"), (F.col("before") + F.col(clips)).alias("clips"), (total / 3600).alias("kept_h"), F.col(elapsed_min).alias("elapsed_min"), (total / 3600 / F.greatest(F.col(elapsed_min), F.lit(1e-9))).alias("rate"))
    return at.withColumn("eta", (target_s / 3600 - F.col("kept_h")) / F.greatest(F.col("rate"), F.lit(1e-9)))


def until_total(rows: DataFrame, position: str, value: str, target: float) -> DataFrame:
    """Rows as long as the total before them is under ``target``: it is passed by one row at most."""
    return running_total(rows, position, value).filter(F.col("before") < target)


def skip(rows: DataFrame, position: str, n: int) -> DataFrame:
    """Rows after the first ``n`` in the order of a column."""
    return positions(rows, position, "__at").filter(F.col("__at") >= n).drop("__at")


def take(rows: DataFrame, position: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a column: each task keeps n at most."""
    return rows.orderBy(position).limit(n)


def not_done(rows: DataFrame, manifest: DataFrame, position: str, parent: str = "parent_row") -> DataFrame:
    """Rows that no manifest line names as its parent."""
    return rows.join(manifest.select(F.col(parent).alias(position)).filter(F.col(position).isNotNull()), position, "left_anti")


def progress(manifest: DataFrame, parent: str = "parent_row", duration: str = "duration_s") -> DataFrame:
    """(parents, kept_s, clips) of a manifest."""
    return manifest.agg(F.countDistinct(parent).alias("parents"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("kept_s"), F.count(F.lit(1)).alias("clips"))
