"""Filters of pseudo-labels and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, word_errors
from .pack import numbered_ranges


def above(value: Column, limit: float) -> Column:
    """value > limit where a NaN is not above anything."""
    return (value > limit) & ~F.isnan(value.cast("double"))


def passes_wer(reference: Column, label: Column, threshold: float = 0.20, folded: bool = False) -> Column:
    """Normalised word error rate at most ``threshold``; a reference without words cannot vouch for a label."""
    e = word_errors(reference, label, False, folded)
    return let(e, lambda x: F.when(x.length == 0, False).otherwise(x.errors / x.length <= threshold))


def teacher_wer(reference: Column, label: Column, folded: bool = False) -> Column:
    """The rate, or null where the reference has no words."""
    e = word_errors(reference, label, False, folded)
    return let(e, lambda x: F.when(x.length > 0, x.errors / x.length))


def kept_at_labelling(wer: Column, limit: float = 0.20) -> Column:
    """The labelling stage drops what is above the limit and keeps what has no rate."""
    return let(wer, lambda w: F.coalesce(~above(w, limit), F.lit(True)))


def judged(wer: Column, entropy: Column, max_wer: float | None, max_entropy: float | None) -> tuple[Column, Column]:
    """(kept, unjudged) of an index row: by rate where it has one and a limit is given, else by entropy likewise, else it passes unjudged."""
    by_wer = wer.isNotNull() & F.lit(max_wer is not None)
    by_entropy = ~by_wer & entropy.isNotNull() & F.lit(max_entropy is not None)
    kept = F.when(by_wer, ~above(wer, max_wer if max_wer is not None else 0.0)).when(by_entropy, ~above(entropy, max_entropy if max_entropy is not None else 0.0)).otherwise(True)
    return kept, ~by_wer & ~by_entropy


def filtered(index: DataFrame, max_wer: float | None = None, max_entropy: float | None = None) -> DataFrame:
    """Index rows that pass; limits reach the scan as predicates on two columns."""
    return index.filter(judged(F.col("teacher_wer"), F.col("mean_entropy"), max_wer, max_entropy)[0])


def unjudged_count(index: DataFrame, max_wer: float | None = None, max_entropy: float | None = None) -> DataFrame:
    return index.agg(F.count_if(judged(F.col("teacher_wer"), F.col("mean_entropy"), max_wer, max_entropy)[1]).alias("unjudged"), F.count(F.lit(1)).alias("n"))


def calibrate_entropy(rows: DataFrame, entropy: str = "entropy", keep: str = "keep") -> DataFrame:
    """(threshold, keep_rate, n): the entropy at which as many are kept as the flags keep. Counts of distinct entropies replace a sort of all rows."""
    counted = rows.groupBy(entropy).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(keep)).alias("k"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(keep)).alias("kept"))
    place = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.rint(F.col("kept") / F.col("n") * F.col("n")).cast("long") - 1))
    target = whole.select("n", "kept", place.alias("place"))
    # running counts by ranges of the value, so that no task holds all values
    spread = numbered_ranges(counted, entropy).withColumnRenamed("__p", "p")
    shifts = spread.groupBy("p").agg(F.sum("c").alias("s"))
    shifts = shifts.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inside = spread.withColumn("past", F.sum("c").over(Window.partitionBy("p").orderBy(entropy)))
    ranked = inside.join(F.broadcast(shifts), "p").withColumn("past", F.col("past") + F.col("shift"))
    hit = ranked.join(F.broadcast(target), (F.col("past") > F.col("place")) & (F.col("past") - F.col("c") <= F.col("place")))
    return hit.select(F.col(entropy).alias("threshold"), (F.col("kept") / F.col("n")).alias("keep_rate"), "n")


def drop_rate(flags: DataFrame, kept: str = "kept") -> DataFrame:
    return flags.agg(F.count_if(F.col(kept)).alias("kept"), F.count_if(~F.col(kept)).alias("dropped"), (F.count_if(~F.col(kept)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("drop_rate"))
