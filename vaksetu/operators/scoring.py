"""Pooled error rates, entity accuracy, false triggers, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_errors, code_mix_bucket, code_mix_density, normalise, present_in, with_folded, word_errors

METRICS = ("wer", "punctuated_wer", "cer")


def rate(errors: Column, length: Column) -> Column:
    return F.when(length > 0, errors / length).otherwise(0.0)


def pair(references: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """Join of both sides by utterance id; raises if either side has an id that the other lacks."""
    lost = references.select(key).join(hypotheses.select(key), key, "left_anti").limit(1).count()
    extra = hypotheses.select(key).join(references.select(key), key, "left_anti").limit(1).count()
    if lost or extra:
        raise ValueError("references and hypotheses do not have the same utterances")
    return references.join(hypotheses, key)


def error_counts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with (wer, punctuated_wer, cer), each struct(errors, length)."""
    # each text is normalised once, in a column of its own, before the counts that share it
    own = [f"__{side}{view}" for side in "rh" for view in ("", "w", "p", "c")]
    both = with_folded(pairs, {"__r": reference, "__h": hypothesis})
    both = both.withColumns({f"__{x}{view}": normalise(F.col(f"__{x}"), view == "w", True) for x in "rh" for view in "wp"})
    both = both.withColumns({f"__{x}c": F.replace(F.col(f"__{x}w"), F.lit(" "), F.lit("")) for x in "rh"})
    views = {"wer": ("w", word_errors), "punctuated_wer": ("p", word_errors), "cer": ("c", char_errors)}
    return both.withColumns({m: count(F.col(f"__r{v}"), F.col(f"__h{v}"), normalised=True) for m, (v, count) in views.items()}).drop(*own)


def pooled(counts: DataFrame, bucket: str = "bucket", rollup: bool = True) -> DataFrame:
    """(bucket, n, wer, punctuated_wer, cer): integers are summed, rates come last; with ``rollup`` a null bucket holds all utterances.

    One shuffle keyed by bucket, after partial sums; rates of utterances are never averaged.
    """
    sums = [F.sum(f"{m}.{part}").alias(f"{m}_{part}") for m in METRICS for part in ("errors", "length")]
    grouped = (counts.rollup(bucket) if rollup else counts.groupBy(bucket)).agg(F.count(F.lit(1)).alias("n"), *sums)
    return grouped.select(bucket, "n", *[rate(F.col(f"{m}_errors"), F.col(f"{m}_length")).alias(m) for m in METRICS])


def report(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", bucket: str | None = None, rollup: bool = True) -> DataFrame:
    """The scoring report; without a bucket column it is estimated from the reference's code-mixing."""
    if bucket is None:
        density = code_mix_density(F.col(reference), folded=F.col("__f"))
        pairs, bucket = with_folded(pairs, {"__f": reference}).withColumn("bucket", code_mix_bucket(density)).drop("__f"), "bucket"
    return pooled(error_counts(pairs, reference, hypothesis), bucket, rollup)


#: Entity types.
ENTITY_TYPES = ("number", "time", "date", "currency", "percent")


def entity_scores(utterances: DataFrame, rollup: bool = True) -> DataFrame:
    """(type, hits, total, accuracy) over columns hypothesis and entities array<struct<type, surface, ...>>; an unknown type raises."""
    # hypotheses are normalised before their entities part
    each = with_folded(utterances, {"h": "hypothesis"}).select(normalise(F.col("h"), False, True).alias("h"), "entities").select("h", F.explode("entities").alias("e"))
    each = with_folded(each.select("h", "e", F.col("e.surface").alias("surface")), {"s": "surface"})
    kind = F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise(F.raise_error(F.concat(F.lit("unknown entity type "), F.coalesce("e.type", F.lit("null")))))
    hits = each.select(kind.alias("type"), present_in(F.col("s"), F.col("h"), True).cast("long").alias("hit"))
    grouped = (hits.rollup("type") if rollup else hits.groupBy("type")).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return grouped.withColumn("accuracy", rate(F.col("hits"), F.col("total")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def false_triggers(outputs: DataFrame, condition: str = "condition", text: str = "text", least: int = 3, rollup: bool = True) -> DataFrame:
    """(condition, triggered, n, rate): outputs of at least ``least`` characters once stripped (inner spaces count)."""
    rows = outputs.select(F.col(condition).alias("condition"), (F.char_length(stripped(F.col(text))) >= least).cast("long").alias("hit"))
    grouped = (rows.rollup("condition") if rollup else rows.groupBy("condition")).agg(F.sum("hit").alias("triggered"), F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("rate", rate(F.col("triggered"), F.col("n")))


def false_trigger_examples(outputs: DataFrame, condition: str = "condition", order: str = "clip_no", text: str = "text", least: int = 3, k: int = 5) -> DataFrame:
    """The first k false triggers of each condition, a report."""
    from pyspark.sql import Window

    rows = outputs.select(F.col(condition).alias("condition"), F.col(order).alias("clip_no"), stripped(F.col(text)).alias("text")).filter(F.char_length("text") >= least)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("condition").orderBy("clip_no", "text"))).filter(F.col("place") <= k)


def audit_flags(text: Column) -> tuple[Column, Column]:
    """(a Latin letter survives, a punctuation mark survives)."""
    return F.lower(text).rlike("[a-z]"), text.rlike("[,.?!]")


def audit_sample(clips: DataFrame, text: str, position: str, k: int = 50, markers: list[str] | None = None) -> DataFrame:
    """The k clips to listen to: dense code-mixing first, then balanced, then the rest, each in corpus order."""
    bucket = code_mix_bucket(code_mix_density(F.col(text), markers, F.col("__f")))
    order = F.when(F.col("bucket") == "dense", 0).when(F.col("bucket") == "balanced", 1).otherwise(2)
    return with_folded(clips, {"__f": text}).withColumn("bucket", bucket).drop("__f").orderBy(order, position).limit(k)
