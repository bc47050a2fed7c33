"""Vocabulary selection, id remapping and restricted losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cross_entropy, kl_terms, log_softmax, select_ids
from ..functions.text import let
from .pack import positions


def token_counts(labels: DataFrame, ids: str = "token_ids", pad: int = -100) -> DataFrame:
    """(token_id, cnt) over all labels; counts are combined before the shuffle."""
    return labels.select(F.explode(ids).alias("token_id")).filter(F.col("token_id") != pad).groupBy("token_id").agg(F.count(F.lit(1)).alias("cnt"))


def select_vocabulary(counts: DataFrame, target: int, always_keep: list[int]) -> DataFrame:
    """(token_id) kept: the forced ones and the most frequent others (ties to the smaller id) up to ``target``."""
    forced = sorted(set(always_keep))
    if target < len(forced):
        raise ValueError(f"{target} places are fewer than the {len(forced)} forced tokens")
    others = counts.filter(~F.col("token_id").isin(forced)) if forced else counts
    ranked = others.orderBy(F.desc("cnt"), "token_id").limit(target - len(forced)).select("token_id")
    own = counts.sparkSession.createDataFrame([(int(t),) for t in forced], "token_id long")
    return ranked.select(F.col("token_id").cast("long").alias("token_id")).unionByName(own).distinct()


def id_map(kept: DataFrame) -> DataFrame:
    """(old_id, new_id): new ids follow the order of the old ones."""
    return positions(kept, "token_id", "new_id").select(F.col("token_id").alias("old_id"), F.col("new_id").cast("long").alias("new_id"))


#: Old ids are places in a table of new ones, so they stay below this.
MOST_IDS = 1 << 22


def remap(labels: DataFrame, mapping: DataFrame, key: str, ids: str = "token_ids", pad: int = -100) -> DataFrame:
    """(key, ids) of every label row with its ids replaced: -1 where a token was pruned, padding as it is; empty and null arrays stay so.

    The map becomes one array by old id, so nothing is exploded or shuffled; its size is that of the vocabulary, which is checked.
    """
    last = mapping.agg(F.max("old_id")).first()[0]
    last = -1 if last is None else last
    if last >= MOST_IDS:
        raise ValueError(f"id {last} lies beyond {MOST_IDS} ids of a vocabulary")
    every = mapping.sparkSession.range(last + 1).join(mapping, F.col("id") == F.col("old_id"), "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("new_id", F.lit(-1)).cast("long").alias("new"))))
    table = every.agg(F.transform(pairs, lambda p: p["new"]).alias("t")).first()["t"]  # at most MOST_IDS numbers
    table = F.lit(table) if table else F.array().cast("array<bigint>")
    at = lambda x: F.when(x == pad, F.lit(pad).cast("long")).otherwise(F.when(x.between(0, last), F.get(table, x.cast("int"))).otherwise(F.lit(-1).cast("long")))
    return labels.select(key, F.transform(ids, at).alias(ids))


def outside_vocabulary(labels: DataFrame, mapping: DataFrame, ids: str = "token_ids", pad: int = -100) -> DataFrame:
    """(token_id, cnt) of label tokens that the vocabulary lacks."""
    return token_counts(labels, ids, pad).join(F.broadcast(mapping.select(F.col("old_id").alias("token_id"))), "token_id", "left_anti")


def require_vocabulary(labels: DataFrame, mapping: DataFrame, ids: str = "token_ids") -> None:
    lost = [r.token_id for r in outside_vocabulary(labels, mapping, ids).orderBy("token_id").limit(8).collect()]
    if lost:
        raise ValueError(f"label tokens outside the vocabulary, such as {lost}")


def prune_rows(parameters: DataFrame, mapping: DataFrame, row: str = "row_id") -> DataFrame:
    """Embedding rows of kept tokens under their new ids."""
    return parameters.join(F.broadcast(mapping), parameters[row] == mapping.old_id).drop("old_id").withColumn(row, F.col("new_id")).drop("new_id")


def mean_cross_entropy(rows: DataFrame, logits: str = "logits", label: str = "label", smoothing: float = 0.0, ignore: int = -100) -> DataFrame:
    """(ce, n) over positions whose label is not ignored; a label beyond the vocabulary raises."""
    valid = rows.filter(F.col(label) != ignore)
    guard = F.when(F.col(label) >= F.size(logits), F.raise_error(F.lit("a label lies beyond the vocabulary; are labels remapped?")).cast("int")).otherwise(F.col(label).cast("int"))
    return valid.agg(F.avg(cross_entropy(F.col(logits), guard, smoothing)).alias("ce"), F.count(F.lit(1)).alias("n"))


def _masked_mean(rows: DataFrame, term: Column, mask: Column, temperature: float) -> DataFrame:
    got = rows.select(F.when(mask, term).otherwise(0.0).alias("t"), mask.cast("double").alias("m"))
    return got.agg((F.sum("t") / F.greatest(F.sum("m"), F.lit(1.0)) * temperature**2).alias("kl"), F.sum("m").cast("long").alias("n"))


def _restricted_term(keep_ids: list[int], teacher: str, student: str, temperature: float) -> Column:
    keep = F.array(*[F.lit(int(i)) for i in sorted(keep_ids)])
    wrong = (F.size(student) != len(keep_ids)) | (F.size(teacher) <= max(keep_ids))
    term = kl_terms(log_softmax(select_ids(F.col(teacher), keep), temperature), log_softmax(F.col(student), temperature))
    return F.when(wrong, F.raise_error(F.lit("kept ids and vocabularies disagree")).cast("double")).otherwise(term)


def _topk_term(entries: Column, student: str, temperature: float) -> tuple[Column, Column]:
    """(term, whether any entry is left) of entries (value, id) whose ids are the student's, negative where pruned."""
    kept = F.filter(entries, lambda e: e["id"] >= 0)
    t = log_softmax(F.transform(kept, lambda e: e["value"]), temperature)
    term = let(log_softmax(F.col(student), temperature), lambda s: kl_terms(t, F.transform(kept, lambda e: F.get(s, e["id"].cast("int")))))
    some = F.size(kept) > 0
    return F.when(some, term).otherwise(0.0), some


def restricted_kl(rows: DataFrame, keep_ids: list[int], teacher: str = "teacher", student: str = "student", temperature: float = 2.0, mask: Column | None = None) -> DataFrame:
    """(kl, n): teacher restricted to the kept ids and renormalised, against the student over the same ids, times T squared."""
    return _masked_mean(rows, _restricted_term(keep_ids, teacher, student, temperature), F.lit(True) if mask is None else mask, temperature)


def topk_kl(rows: DataFrame, entries: str = "topk", student: str = "student", temperature: float = 2.0, mask: Column | None = None) -> DataFrame:
    """(kl, n) from stored top-k teacher entries (value, id) under the student's ids, negative where pruned.

    Pruned entries are left out before the rest is renormalised; positions without any entry left do not count; entries that are not stored have no mass.
    """
    term, some = _topk_term(F.col(entries), student, temperature)
    return _masked_mean(rows, term, some if mask is None else some & mask, temperature)


def distillation_loss(ce: Column, kl: Column | None, ce_weight: float = 1.0, kl_weight: float = 0.8) -> Column:
    return ce_weight * ce if kl is None else ce_weight * ce + kl_weight * kl


def distill(
    rows: DataFrame,
    use_kl: bool = False,
    keep_ids: list[int] | None = None,
    teacher: str | None = None,
    topk: str | None = None,
    teacher_size: int | None = None,
    student: str = "student",
    label: str = "label",
    ce_weight: float = 1.0,
    kl_weight: float = 0.8,
    temperature: float = 2.0,
    smoothing: float = 0.0,
    ignore: int = -100,
) -> DataFrame:
    """(loss, ce, kl) over positions whose label is not ignored, in one aggregation; ``kl`` is null unless ``use_kl``.

    The teacher's side is a column of full logits or, else, of top-k entries (value, id) under the teacher's ids, which need ``teacher_size`` to be mapped to the student's.
    """
    if use_kl and keep_ids is None:
        raise ValueError("without kept ids, teacher and student have different vocabularies")
    if keep_ids is not None and list(keep_ids) != sorted(keep_ids):
        raise ValueError("kept ids must ascend")
    if use_kl and teacher is None and topk is None:
        raise ValueError("the teacher's logits or top-k entries are missing")
    if use_kl and teacher is None and teacher_size is None:
        raise ValueError("top-k entries need the size of the teacher's vocabulary")
    counts = F.col(label) != ignore
    guard = F.when(F.col(label) >= F.size(student), F.raise_error(F.lit("a label lies beyond the vocabulary; are labels remapped?")).cast("int")).otherwise(F.col(label).cast("int"))
    columns = [F.when(counts, cross_entropy(F.col(student), guard, smoothing)).alias("ce")]
    kl = F.lit(None).cast("double")
    if use_kl:
        if teacher is not None:
            term, mask = _restricted_term(keep_ids, teacher, student, temperature), counts
        else:
            new = {int(old): i for i, old in enumerate(keep_ids)}
            table = F.lit([new.get(i, -1) for i in range(teacher_size)])
            term, some = _topk_term(F.transform(topk, lambda e: F.struct(e["value"].alias("value"), F.get(table, e["id"].cast("int")).alias("id"))), student, temperature)
            mask = counts & some
        columns += [F.when(mask, term).otherwise(0.0).alias("t"), F.when(mask, 1.0).otherwise(0.0).alias("m")]
        kl = F.sum("t") / F.greatest(F.sum("m"), F.lit(1.0)) * temperature**2
    got = rows.select(*columns).agg(F.avg("ce").alias("ce"), kl.alias("kl"))
    return got.select(distillation_loss(F.col("ce"), F.col("kl") if use_kl else None, ce_weight, kl_weight).alias("loss"), "ce", "kl")
