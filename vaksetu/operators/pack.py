"""Packing of features and tokens into fixed-width shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.arrays import pad_features, pad_tokens
from ..runtime import written


def clip_bytes(n_mels: int, n_frames: int, max_tokens: int) -> int:
    """Half-precision features and 32-bit tokens of one clip."""
    return n_mels * n_frames * 2 + max_tokens * 4


def clips_per_shard(target_bytes: int, n_mels: int, n_frames: int, max_tokens: int) -> int:
    """A shard is closed by the clip that reaches the target."""
    return -(-target_bytes // clip_bytes(n_mels, n_frames, max_tokens))


def check_shapes(clips: DataFrame, n_mels: int, n_frames: int, max_tokens: int) -> DataFrame:
    """The same rows; a clip with other bins, more frames or more tokens raises when it is read."""
    widest = F.array_max(F.transform("mel", lambda r: F.size(r)))
    wrong = (
        F.when(F.size("mel") != n_mels, F.format_string("clip %s has %d mel bins", "clip_id", F.size("mel")))
        .when(widest > n_frames, F.format_string("clip %s has %d frames", "clip_id", widest))
        .when(F.size("token_ids") > max_tokens, F.format_string("clip %s has %d tokens", "clip_id", F.size("token_ids")))
    )
    # part of a kept column, so that it is not pruned away
    return clips.withColumn("mel", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(clips.schema["mel"].dataType)).otherwise(F.col("mel")))


def numbered_ranges(rows: DataFrame, order: str) -> DataFrame:
    """Rows in ranges of a column with their range's number (``__p``), written once, so that counts and ranks speak of the same ranges."""
    return written(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")


def positions(rows: DataFrame, order: str, name: str = "i") -> DataFrame:
    """Adds the place of each row in the order of a column, from 0: counts of ranges first, then ranks within each, so no task numbers all rows. Nulls come first, ties in any order."""
    spread = numbered_ranges(rows, order)
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    counts = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__p").orderBy(order)
    return spread.withColumn("__r", F.row_number().over(inside) - 1).join(F.broadcast(counts), "__p").withColumn(name, F.col("__r") + F.col("__shift")).drop("__p", "__r", "__shift")


def assign_shards(rows: DataFrame, order: str, per_shard: int) -> DataFrame:
    """Adds (shard, row) by place: all clips are of one size, so shards close at a fixed count."""
    placed = positions(rows, order)
    return placed.withColumn("shard", F.floor(F.col("i") / per_shard).cast("int")).withColumn("row", (F.col("i") % per_shard).cast("int")).drop("i")


def pack(clips: DataFrame, order: str, n_mels: int | None = None, n_frames: int | None = None, max_tokens: int | None = None, target_bytes: int | None = None, pad_value: Column | None = None) -> DataFrame:
    """Checked, padded clips with their shard and row, and n_frames (speech_frames, or the width given) and n_tokens as they came."""
    a = DEFAULT.audio
    n_mels, n_frames, max_tokens = (x if x is not None else y for x, y in ((n_mels, a.n_mels), (n_frames, a.n_frames()), (max_tokens, a.max_tokens)))
    per = clips_per_shard(target_bytes if target_bytes is not None else DEFAULT.corpus.shard_bytes, n_mels, n_frames, max_tokens)
    placed = assign_shards(check_shapes(clips, n_mels, n_frames, max_tokens), order, per)
    width = F.size(F.get("mel", 0))
    frames = F.coalesce(F.col("speech_frames"), width) if "speech_frames" in clips.columns else width
    out = placed.withColumn("n_frames", frames).withColumn("n_tokens", F.size("token_ids"))
    return out.withColumn("mel", pad_features(F.col("mel"), n_frames, pad_value)).withColumn("token_ids", pad_tokens(F.col("token_ids"), max_tokens, a.pad_token))


def shard_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("clips"))


def fetch(index: DataFrame, shards: DataFrame) -> DataFrame:
    """Index rows with their stored clip: a join on (shard, row)."""
    return index.join(shards, ["shard", "row"])
