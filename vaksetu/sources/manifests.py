"""Clip manifests, profiles and shards on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "clip_id string, audio_path string, duration_s double, source string, reference string, language string, gender string, district string, parent_row bigint, parent_offset_s double"
EVALUATION = (
    "clip_id string, speaker_id string, audio_path string, duration_s double, device string, environment string, prompt_type string, reference string, "
    "reference_normalised string, code_mix_bucket string, entities array<struct<type:string,surface:string,value:string>>"
)
PROFILE = (
    "dataset string, n_rows int, hours_sampled double, duration_s struct<p10:double,p25:double,median:double,p75:double,p90:double,max:double,mean:double>, clips_over_10s_pct double, "
    "transcripts struct<empty:int,median_words:double,latin_pct:double,danda:int,comma:int,mean_code_mix_density:double,buckets:map<string,int>>, decode_paths map<string,int>"
)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """JSON lines; a torn last line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_manifest(clips: DataFrame, path: str) -> None:
    clips.withColumn("duration_s", F.round("duration_s", 3)).write.mode("append").json(path)


def stream_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """New manifest files as they arrive."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_profiles(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """Files of one document each or, with ``lines``, of one document on each line, as :func:`write_profile` leaves them."""
    return spark.read.schema(PROFILE).option("multiLine", not lines).json(list(paths))


def write_profile(profile: DataFrame, path: str) -> None:
    """One JSON document for each profile row."""
    profile.write.mode("overwrite").json(path)


def write_shards(packed: DataFrame, path: str, max_files: int = 50) -> None:
    """Packed clips by shard. A shard is one partition value; its features and its index columns share the files, so that a filter on the index reads no features."""
    packed.repartition("shard").sortWithinPartitions("row").write.mode("overwrite").partitionBy("shard").parquet(path)
    shards = packed.sparkSession.read.parquet(path).select("shard").distinct().count()
    if shards > max_files:
        import warnings

        warnings.warn(f"{shards} shards at the top level; the store takes {max_files}", stacklevel=2)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of a shard folder without features and tokens (never read from the files)."""
    return spark.read.parquet(path).drop("mel", "token_ids")


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(path) from e
        raise
