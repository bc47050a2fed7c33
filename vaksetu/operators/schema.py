"""Discovery of a corpus's columns at run time, on schemas and first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidate names, in the order of preference.
TRANSCRIPT_NAMES = ("transcript", "text", "sentence", "transcription", "normalized_text", "verbatim", "raw_text")
AUDIO_NAMES = ("audio", "audio_filepath", "wav", "speech")


def transcript_key(df: DataFrame, names=TRANSCRIPT_NAMES) -> str | None:
    """The first candidate whose value in the first row is not blank, else the first that exists, else None."""
    there = [n for n in names if n in df.columns]
    if not there:
        return None
    row = df.select(*there).first()
    full = [n for n in there if row is not None and isinstance(row[n], str) and row[n].strip()]
    return (full or there)[0]


def transcript_key_of_row(names: list[str]) -> Column:
    """Each row's own key: the first candidate that is not blank in it, else the first."""
    out = F.lit(names[0])
    for n in reversed(names):
        out = F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) != "", F.lit(n)).otherwise(out)
    return out


def transcript_of_row(names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names], F.lit(""))


def audio_key(df: DataFrame, names=AUDIO_NAMES) -> str | None:
    """A column of a known name, else the first struct with array, bytes or path."""
    for n in names:
        if n in df.columns:
            return n
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and {"array", "bytes", "path"} & set(f.dataType.names):
            return f.name
    return None


def describe(df: DataFrame) -> DataFrame:
    """(column, type) of a schema."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")


def describe_row(df: DataFrame) -> DataFrame:
    """(column, type, role) of a schema; the role is audio, text or other."""
    roles = {transcript_key(df): "text", audio_key(df): "audio"}
    return describe(df).withColumn("role", F.coalesce(*[F.when(F.col("column") == k, r) for k, r in roles.items() if k], F.lit("other")))


def require_columns(df: DataFrame, names: list[str]) -> None:
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise KeyError(f"columns {lost} are missing; there are {df.columns}")


def require_same_tokens(a: list[int], b: list[int]) -> None:
    if list(a) != list(b):
        raise ValueError("the tokenizers disagree on the probe text")


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The path whose trailing number is largest."""
    return paths.agg(F.max_by(path, F.regexp_extract(path, r"checkpoint-(\d+)$", 1).try_cast("long")).alias("path"))
