"""Decoding of audio columns to mono waves."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship


def decode_path(df: DataFrame, column: str) -> Column:
    """How a value is decoded: dict_array (samples), soundfile (bytes, or else a path, of a struct), soundfile_path (a bare path), or null; a column of another shape raises at once."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.when(F.col(column).isNotNull(), "soundfile_path")
    if not isinstance(kind, T.StructType) or not {"array", "bytes", "path"} & set(kind.names):
        raise TypeError(f"cannot decode {kind.simpleString()}")
    has = lambda *names: [F.col(f"{column}.{n}").isNotNull() for n in names if n in kind.names]
    out = F.lit(None).cast("string")
    for tag, conditions in (("soundfile", has("path", "bytes")), ("dict_array", has("array"))):
        for c in conditions:
            out = F.when(c, tag).otherwise(out)
    return out


def mono(samples: np.ndarray) -> np.ndarray:
    """Mean over channels, which lie along the shorter axis (the second if equal)."""
    if samples.ndim not in (1, 2):
        raise ValueError(f"{samples.ndim} axes of samples")
    by_channel = np.atleast_2d(samples)
    return (by_channel if len(by_channel) < by_channel.shape[1] else by_channel.T).mean(axis=0).astype(np.float32) if samples.ndim == 2 else samples.astype(np.float32)


def resampled(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    if rate_in == rate_out:
        return x
    n = round(len(x) * rate_out / rate_in)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """PCM WAV bytes of 8, 16 or 32 bits to (mono samples from -1 to 1, rate)."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
        kind, zero, top = {1: ("u1", 128, 128.0), 2: ("<i2", 0, 32768.0), 4: ("<i4", 0, 2147483648.0)}[width]
        x = ((np.frombuffer(raw, kind).astype(np.float64) - zero) / top).reshape(-1, channels)
        return (x[:, 0] if channels == 1 else x.mean(axis=1)).astype(np.float32), w.getframerate()


def read_any(source: bytes | str) -> tuple[np.ndarray, int]:
    """Bytes or a path (local, shared or a URI) to (mono samples, rate): PCM WAV, and what soundfile reads where that is installed."""
    if isinstance(source, str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(source) if "://" in source else (fs.LocalFileSystem(), source)
        with system.open_input_stream(at) as f:
            source = f.read()
    try:
        return read_wav(source)
    except (wave.Error, KeyError, EOFError):
        try:
            import soundfile
        except ImportError:
            raise ValueError("neither PCM WAV nor is soundfile installed") from None
        x, rate = soundfile.read(io.BytesIO(source), dtype="float32")
        return mono(x), rate


def decode_audio(rows: DataFrame, key: str, column: str, rate: int = 16_000) -> DataFrame:
    """(key, wave array<float>, how, error): samples, bytes and paths to mono at ``rate``; ``how`` is :func:`decode_path`. What cannot be read has its error and no wave."""
    ship(rows.sparkSession)
    how = decode_path(rows, column)
    kind, own = rows.schema[key].dataType, rows.schema[column].dataType
    names = own.names if isinstance(own, T.StructType) else []
    part = lambda n, t: (F.col(f"{column}.{n}") if n in names else F.lit(None)).cast(t).alias(n)
    nested = "array" in names and isinstance(own["array"].dataType.elementType, T.ArrayType)
    path = F.col(column).alias("path") if isinstance(own, T.StringType) else part("path", "string")
    flat = rows.select(key, how.alias("how"), part("array", "array<array<double>>" if nested else "array<double>"), part("sampling_rate", "int"), part("bytes", "binary"), path)

    def one(array, sampling, data, path) -> np.ndarray:
        if array is not None:
            return resampled(mono(np.asarray(array, np.float64)), sampling or rate, rate)
        if not data and path is None:
            raise ValueError("neither bytes nor a path")
        return resampled(*read_any(data or path), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waves, errors = [], []
            for value in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                try:
                    waves.append(one(*value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a bad row is a result here
                    waves.append(None)
                    errors.append(type(e).__name__)
            yield pa.record_batch([b.column(0), pa.array(waves, pa.list_(pa.float32())), b.column(1), pa.array(errors, pa.string())], names=[key, "wave", "how", "error"])

    fields = [T.StructField(key, kind), T.StructField("wave", T.ArrayType(T.FloatType())), T.StructField("how", T.StringType()), T.StructField("error", T.StringType())]
    return flat.mapInArrow(run, T.StructType(fields))


def decode_wav(rows: DataFrame, key: str, data: str, rate: int = 16_000) -> DataFrame:
    """(key, wave array<float>, error): WAV bytes to mono at ``rate``; what cannot be read has its error and no wave, and the run goes on."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waves, errors = [], []
            for v in b.column(1).to_pylist():
                try:
                    x, own = read_wav(v or b"")
                    waves.append(resampled(x, own, rate))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a bad row is a result here
                    waves.append(None)
                    errors.append(type(e).__name__)
            yield pa.record_batch([b.column(0), pa.array(waves, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "wave", "error"])

    return rows.select(key, data).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("wave", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))


#: Conditions of the probe, with the levels of white noise, of a random walk (its peak) and of a 50 Hz hum.
PROBE = {
    "digital_silence": (0.0, 0.0, 0.0),
    "room_tone": (0.001, 0.0, 0.0),
    "fan_noise": (0.0, 0.05, 0.0),
    "mains_hum": (0.002, 0.0, 0.02),
}


def probe_wave(condition: str, clip: int, seconds: float = 5.0, seed: int = 0, rate: int = 16_000) -> np.ndarray:
    """One clip of non-speech; every clip has a generator of its own, so clips can be made anywhere and in any order."""
    white, walk, hum = PROBE[condition]
    rng = np.random.default_rng([seed, list(PROBE).index(condition), clip])
    steps = rng.standard_normal((2, int(seconds * rate)))
    path = steps[1].cumsum()
    peak = np.ptp(path) / 2 or 1.0
    drift = (path - (path.max() + path.min()) / 2) / peak if len(path) else path
    tone = np.sin(np.arange(steps.shape[1]) * (2 * np.pi * 50 / rate))
    return (white * steps[0] + walk * drift + hum * tone).astype(np.float32)


def probe_waves(seconds: float = 5.0, per_condition: int = 20, seed: int = 0, rate: int = 16_000) -> dict[str, list[np.ndarray]]:
    return {c: [probe_wave(c, i, seconds, seed, rate) for i in range(per_condition)] for c in PROBE}


def transcribe_probe(spark, transcribe, waves: dict[str, list[np.ndarray]] | None = None, per_condition: int = 20) -> DataFrame:
    """(condition, clip_no, text): a user's function from wave to text over the probe's clips, which are made where they are transcribed, or over given ones."""
    ship(spark)
    names = list(waves or PROBE)
    counts = [len(waves[c]) if waves else per_condition for c in names]
    clips = spark.createDataFrame([(c, i) for c, n in zip(names, counts, strict=True) for i in range(n)], "condition string, clip_no int")
    given = spark.sparkContext.broadcast(waves) if waves else None  # the caller's own arrays

    @F.pandas_udf(T.StringType())
    def run(condition: pd.Series, clip: pd.Series) -> pd.Series:
        return pd.Series([transcribe(given.value[c][i] if given else probe_wave(c, i)) for c, i in zip(condition, clip, strict=True)])

    return clips.select("condition", "clip_no", run("condition", "clip_no").alias("text"))
