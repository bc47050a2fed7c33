"""Helpers shared by the operators of this subpackage: shared storage, Arrow chunking, hashing of words with numpy."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder, ship

#: Bytes of text that a numpy step handles at once; a single longer text is handled alone.
CHUNK_BYTES = 2 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now rather than at the next driver collection."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): other columns are left out, null text counts as empty. Also ships this package."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers would keep what their last step took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def lean(step: Callable) -> Callable:
    """``step``, a function from batches to batches, with :func:`release_memory` at the end of each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        release_memory()

    return run


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(col).fill_null(0).cast(pa.int64()))
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the rows) of a string or binary column without nulls."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006 - the tables are kept on purpose
    """1, base, base**2, ... modulo 2**64."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, _U64)
        table[0] = 1
        have = _kept[base] = np.cumprod(table, dtype=_U64)
    return have[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: Bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, off: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the total) of the words in rows laid end to end; ``parts`` marks separators."""
    n = len(raw)
    inside = ~parts[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a row's end ends a word, too
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes: differences of a running polynomial, so the cost is a few passes over the bytes."""
    run = np.zeros(len(raw) + 1, _U64)
    np.cumsum((raw.astype(_U64) + _U64(1)) * powers(_BASE, len(raw)), dtype=_U64, out=run[1:])
    got = (run[end] - run[start]) * inverse_powers(_BASE, len(raw) + 1)[start]
    return mix(got ^ ((end - start).astype(_U64) * _U64(0xA24BAED4963EE407)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (runs across rows included; callers leave those out)."""
    if len(words) < k:
        return np.zeros(0, _U64)
    run = np.zeros(len(words) + 1, _U64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), dtype=_U64, out=run[1:])
    return mix((run[k:] - run[:-k]) * inverse_powers(_WORD_BASE, len(words) + 1)[: len(words) - k + 1])


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words from ``begin`` to before ``end``."""
    run = np.zeros(len(words) + 1, _U64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), dtype=_U64, out=run[1:])
    return mix((run[end] - run[begin]) * inverse_powers(_WORD_BASE, len(words) + 1)[begin] + (end - begin).astype(_U64))


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each run of ``w`` values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, span = x, 1
    while span * 2 <= w:
        have = op(have[: len(have) - span], have[span:])
        span *= 2
    return op(have[:n], have[w - span : w - span + n])
