"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of documents in order. Ids are cut into blocks of ``BLOCK``; a block stores its minimum, the differences from it packed at
the width that the ``PERCENTILE`` of them needs, and an exception list with the places and high bits of the rest. An index holds each
block's start, so that any id is read by decoding one block.

Layout (little-endian): magic; blocks: u32 minimum, u8 width, u16 exceptions, packed low bits (lowest bit first), u16 places, u32 high
parts; then u64 block starts, i64 doc_ids, u8 doc_id is null, u64 document lengths; footer: u64 blocks, u64 ids, u64 documents, u64 start of the index, magic.

Null text counts as empty (only the end id). Documents are ordered by doc_id, nulls first, and rows that share a doc_id by a hash of their text; each row
is written. Extra columns are left out; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, id_and_text, materialize, sliced
from .tokens import END_ID, WORD_BPE, words

MAGIC = b"PFORIDS1"
BLOCK = 512
PERCENTILE = 95
_FOOT = struct.Struct("<QQQQ8s")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value (below 2**32) needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of all blocks, their starts in them); the last block is filled up with its last id."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.int64)
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    at = BLOCK * PERCENTILE // 100
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    high = rest >> width[:, None].astype(np.uint32)
    odd = high > 0
    count = odd.sum(axis=1)
    size = 7 + BLOCK * width // 8 + 6 * count
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)

    def put(rows: np.ndarray, shift: np.ndarray | int, data: np.ndarray) -> None:
        out[(start[rows] + shift)[:, None] + np.arange(data.shape[1])] = data

    every = np.arange(blocks)
    put(every, 0, least.astype("<u4").view(np.uint8).reshape(blocks, 4))
    put(every, 4, width.astype(np.uint8)[:, None])
    put(every, 5, count.astype("<u2").view(np.uint8).reshape(blocks, 2))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 256)):
            if w:
                bits = (rest[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
                put(part, 7, np.packbits(bits.astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little"))
    for b in np.flatnonzero(count):
        where = np.flatnonzero(odd[b])
        a = start[b] + 7 + BLOCK * width[b] // 8
        out[a : start[b] + size[b]] = np.concatenate([where.astype("<u2").view(np.uint8), high[b, where].astype("<u4").view(np.uint8)])
    return out.tobytes(), start


def unpack_blocks(raw: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of the blocks that begin at ``start``."""
    blocks = len(start)
    out = np.empty((blocks, BLOCK), np.uint32)
    take = lambda rows, shift, size: raw[(start[rows] + shift)[:, None] + np.arange(size)]
    every = np.arange(blocks)
    least = np.ascontiguousarray(take(every, 0, 4)).view("<u4").ravel() if blocks else np.zeros(0, np.uint32)
    width = take(every, 4, 1).ravel().astype(np.int64)
    count = np.ascontiguousarray(take(every, 5, 2)).view("<u2").ravel() if blocks else np.zeros(0, np.uint16)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 256)):
            if w:
                bits = np.unpackbits(take(part, 7, BLOCK * int(w) // 8), axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                wide = np.zeros((len(part), BLOCK, 32), np.uint8)
                wide[:, :, :w] = bits
                out[part] = np.packbits(wide.reshape(len(part), -1), axis=1, bitorder="little").view("<u4")
            else:
                out[part] = 0
    for b in np.flatnonzero(count):
        a, c = int(start[b] + 7 + BLOCK * width[b] // 8), int(count[b])
        where = raw[a : a + 2 * c].view("<u2").astype(np.int64)
        out[b, where] |= (raw[a + 2 * c : a + 6 * c].copy().view("<u4") << np.uint32(width[b])).astype(np.uint32)
    out += least[:, None]
    return out.ravel()[:n]


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    body, start = pack_blocks(ids)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    index = len(MAGIC) + len(body)
    return b"".join(
        [MAGIC, body, (start + len(MAGIC)).astype("<u8").tobytes(), keys.tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes()]
        + [_FOOT.pack(len(start), len(ids), len(doc_ids), index, MAGIC)]
    )


def parse_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, doc_ids, lengths) of a whole file."""
    raw = np.frombuffer(data, np.uint8)
    blocks, n, docs, index, magic = _FOOT.unpack(data[-_FOOT.size :])
    if data[: len(MAGIC)] != MAGIC or magic != MAGIC:
        raise ValueError("no token-id file")
    start = raw[index : index + 8 * blocks].copy().view("<u8").astype(np.int64)
    at = index + 8 * blocks
    keys = raw[at : at + 8 * docs].copy().view("<i8").tolist()
    null = raw[at + 8 * docs : at + 9 * docs].tolist()
    lengths = raw[at + 9 * docs : at + 17 * docs].copy().view("<u8").astype(np.int64)
    return unpack_blocks(raw, start, n), [None if z else k for k, z in zip(keys, null, strict=True)], lengths


def ids_at(data: bytes, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a file, decoding only the blocks that hold them."""
    raw = np.frombuffer(data, np.uint8)
    blocks, total, _, index, _ = _FOOT.unpack(data[-_FOOT.size :])
    a, z = first // BLOCK, -(-min(first + n, total) // BLOCK)
    start = raw[index + 8 * a : index + 8 * z].copy().view("<u8").astype(np.int64)
    return unpack_blocks(raw, start, (z - a) * BLOCK)[first - a * BLOCK :][: min(n, total - first)]


#: Ids of a file at most (a document with more has a file of its own).
FILE_IDS = 1 << 22
#: Tasks at most over which files are dealt to be read back.
READERS = 20_000


def write(docs: DataFrame, folder: str, vocabulary: str = WORD_BPE) -> DataFrame:
    """Write token-id files in ascending doc_id order; their manifest (part, file, path, n_docs, n_ids).

    Each attempt of a task writes names of its own and the manifest lists those that count, so a lost executor does no harm.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        coder, end = words(vocabulary), np.array([END_ID], "<u2").tobytes()
        keys: list = []
        parts: list[bytes] = []
        held, n_file = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, n_file
            ids = np.frombuffer(b"".join(parts), "<u2").astype(np.uint32)
            system, at = fs.FileSystem.from_uri(folder)
            system.create_dir(at, recursive=True)
            name = f"ids-{uuid.uuid4().hex}.pfor"
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(file_bytes(ids, keys, [len(p) // 2 for p in parts]))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([n_file], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["part", "file", "path", "n_docs", "n_ids"])
            keys, parts, held, n_file = [], [], 0, n_file + 1
            return row

        for batch in sliced(batches, "text"):
            part = batch.column(2)[0].as_py()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = coder.ids(text) + end
                if held and held + len(got) // 2 > FILE_IDS:
                    yield flush()
                keys.append(key)
                parts.append(got)
                held += len(got) // 2
        if keys:
            yield flush()

    ordered = id_and_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, file int, path string, n_docs long, n_ids long")


def read(manifest: DataFrame) -> DataFrame:
    """Read files back: (doc_id, start, n_tokens, ids_crc32); ``start`` counts the ids of all documents before, over all files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as f:
                    ids, keys, lengths = parse_file(f.read())
                end = np.cumsum(lengths)
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(end.tolist(), lengths.tolist(), strict=True)]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(base + end - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each file, a few hundred to each task's gigabyte
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    # a stated number is not coalesced: the manifest is tiny, what its files hold is not
    files = max(1, min(manifest.count(), READERS))
    return placed.repartition(files, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str = WORD_BPE) -> DataFrame:
    """Write all documents' ids to the shared folder and read the files back."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read(materialize(write(docs, folder, vocabulary), "manifest"))
