"""Exact substring removal by relative Lempel-Ziv factors over an anchored index.

Every document is a reference. The index cuts each text into blocks at content-chosen anchors (the
minimal k-gram of each window), so equal windows always lie in blocks of one anchor. A block travels once,
as its anchor and short fingerprints of its windows; all blocks of an anchor meet in one partition, where a
window that starts anywhere else is known. A document's marked windows are then parsed greedily, left to
right: a factor runs on while the next window continues the same reference, and a new factor starts where it
does not. A window over such a boundary counts only if it is marked itself. All factors have at least
``window`` words; words outside factors are literals and are kept.

Skew: equal blocks inside a chunk of rows are combined before the shuffle, so a passage that a third of all
documents share sends one row for each chunk, not for each document. Text is shuffled once, at the end.

Null text counts as empty. Rows that repeat (equal id and text) are each other's copies: all their windows go.
Texts under ``window`` words lose nothing. Extra columns are left out, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    column_bytes,
    free_name,
    gram_hashes,
    id_and_text,
    lean,
    materialize,
    mix,
    release_shuffles,
    sliced,
    sliding,
    word_hashes,
    word_spans,
)

WINDOW = 35
#: Words of an anchor; a window has WINDOW - ANCHOR + 1 candidates.
ANCHOR = 8
_FP_BYTES = 6
_OCCURRENCE = np.dtype([("key", "<i8"), ("start", "<i4")])
#: Chunks of rows in which equal blocks are combined.
_COMBINE_BYTES = 4 << 20

_BLOCKS = "anchor long, key long, start int, n int, windows binary, others binary"
_MARKS = "key long, start int, mask long, ref_key long, ref_start int"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _argmin_windows(grams: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest gram in each run of w (by its high 40 bits, the leftmost of equals)."""
    n = len(grams)
    if n < 1 << 24:
        low = np.uint64((1 << 24) - 1)
        return (sliding((grams & ~low) | np.arange(n, dtype=np.uint64), w) & low).astype(np.int64)
    order = np.argsort(grams >> np.uint64(24), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order[sliding(rank, w)]


def blocks_of(batches: Iterable[pa.RecordBatch], window: int = WINDOW, k: int = ANCHOR) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to anchored blocks; see ``_BLOCKS``."""
    for batch in sliced(batches, "text", _COMBINE_BYTES):
        raw, off = column_bytes(batch.column(1))
        start, end, first = word_spans(raw, off)
        if len(start) < window:
            continue
        words = word_hashes(raw, start, end)
        grams, wins = gram_hashes(words, k), gram_hashes(words, window)
        anchor_at = _argmin_windows(grams, window - k + 1)[: len(wins)]
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        good = np.flatnonzero(doc[: len(wins)] == doc[window - 1 :])
        if not len(good):
            continue
        at, wins, doc = anchor_at[good], wins[good], doc[good]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(cut, len(good)))
        anchor, where = grams[at[cut]], doc[cut]
        keys = np.asarray(batch.column(0))[where]
        begin = (good[cut] - first[where]).astype(np.int32)
        same = mix(anchor + n.astype(np.uint64)) ^ mix(wins[cut] * np.uint64(3)) ^ mix(wins[cut + n - 1] * np.uint64(5) + np.uint64(1))
        _, rep, group, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        members = np.argsort(group, kind="stable")
        keep = np.ones(len(members), bool)
        keep[np.cumsum(count) - count] = False  # the first of each group is the row itself
        others = np.empty(int(keep.sum()), _OCCURRENCE)
        others["key"], others["start"] = keys[members[keep]], begin[members[keep]]
        take = np.repeat(cut[rep], n[rep]) + (np.arange(n[rep].sum()) - np.repeat(np.cumsum(n[rep]) - n[rep], n[rep]))
        prints = wins[take].view(np.uint8).reshape(-1, 8)[:, :_FP_BYTES]
        yield pa.record_batch(
            [
                pa.array(anchor[rep].view(np.int64)),
                pa.array(keys[rep]),
                pa.array(begin[rep]),
                pa.array(n[rep].astype(np.int32)),
                _binary(prints, np.concatenate([[0], np.cumsum(n[rep])]) * _FP_BYTES),
                _binary(others.view(np.uint8), np.concatenate([[0], np.cumsum(count - 1)]) * _OCCURRENCE.itemsize),
            ],
            names=["anchor", "key", "start", "n", "windows", "others"],
        )


def marks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of some anchors (one shuffle partition) to marks: which windows of a block start anywhere else."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    col = {name: table.column(name).chunk(0) for name in table.schema.names}
    anchor, key = np.asarray(col["anchor"]).view(np.uint64), np.asarray(col["key"])
    start, n = np.asarray(col["start"]), np.asarray(col["n"]).astype(np.int64)
    raw, _ = column_bytes(col["windows"])
    more, more_off = column_bytes(col["others"])
    wide = np.zeros((len(raw) // _FP_BYTES, 8), np.uint8)
    wide[:, :_FP_BYTES] = raw.reshape(-1, _FP_BYTES)
    prints = wide.view(np.uint64).ravel()
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(prints)) - first[row]
    _, head, group, count = np.unique(mix(anchor[row] ^ mix(prints)), return_index=True, return_inverse=True, return_counts=True)
    tail = np.empty(len(count), np.int64)
    tail[group] = np.arange(len(group))  # the last place of each
    several = np.diff(more_off) > 0
    marked = (count[group] > 1) | several[row]
    mask = np.bitwise_or.reduceat(marked.astype(np.int64) << place, first)
    hit = np.flatnonzero(mask)
    lead = first[hit] + np.log2((mask[hit] & -mask[hit]).astype(np.float64)).astype(np.int64)
    ref = head[group[lead]]
    ref = np.where(ref == lead, tail[group[lead]], ref)
    ref_key, ref_start = key[row[ref]], start[row[ref]] + place[ref].astype(np.int32)
    other = more.view(_OCCURRENCE)
    alone = ref == lead  # known only from this chunk's other occurrences
    if alone.any():
        pick = other[more_off[hit[alone]] // _OCCURRENCE.itemsize]
        ref_key[alone], ref_start[alone] = pick["key"], pick["start"] + place[lead[alone]].astype(np.int32)
    times = (np.diff(more_off) // _OCCURRENCE.itemsize)[hit]
    yield pa.record_batch(
        [
            pa.array(np.concatenate([key[hit], other["key"]])),
            pa.array(np.concatenate([start[hit], other["start"]])),
            pa.array(np.concatenate([mask[hit], np.repeat(mask[hit], times)])),
            pa.array(np.concatenate([ref_key, np.repeat(key[hit], times)])),
            pa.array(np.concatenate([ref_start, np.repeat(start[hit] + place[lead].astype(np.int32), times)])),
        ],
        names=["key", "start", "mask", "ref_key", "ref_start"],
    )


def factors_of(start: np.ndarray, mask: np.ndarray, ref_key: np.ndarray, ref_start: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document's marks into factors (start, length, reference, its start), in words."""
    out: list[list[int]] = []
    for i in np.argsort(start, kind="stable"):
        m, s = int(mask[i]), int(start[i])
        low = (m & -m).bit_length() - 1
        while m:
            j = (m & -m).bit_length() - 1
            m &= m - 1
            w, rk, rs = s + j, int(ref_key[i]), int(ref_start[i]) + j - low
            if out and w == out[-1][0] + out[-1][1] - window + 1 and out[-1][2] == rk and out[-1][3] + w - out[-1][0] == rs:
                out[-1][1] += 1
            elif not out or w > out[-1][0] + out[-1][1] - window:
                out.append([w, window, rk, rs])
    return [tuple(x) for x in out]


def _pieces(window: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text", pa.string()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_key", pa.int64()), ("ref_start", pa.int32())]))),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, texts, marks = batch.column(0), batch.column(1), batch.column(2)
            rows = []
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                words, found = raw.split(), marks[i]
                if not found.is_valid:
                    rows.append((texts[i].as_py(), len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []))
                    continue
                v = found.values
                cols = [np.asarray(v.field(k)) for k in range(4)]
                factors = factors_of(*cols, window)
                edge = np.zeros(len(words) + 1, np.int32)
                for s, length, _, _ in factors:
                    edge[s] += 1
                    edge[s + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                data = np.frombuffer(raw, np.uint8)
                a, z, _ = word_spans(data, np.array([0, len(data)]))
                turn = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                text = b"\n".join(raw[a[p] : z[q - 1]] for p, q in turn.reshape(-1, 2))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                rows.append((text.decode(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "ref_key", "ref_start"), f, strict=True)) for f in factors]))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([ids.cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return run


def find_marks(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """keyed: (key long, text string without nulls). Marks by block, see ``_MARKS``."""
    blocks = keyed.mapInArrow(lean(lambda it: blocks_of(it, window)), _BLOCKS)
    return blocks.repartition("anchor").mapInArrow(lean(marks_of), _MARKS)


def deduplicate_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word in a run of ``window`` words that also starts anywhere else.

    Returns doc_id, text (what is left; unchanged where nothing goes, else the kept stretches parted by a line end),
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and factors (duplicate spans with a place
    where each also starts).
    """
    rows = id_and_text(docs)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    marks = materialize(find_marks(rows.select("key", "text"), window), "marks")
    release_shuffles(docs.sparkSession)
    # marks of repeated rows are the same rows again: a set of them is enough
    own = marks.groupBy("key").agg(F.collect_set(F.struct("start", "mask", "ref_key", "ref_start")).alias("marks"))
    joined = rows.join(own.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(
        lean(_pieces(window)),
        "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,ref_key:long,ref_start:int>>",
    )


def without_duplicates(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all its columns, with text as :func:`deduplicate_substrings` leaves it; null text stays null. Helper columns take names that ``docs`` does not have."""
    own_key, own_marks = free_name(docs, "rlz_key"), free_name(docs, "rlz_marks")
    keyed = docs.withColumn(own_key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = id_and_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    marks = materialize(find_marks(rows.select("key", "text"), window), "marks")
    release_shuffles(docs.sparkSession)
    own = marks.groupBy(F.col("key").alias(own_key)).agg(F.collect_set(F.struct("start", "mask", "ref_key", "ref_start")).alias(own_marks))
    joined = keyed.join(own.hint("shuffle_hash"), own_key, "left").drop(own_key)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            marks, texts = batch.column(batch.num_columns - 1), batch.column(at)
            new = [t if not m.is_valid else _cut(t, m, window) for t, m in zip(texts.to_pylist(), marks, strict=True)]
            cols = [batch.column(i) if i != at else pa.array(new, pa.string()) for i in range(batch.num_columns - 1)]
            yield pa.record_batch(cols, names=names)

    return joined.mapInArrow(lean(run), docs.schema)


def _cut(text: str, marks: pa.Scalar, window: int) -> str:
    """What is left of a text: the kept stretches parted by a line end."""
    v = marks.values
    data = np.frombuffer(raw := text.encode(), np.uint8)
    a, z, _ = word_spans(data, np.array([0, len(data)]))
    edge = np.zeros(len(a) + 1, np.int32)
    for s, length, _, _ in factors_of(*[np.asarray(v.field(k)) for k in range(4)], window):
        edge[s] += 1
        edge[s + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return b"\n".join(raw[a[p] : z[q - 1]] for p, q in turn.reshape(-1, 2)).decode()
