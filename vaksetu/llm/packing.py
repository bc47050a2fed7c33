"""Best-fit packing in bulk-synchronous rounds.

Documents longer than a sequence are cut first. Pieces of one length are interchangeable, and so are open sequences with
one free length, so a round works on ranges of ranks within a length, not on rows: pieces and gaps are sorted by length, a successor sweep gives
each piece length (longest first) the smallest gap that takes it, the ranks of both decide who gets which (the r-th piece the r-th gap),
the gaps shrink, and the next length's round follows. What a round sees is the histogram of lengths, at most one row for each length up to the capacity,
whatever the number of documents; each round splits at most one class of gaps, so the plan has at most a few thousand rows and may be broadcast. Ranks of
pieces are counted in salted groups, so a length that a third of all documents share is spread over tasks.

Null text counts as empty (one piece, the end id). Rows that share a doc_id are packed as documents of their own. Extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, lean, materialize, sliced
from .tokens import BYTE_BPE, END_ID, words

CAPACITY = 1024
#: Groups into which the pieces of one length are dealt to be ranked.
SALT = 256

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut; see ``_PIECES``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = words(vocabulary), np.array([END_ID], "<u2").tobytes()
        for batch in sliced(batches, "text"):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = coder.ids(text) + end
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                salt = zlib.crc32(b"%d" % (key or 0))
                for i, (s, n) in enumerate(cut(len(wide), capacity)):
                    rows.append((key, i, s, n, zlib.crc32(wide[s : s + n].tobytes()), (salt + i) % SALT))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return id_and_text(docs).mapInArrow(lean(run), _PIECES)


def sweep(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over a histogram of lengths: rows (length, first rank, past rank, first sequence, offset).

    The piece of rank r in a row goes to sequence ``first sequence + r - first rank``, at ``offset``.
    """
    plan, gaps, free = [], {}, []  # gaps: free length -> classes (first sequence, number); free: its sorted keys
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                insort(free, room)
            gaps[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):  # no gap takes it: open sequences, each with as many of this length as fit
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each if full else 0):  # the k-th places of all full new sequences
                    plan.append((length, rank + k * full, rank + (k + 1) * full, opened, k * length))
                leave(capacity - each * length, opened, full)
                rank, opened = rank + each * full, opened + full
                for k in range(rest):  # what is left shares one more
                    plan.append((length, rank + k, rank + k + 1, opened, k * length))
                if rest:
                    leave(capacity - rest * length, opened, 1)
                    opened += 1
                break
            room = free[at]
            first, n = gaps[room].pop()
            take = min(n, left)
            if not gaps[room]:
                del gaps[room]
                free.pop(at)
            plan.append((length, rank, rank + take, first, capacity - room))
            leave(room, first + take, n - take)
            leave(room - length, first, take)
            rank, left = rank + take, left - take
    return plan


def ranked(parts: DataFrame) -> DataFrame:
    """Adds rank: the place of each piece among those of its length, counted within salted groups and shifted by the groups before."""
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    groups = parts.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most CAPACITY * SALT rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    counted = parts.withColumn("inner", F.row_number().over(inner) - 1)
    return counted.join(groups, ["length", "salt"]).withColumn("rank", F.col("inner") + F.col("shift")).drop("inner", "shift", "salt")


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    parts = materialize(pieces(docs, vocabulary, capacity), "pieces")
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CAPACITY rows
    plan = spark.createDataFrame(sweep(histogram, capacity), "p_length int, low long, high long, first long, at long")
    found = ranked(parts).join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
