"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Components become integers, ``floor(1024 * x)``. The Gram matrix of all vectors (as large as the dimension squared, whatever the number of rows) gives
the rotation that puts most of the length into the first coordinates. Vectors are range-sorted by descending length into blocks. Each
block meets each block of queries; in it, a query goes on only while ``|query| * longest vector left`` can still reach its k-th best score, then
partial sums over the first rotated coordinates plus the product of the residual lengths rule out most candidates, and the rest are scored exactly in
integers. Every query starts with a lower bound, its k-th best score within one sample block of the longest vectors, so later blocks prune at once.

Lanes of candidates follow the norms, too, and a block of queries is sent only to lanes whose longest vector can reach the lowest of its floors. Queries
and candidates are both dealt in blocks of bounded size; nothing that grows with the data is broadcast or collected. Each meeting gives at
most k rows for each query, and these are merged by k-best aggregation.

Scores are exact 64-bit integers: vectors so long that a product could leave that range (a length of about 3e9, components of about 3e6) are refused with a ValueError.
Rows whose vector is null or holds a null or non-finite component take no part; neither do rows with a null id. Vectors of unequal lengths
are compared over the components that both have (the shorter one counts as filled up with zeros). Rows that share an id are candidates
of their own and ask together: their query_id gets the k best of all that they found; a query's own id is never its candidate. Ties go to the smaller vec_id. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import materialize

SCALE = 1024
K = 10
#: Vectors and queries of a block.
VECTORS, QUERIES = 2048, 256
#: Rotated coordinates of the partial sums.
LEAD = 16
_EXACT = float(1 << 53)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<long>, norm double) of the rows that take part."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id is not null and e is not null")
    rows = rows.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    off = np.asarray(col.offsets).astype(np.int64)
    flat = np.asarray(col.values)[off[0] : off[-1]] if len(col) else np.zeros(0, np.int64)
    sizes = np.diff(off)
    out = np.zeros((len(col), dim), np.int64)
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], sizes)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first, from partial Gram matrices."""

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.record_batch([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], names=["i", "j", "x"])

    parts = vectors.select("v").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((dim, dim))
    for r in parts:  # dim * dim rows
        g[r.i, r.j] = r.x
    _, axes = np.linalg.eigh(g)
    return axes[:, ::-1].copy()


def best(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, v: np.ndarray, v_id: np.ndarray, axes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its at most k best (ids, scores) among ``v`` (longest first) that may reach ``floor``."""
    lead = min(LEAD, axes.shape[1])
    norm_v, norm_q = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    rv, rq = v.astype(np.float64) @ axes, q.astype(np.float64) @ axes
    rest = lambda r: np.sqrt((r[:, lead:] ** 2).sum(axis=1))
    rest_v, rest_q = rest(rv), rest(rq)
    small = bool(len(v)) and norm_v.max() * max(norm_q.max(initial=0), 1) < _EXACT
    exact_v = v.astype(np.float64) if small else v
    for i in range(len(q)):
        bound, ids, scores = floor[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
        slack = 1 + 1e-9 * norm_q[i] * (norm_v[0] if len(v) else 0)
        for a in range(0, len(v), 512):
            if norm_q[i] * norm_v[a] + slack < bound:
                break  # all others are shorter
            part = slice(a, a + 512)
            reach = rv[part, :lead] @ rq[i, :lead] + rest_v[part] * rest_q[i] + slack
            live = a + np.flatnonzero((reach >= bound) & (v_id[part] != q_id[i]))
            if not len(live):
                continue
            got = exact_v[live] @ (q[i].astype(np.float64) if small else q[i])
            ids, scores = np.concatenate([ids, v_id[live]]), np.concatenate([scores, got.astype(np.int64)])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
            if len(ids) == k:
                bound = max(bound, scores[-1])
        yield i, ids, scores


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(block, ids, v, dims, top): rows packed in their partitions' order into blocks of at most ``size``."""

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                yield table.slice(0, size)
                held = table.slice(size).to_batches()
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in full(batches):
            ids, col, norm = (c.combine_chunks() for c in part.columns)
            dim = max(len(x) for x in col)
            yield pa.record_batch([pa.array([np.asarray(ids).astype("<i8").tobytes()]), pa.array([_matrix(col, dim).astype("<i8").tobytes()]), pa.array([dim], pa.int32()), pa.array([float(np.asarray(norm).max())])], names=["ids", "v", "dims", "top"])

    packed = rows.select("vec_id", "v", "norm").mapInArrow(run, "ids binary, v binary, dims int, top double")
    return packed.select([F.col(c).alias(f"{name}_{c}") for c in packed.columns])


def _open(ids: bytes, v: bytes, dims: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(ids, "<i8")
    out = np.zeros((len(got), dim), np.int64)
    out[:, :dims] = np.frombuffer(v, "<i8").reshape(len(got), dims)
    return got, out


def _with_floors(queries: DataFrame, longest, axes, dim: int, k: int) -> DataFrame:
    """Blocks of queries with ``q_floors``, each query's k-th best score among the longest vectors, and ``q_least``, the lowest of them (minus infinity where there are fewer)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(longest.value[0], np.int64)
        v = np.zeros((len(ids), dim), np.int64)
        for i, x in enumerate(longest.value[1]):
            v[i, : len(x)] = x
        for b in batches:
            floors = []
            for r in b.select(["q_ids", "q_v", "q_dims"]).to_pylist():
                q_id, q = _open(r["q_ids"], r["q_v"], r["q_dims"], dim)
                found = best(q, q_id, np.full(len(q), -np.inf), v, ids, axes.value, k)
                floors.append(np.array([s[-1] if len(s) == k else -np.inf for _, _, s in found]))
            more = [pa.array([x.astype("<f8").tobytes() for x in floors], pa.binary()), pa.array([float(x.min()) for x in floors], pa.float64())]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "q_floors", "q_least"])

    return queries.mapInArrow(run, "q_ids binary, q_v binary, q_dims int, q_top double, q_floors binary, q_least double")


def _in_small_batches(met: DataFrame) -> DataFrame:
    """Runs ``met`` with a few pairs of blocks (about a megabyte each) in an Arrow batch, and writes its rows to the shared folder."""
    spark, name = met.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        return materialize(met, "met")
    finally:
        spark.conf.set(name, before)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors. ``is_query``: a condition on vec_id."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(usable(vectors, scale), "vectors")
    most = rows.agg(F.max(F.size("v")).alias("dim"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).first()
    dim = most.dim or 0
    out = "query_id long, vec_id long, score long"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most.norm**2 >= float(1 << 63):
        raise ValueError(f"inner products of vectors as long as {most.norm:.3g} leave the range of 64-bit integers")
    axes = spark.sparkContext.broadcast(rotation(rows, dim))  # dim * dim numbers
    # the longest vectors, one block: each query's k-th best among them is a floor for all blocks
    longest = spark.sparkContext.broadcast(tuple(zip(*[(r.vec_id, r.v) for r in rows.orderBy(F.desc("norm"), "vec_id").limit(min(1024, VECTORS)).collect()], strict=True)))
    groups = max(16, most.n // (4 * VECTORS))
    ranged = rows.repartitionByRange(groups, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    dealt = materialize(_blocks(ranged, VECTORS, "c").withColumn("lane", F.spark_partition_id()), "candidates")
    queries = materialize(_with_floors(_blocks(rows.filter(is_query), QUERIES, "q"), longest, axes, dim, k), "queries")
    # a query block goes to every lane that it may find something in: a stated query set against all rows, in blocks
    tops = {r.lane: r.top for r in dealt.groupBy("lane").agg(F.max("c_top").alias("top")).collect()}  # one number for each lane
    lanes = F.lit([float(tops.get(i, -1.0)) for i in range(max(tops) + 1)])
    reached = F.filter(F.transform(lanes, lambda top, i: F.when((top >= 0) & (F.col("q_top") * top * (1 + 1e-9) + 1 >= F.col("q_least")), i)), lambda i: i.isNotNull())
    sent = queries.withColumn("lane", F.explode(reached))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_id, q = _open(r["q_ids"], r["q_v"], r["q_dims"], dim)
                floor = np.frombuffer(r["q_floors"], "<f8")
                v_id, v = _open(r["c_ids"], r["c_v"], r["c_dims"], dim)
                qs, ids, scores = [], [], []
                for i, got, s in best(q, q_id, floor, v, v_id, axes.value, k):
                    qs.append(np.full(len(got), q_id[i]))
                    ids.append(got)
                    scores.append(s)
                if qs:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (qs, ids, scores)], names=["query_id", "vec_id", "score"])

    met = dealt.repartition(groups, "lane").join(sent.repartition(groups, "lane"), "lane").select("q_ids", "q_v", "q_dims", "q_floors", "c_ids", "c_v", "c_dims").mapInArrow(meet, out)
    met = _in_small_batches(met)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
