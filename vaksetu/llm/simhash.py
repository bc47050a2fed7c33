"""SimHash near-duplicates linked by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 3 share a variant that is within one flip of one of them and within two of the
other. So every fingerprint emits itself and its 64 one-flip variants, and those of even parity also emit two-flip
variants (at distance 3 exactly one of the two is even, and two of three bits lie in the same half, so pairs of bits
within a half are enough: 992 of 2016). Variants are shuffled; whoever meets at a variant where somebody is within one
flip is linked to that one, at distance 3 or less by the triangle inequality. No pairs of a group are listed.

Groups are bounded: fingerprints are made distinct first, and at most 1,057 distinct ones reach a variant.
Before the large emission, a fingerprint is set aside if no other one lies within one flip of it in either half
(of two that differ in 3 bits or fewer, one half differs in at most one), which loses no link.

Null text counts as empty and gets fingerprint zero; it is linked like any other. Rows with a null id take part, and a class
without any id has a null component. Repeated rows are linked as equal fingerprints. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE, column_bytes, free_name, id_and_text, lean, materialize, mix, release_shuffles, run_hashes, sliced, word_hashes, word_spans
from .components import connected_components

RADIUS = 3
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles_of(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the shingles of all rows of (key, text), first shingle of each row and the total)."""
    xxh = xxhash.xxh64_intdigest
    raw, off = column_bytes(batch.column(1))
    start, end, first = word_spans(raw, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(batch) + 1, np.int64)
    # one space after each word, nothing else between words
    keep = ~SPACE[raw]
    stop = end[end < len(raw)]
    stop = stop[SPACE[raw[stop]]]
    keep[stop] = True
    text = _LOWER[raw]
    text[stop] = 32
    text = text[keep].tobytes()
    moved = np.concatenate([[0], np.cumsum(keep)])
    a, z = moved[start], moved[end]
    sizes = np.diff(first)
    size = np.maximum(sizes - words + 1, np.minimum(sizes, 1))
    edges = np.concatenate([[0], np.cumsum(size)])
    begin = np.repeat(first[:-1] - edges[:-1], size) + np.arange(edges[-1])
    last = np.minimum(begin + words, np.repeat(first[1:], size)) - 1
    hashes = np.fromiter((xxh(text[s:e], SEED) for s, e in zip(a[begin].tolist(), z[last].tolist(), strict=True)), np.uint64, len(begin))
    return hashes, edges


def fingerprints_of(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) to (key, f0): the bit majority of the XXH64 of all shingles of ``words`` words."""
    for batch in sliced(batches, "text", CHUNK_BYTES // 2):
        hashes, edges = shingles_of(batch, words)
        prints = majorities(hashes, edges, 1)
        yield pa.record_batch([batch.column(0), pa.array(np.ascontiguousarray(prints[:, 0]))], names=["key", "f0"])


def majorities(hashes: np.ndarray, edges: np.ndarray, lanes: int) -> np.ndarray:
    """(rows, lanes) fingerprints: a bit is set if it is in over half of a row's hashes; further lanes mix the hashes anew."""
    bits = np.zeros((len(edges) - 1, 8 * lanes), np.uint8)
    for d in np.flatnonzero(np.diff(edges)).tolist():
        own = hashes[edges[d] : edges[d + 1]]
        for k in range(lanes):
            total = np.zeros(64, np.int64)
            for lo in range(0, len(own), 1 << 14):
                part = own[lo : lo + (1 << 14)]
                part = part if not k else mix(part + np.uint64(k))
                total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
            bits[d, 8 * k : 8 * k + 8] = np.packbits(2 * total > len(own))
    return bits.view(">u8").astype(np.uint64).view(np.int64)


def sets_of(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the different shingles of each row of (key, text), ascending, first of each row and the total); a text of fewer words is one shingle."""
    raw, off = column_bytes(batch.column(1))
    raw = _LOWER[raw]
    start, end, first = word_spans(raw, off)
    sizes = np.diff(first)
    count = np.maximum(sizes - words + 1, np.minimum(sizes, 1))
    edges = np.concatenate([[0], np.cumsum(count)])
    if not edges[-1]:
        return np.zeros(0, np.uint64), edges
    begin = np.repeat(first[:-1] - edges[:-1], count) + np.arange(edges[-1])
    hashes = run_hashes(word_hashes(raw, start, end), begin, np.minimum(begin + words, np.repeat(first[1:], count)))
    return _different(hashes, edges)


def _different(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each row, ascending, and the first of each row and the total."""
    if not len(hashes):
        return hashes, edges
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
    return hashes[new], np.searchsorted(row[new], np.arange(len(edges)))


def shingle_sets_of(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) to (key, grams): the XXH64 of a text's different shingles."""
    for batch in sliced(batches, "text", CHUNK_BYTES // 2):
        hashes, edges = _different(*shingles_of(batch, words))
        grams = pa.LargeListArray.from_arrays(edges, hashes.view(np.int64)).cast(pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), grams], names=["key", "grams"])


def fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""
    rows = id_and_text(docs)
    return rows.mapInArrow(lean(lambda it: fingerprints_of(it, words)), "key long, f0 long").toDF("doc_id", "fp")


def _one(bit):
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def candidates(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints that have another one within one flip in at least one half."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32) + F.lit(1 << 32)
    halves = fps.select("fp", F.explode(F.array(low, high)).alias("half"))
    centres = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n"))
    rim = halves.select("fp", "half", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bit"))
    rim = rim.select("fp", "bit", F.when(F.col("bit") < 32, F.col("half").bitwiseXOR(_one(F.col("bit")))).otherwise(F.col("half")).alias("key"))
    near = rim.join(centres, (rim.key == centres.half) & ((rim.bit < 32) | (centres.n > 1)), "left_semi")
    return near.select("fp").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_NEAR = [0, *(1 << i for i in range(64))]
_FAR = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp); their components are those of distance <= 3."""
    near, far = ([_signed(x) for x in xs] for xs in (_NEAR, _NEAR + _FAR))
    even = F.bit_count("fp") % 2 == 0
    ball = fps.select("fp", F.explode(F.when(even, F.lit(far)).otherwise(F.lit(near))).alias("mask"))
    ball = ball.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), (F.bit_count("mask") <= 1).alias("close"))
    own = Window.partitionBy("variant")
    met = ball.withColumn("hub", F.min(F.when(F.col("close"), F.col("fp"))).over(own))
    # the verification: a link that met at a variant must hold between the fingerprints themselves
    met = met.filter((F.col("hub") != F.col("fp")) & (F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= RADIUS))
    return met.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): classes of rows linked by fingerprints at distance 3 or less; the class id is its smallest doc_id."""
    spark = docs.sparkSession
    prints = materialize(fingerprint(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    close = materialize(candidates(distinct.select("fp")), "candidates")
    release_shuffles(spark)
    edges = materialize(links(close), "links")
    release_shuffles(spark)
    labels = connected_components(edges)
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


SIMILARITY = 0.8
#: Near copies: lanes of 64 bits, each with ``64 // BLOCK`` blocks.
LANES, BLOCK = 8, 12
#: A long set's seeds are its so many smallest hashes. Of two sets with a similarity of 0.8, 25.6 of 32 are common on average, with a standard
#: deviation of 2.3; fewer than ``AGREE`` of them with a probability of about 0.0004.
SEEDS, AGREE = 32, 18
#: Sets of at most so many shingles have all of them as seeds and meet at the seed itself, without a block.
SHORT = 64
#: A seed of more sets than that is a crowd: not all pairs of its members are compared.
FEW = 3
#: A member of crowds is compared with so many hubs, those that it meets at the most variants; that only saves the exact search in crowds what it joins.
OFTEN = 8
#: Words of 64 bits in the parities of a set.
PARITIES = 8
_BLOCKS = LANES * (64 // BLOCK)


def seeds_of(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) to (key, f0, f1, ..., n, seeds, blocks): fingerprint of the set, its size, its seeds and the block that belongs to each seed."""
    for batch in sliced(batches, "text", CHUNK_BYTES // 2):
        hashes, edges = sets_of(batch, words)
        prints = majorities(hashes, edges, LANES)
        n = np.diff(edges)
        own = np.where(n <= SHORT, n, SEEDS)
        to = np.concatenate([[0], np.cumsum(own)])
        row = np.repeat(np.arange(len(n)), own)
        seeds = hashes[np.repeat(edges[:-1] - to[:-1], own) + np.arange(to[-1])]
        lane, part = np.divmod((seeds % np.uint64(_BLOCKS)).astype(np.int64), 64 // BLOCK)
        block = (prints.view(np.uint64)[row, lane] >> (part * BLOCK).astype(np.uint64)) & np.uint64((1 << BLOCK) - 1)
        lists = [pa.ListArray.from_arrays(to.astype(np.int32), x) for x in (seeds.view(np.int64), block.astype(np.int32))]
        columns = [("key", batch.column(0)), *((f"f{k}", pa.array(np.ascontiguousarray(prints[:, k]))) for k in range(LANES)), ("n", pa.array(n)), ("seeds", lists[0]), ("blocks", lists[1])]
        yield pa.record_batch([c for _, c in columns], names=[name for name, _ in columns])


def _rare_seeds(distinct: DataFrame) -> DataFrame:
    """(id, n, long, seed, block, crowd): the rarest seeds of each set, so many that near copies have some of them in common; whether more than ``FEW`` have a seed as a rare one.

    Two sets that have ``need`` of their ``s`` seeds in common cannot miss each other in all of the first s - need + 1 in an order that holds for all sets; with rare ones
    first, what many texts share (a licence, a footer) brings together only those that have little else. Short sets and long ones are two such searches; between
    SIMILARITY * SHORT and SHORT shingles a set takes part in both, so each pair of near copies is in one of them.
    """
    zipped = lambda n, long: F.transform(F.slice(F.arrays_zip("seeds", "blocks"), F.lit(1), n), lambda z: F.struct(F.lit(long).alias("long"), z["seeds"].alias("seed"), z["blocks"].alias("block")))
    none = F.array().cast("array<struct<long:boolean,seed:bigint,block:int>>")
    short = F.when(F.col("n") <= SHORT, zipped(F.lit(SHORT), False)).otherwise(none)
    long = F.when(F.col("n") > int(SIMILARITY * SHORT), zipped(F.lit(SEEDS), True)).otherwise(none)
    rows = distinct.filter("n > 0").select("id", "n", F.explode(F.concat(short, long)).alias("s")).select("id", "n", "s.*")
    rows = materialize(rows, "seeds")
    often = rows.groupBy("long", "seed").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # a seed of one text only comes first and meets nobody, so places are counted and the row itself is left out
    own = Window.partitionBy("id", "long")
    size = F.when(F.col("long"), F.lit(SEEDS)).otherwise(F.col("n"))
    need = F.when(F.col("long"), F.lit(AGREE)).otherwise(F.ceil(SIMILARITY * F.col("n") - 1e-9))
    shared = rows.join(often, ["long", "seed"]).withColumns({"place": F.row_number().over(own.orderBy("often", "seed")), "shared": F.count(F.lit(1)).over(own)})
    rare = materialize(shared.filter(size - F.col("shared") + F.col("place") <= size - need + 1).select("id", "n", "long", "seed", "block"), "rare")
    release_shuffles(rare.sparkSession)
    crowds = rare.groupBy("long", "seed").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > FEW).select("long", "seed", F.lit(True).alias("crowd"))
    return rare.join(crowds, ["long", "seed"], "left").select(*rare.columns, F.coalesce("crowd", F.lit(False)).alias("crowd"))


def _ball(seeds: DataFrame) -> DataFrame:
    """(id, n, variant) within one flip of a seed's block; a short set has the seed alone. Variants are hashes of both: a collision only costs a comparison."""
    flips = F.array(*[F.col("block").bitwiseXOR(F.lit(m)) for m in (0, *(1 << i for i in range(BLOCK)))])
    ball = seeds.select("id", "n", "seed", F.explode(F.when(F.col("long"), flips).otherwise(F.array(F.lit(-1)))).alias("block"))
    return ball.select("id", "n", F.xxhash64("seed", "block").alias("variant"))


def _close(n, m):
    """Sets whose sizes differ more cannot be similar."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def _meetings(ball: DataFrame) -> DataFrame:
    """(id, low, high) of those who are not alone at a variant, with its smallest and largest id (null if of a set too small or large).

    Counts and ends are combined before the shuffle; a variant that very many rows reach is a skewed key of the join alone, which adaptive execution splits.
    """
    ends = [F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("n", "id").alias("low_n"), F.max_by("n", "id").alias("high_n")]
    met = ball.join(ball.groupBy("variant").agg(*ends).filter("low <> high").hint("merge"), "variant")
    return met.select("id", *[F.when(_close(F.col("n"), F.col(f"{x}_n")), F.col(x)).alias(x) for x in ("low", "high")])


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b, meets): pairs of a member and a hub, and at how many variants they meet. A member has two hubs for each variant; no join lists them."""
    ends = [met.select("id", F.col(hub).alias("hub")) for hub in ("low", "high")]
    pairs = ends[0].union(ends[1]).filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("meets"))


def _most_met(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member and the ``OFTEN`` that it meets at most variants."""
    own = Window.partitionBy("id").orderBy(F.desc("meets"), "hub")
    met = pairs.select(F.col("a").alias("id"), F.col("b").alias("hub"), "meets")
    met = met.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= OFTEN).select("id", "hub")
    # a hub has very many members, so of its own side only the one that it meets most often counts
    best = pairs.groupBy("b").agg(F.max(F.struct("meets", "a")).alias("m")).select("b", "m.a")
    return met.union(best).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _with_hubs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of a member and a hub, the smallest or largest id of a variant; up to three members are all compared."""
    ends = [met.select("id", F.col(hub).alias("hub")) for hub in ("low", "high")]
    pairs = ends[0].union(ends[1]).filter("id <> hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _labelled(df: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
    for x in ends:
        df = df.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")), x, "left").withColumn(f"{x}_label", F.coalesce(f"{x}_label", x))
    return df


def _left_in_crowds(seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, id_label) of those who share a seed with another class, where more than three have it; ``seeds`` holds one row for each set and rare seed."""
    rows = _labelled(seeds.select("id", "long", "seed"), labels, "id")
    crowds = rows.groupBy("long", "seed").agg(F.count(F.lit(1)).alias("n"), F.min("id_label").alias("low"), F.max("id_label").alias("high"))
    crowds = crowds.filter((F.col("n") > FEW) & (F.col("low") != F.col("high"))).select("long", "seed")
    return rows.join(crowds, ["long", "seed"], "left_semi").select("id", "id_label").distinct()


def _parities(gram: Column, over: WindowSpec) -> dict[str, Column]:
    """For each of 64 * ``PARITIES`` bits whether an odd number of the shingles in a window have it as theirs. Two sets differ in as many shingles as in bits, or more."""
    lane, one = F.shiftright(gram, 6).bitwiseAND(F.lit(PARITIES - 1)), _one(gram.bitwiseAND(F.lit(63)).cast("int"))
    return {f"p{k}": F.bit_xor(F.when(lane == k, one).otherwise(F.lit(0).cast("long"))).over(over) for k in range(PARITIES)}


def _by_rare_shingles(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes among (id, id_label, grams), with all that are similar, by exact prefix and parity filters.

    With rare shingles first, a set of n that is similar to no smaller one meets it among its first n - SIMILARITY * n + 1 shingles, and the smaller one holds that shingle among its first
    n - 2 * SIMILARITY / (1 + SIMILARITY) * n + 1. The first shingle that two sets share also bounds how many they can share by what follows it. So a family of texts that share
    less than that (a template with a body of its own) lists no pairs, however large it is. In a family that shares most of its shingles, changes that a few members have in common pass that
    filter in pairs without number; what only one set has and the parities of the rest bound the shingles that two sets differ in from below, so of those the join makes the pairs that may be similar, and few
    more (two sets that may differ in some 250 shingles or more, so of 1,100 and more each, are hardly bound by 512 bits and left to the prefixes).
    """
    t = SIMILARITY
    grams = sets.select("id", "id_label", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    own = Window.partitionBy("id")
    shared = grams.join(often, "gram").withColumns({"place": F.row_number().over(own.orderBy("often", "gram")), "alone": F.col("n") - F.count(F.lit(1)).over(own), **(parities := _parities(F.col("gram"), own))})
    shared = shared.withColumn("place", F.col("alone") + F.col("place"))
    known = ["id", "id_label", "n", "place", "alone", *parities]
    shared = materialize(shared.filter(F.col("place") <= F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1).select("gram", *known), "rare")
    small = shared.filter(F.col("place") <= F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n") - 1e-9) + 1)
    x, y = (rows.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in known]) for side, rows in (("x", small), ("y", shared)))
    order = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    left = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    possible = (F.col("x_n") >= t * F.col("y_n") - 1e-9) & (left >= t / (1 + t) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    differ = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in parities), F.col("x_alone") + F.col("y_alone"))
    possible &= differ <= (1 - t) / (1 + t) * (F.col("x_n") + F.col("y_n")) + 1e-9
    pairs = x.join(y.withColumnRenamed("gram", "y_gram"), (F.col("gram") == F.col("y_gram")) & order & (F.col("x_id_label") != F.col("y_id_label")) & possible)
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _sets(ids: DataFrame, rows: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(id, grams) of the fingerprints ``ids``; only their texts are read into sets."""
    texts = rows.join(keys.join(ids, "id", "left_semi"), "key").select("id", "text")
    # rows that repeat give a set twice
    return materialize(texts.mapInArrow(lean(lambda it: shingle_sets_of(it, words)), "id long, grams array<long>"), "shingles").dropDuplicates(["id"])


def _similar(pairs: DataFrame, rows: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``SIMILARITY``."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rows, keys, words)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("grams").alias(f"{x}_grams"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.filter(common >= SIMILARITY * (F.size("a_grams") + F.size("b_grams") - common)).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """(key, component): classes of near copies, a Jaccard similarity of 0.8 or more of their sets of 5-word shingles.

    ``key`` is the hash of (doc_id, text). Near copies of that kind differ in 77 of 512 bits on average (shingles' cosine is 0.89, so a bit differs with probability acos(0.89) / pi = 0.15),
    so the ball hashing runs on blocks of 12 bits and each block is keyed by a seed, one of the set's smallest shingle hashes: only texts that share a
    rare shingle can meet, however many strangers there are. Every fingerprint emits, for each of its rare seeds, the variants of that seed's block within one flip, so pairs whose
    blocks differ in two bits or fewer meet (0.74 for each of the about nine seeds that near copies share). Whoever meets at a seed of up to three sets is compared with the two hubs of the
    variant (its smallest and largest fingerprint), so all are. Members of crowds are compared with the hubs that they meet most often; what that leaves in different classes meets once
    more, at the rare ones of all its shingles, which misses no pair, wherever it met. A link counts only if the shingle sets themselves are similar. ``component`` is the smallest linked fingerprint's number. Texts without words (null and empty ones) are one class.
    """
    spark = docs.sparkSession
    lanes = [f"f{k}" for k in range(LANES)]
    rows = id_and_text(docs).withColumn("key", F.xxhash64("doc_id", "text")).select("key", "text")
    schema = "key long, " + ", ".join(f"{f} long" for f in lanes) + ", n long, seeds array<long>, blocks array<int>"
    prints = materialize(rows.mapInArrow(lean(lambda it: seeds_of(it, words)), schema).withColumn("id", F.xxhash64(*lanes, "seeds")), "fingerprints")
    distinct = materialize(prints.groupBy("id").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in (*lanes, "n", "seeds", "blocks")]), "distinct")
    release_shuffles(spark)
    rare = materialize(_rare_seeds(distinct), "crowding")
    release_shuffles(spark)
    keys = distinct.select("id", "key")

    def met(seeds: DataFrame) -> DataFrame:
        out = materialize(_meetings(_ball(seeds)), "meetings")
        release_shuffles(spark)
        return _pairs(out)

    def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        out = connected_components(links if labels is None else links.union(labels.select("node", "label")))
        release_shuffles(spark)
        return out

    # of a seed that few have, all pairs that meet are compared; of a crowd's, what a member's most frequent hubs leave in different classes is searched exactly
    nearest = _most_met(materialize(met(rare.filter("crowd")), "pairs"))
    first = materialize(met(rare.filter("not crowd")).select("a", "b").union(nearest).distinct(), "nearest")
    release_shuffles(spark)
    labels = joined(None, _similar(first, rows, keys, words))
    left = materialize(_left_in_crowds(rare.filter("crowd"), labels), "crowds")
    release_shuffles(spark)
    crowded = materialize(_by_rare_shingles(_sets(left.select("id"), rows, keys, words).join(left, "id")), "crowded")
    release_shuffles(spark)
    if not crowded.isEmpty():
        labels = joined(labels, _similar(crowded, rows, keys, words))
    return prints.join(labels, prints.id == labels.node, "left").select("key", F.coalesce("label", "id").alias("component"))


def drop_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest doc_id (null only if all are), of repeated rows one.

    All texts without words (null and empty ones, too) are one class. Any other columns are kept, whatever their names.
    """
    own = free_name(docs, "near_key")
    classes = near_copies(docs, words)
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    ids = keyed.select(F.col(own).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    known = classes.join(ids.distinct(), "key")
    # the smallest (has no id, id, key) of each class; minima are combined before the shuffle
    first = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")).select(F.col("m.key").alias(own))
    return keyed.join(first, own, "left_semi").dropDuplicates([own]).drop(own)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
