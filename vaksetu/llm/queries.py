"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, exact_topk, gif_media, license_scan, packing, pfor, pseudonyms, simhash, substring_dedup, toxicity
from .common import read_documents


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = gif_media.read_back(gif_media.store(read_documents(spark, sf_dir)))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("ms="), "shown_ms"), F.concat(F.lit("grey="), F.array_join("grey", ",")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_simhash_ball_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_license_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read_documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate_substrings(read_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").alias("n_factors"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.round_trip(read_documents(spark, sf_dir))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(read_documents(spark, sf_dir, "doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda h: h.kind == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *[count(k) for k in pseudonyms.KINDS])


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(read_documents(spark, sf_dir))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_gif_media,
        op2_simhash_ball_dedup,
        op3_license_diagonal_voting,
        op4_rlz_substring_dedup,
        op5_toxicity_cnn,
        op6_pfor_token_files,
        op7_feistel_pseudonyms,
        op8_bpe_transducer,
        op9_exact_topk,
        op10_best_fit_packing,
    )
}

#: DuckDB SQL where it can express the query over whole tables.
ORACLES = {
    # floor(1024 * x) is exact in doubles; sums of at most 2**53 are exact, too
    "op9_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
