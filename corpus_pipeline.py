"""The cleaning pipeline over documents: toxicity, near-duplicates, repeated substrings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the last return
the columns of documents; ``n_chars`` follows the text.

In every stage: null text is treated as empty and stays null where a text is returned; rows with a null doc_id take part; texts are read whole, however
long; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaksetu.llm import packing, pseudonyms, simhash, substring_dedup, toxicity
from vaksetu.llm.common import materialize, read_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    It learns from those rows of ``labels`` whose documents are in ``docs``; without both classes among them nothing is dropped. Each row is judged by its own text, so rows that repeat stay or go together.
    """
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id (null only if all are), of repeated rows one.

    All texts without words (null and empty ones) are one class, so one of them stays.
    """
    return simhash.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand anywhere else, too: every copy goes, also within one document. Rows stay, if with an empty text; shorter texts lose nothing."""
    return substring_dedup.without_duplicates(docs.select(*COLUMNS)).transform(_like_documents)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates, addresses and secrets, under the session's ``spark.corpus.pseudonymKey`` (unset: the key for demonstrations, which is public). Rows stay."""
    key = spark.conf.get("spark.corpus.pseudonymKey", pseudonyms.DEFAULT_KEY)
    return pseudonyms.pseudonymise(docs.select(*COLUMNS), key).transform(_like_documents)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into training sequences; every row is packed, an empty text as its end id. Ties in length go by rank."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
