"""License scans by diagonal voting.

Each text's rolling word k-gram hashes are joined with the positions of the same hashes in license templates (a table
whose size is fixed by the template list, hence broadcast). A hit votes for the diagonal ``position in text - position in template``;
votes are summed by (document, template, diagonal), diagonals within ``SLACK`` words are merged (words put in or left out),
and a merged span is verified by the share of the template's words its k-grams cover. A diagonal on which all k-grams of a template
hit is a place where the template stands word by word.

Null text counts as empty. Rows that share a doc_id (or have a null one) are scanned as one document whose words are summed and whose places
are pooled. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text

K = 3
#: Words that may be put in or left out between neighbouring diagonals.
SLACK = 4
#: Share of a template's words that a span must cover to give its label.
VERIFIED = 0.8

#: Phrases whose places are counted, with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Public license notices beyond those, with labels.
MORE = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """Lower-cased (A-Z only) words of a text: what stands between ASCII characters other than letters and digits."""
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.filter(F.split(lowered, _PARTS), lambda w: w != "")


def template_positions(spark: SparkSession) -> DataFrame:
    """(gram, template, label, base, t, grams): one row for each k-gram of each template; at most a few hundred rows."""
    rows = []
    for i, (label, phrase) in enumerate(BASE + MORE):
        words = phrase.split()
        grams = [" ".join(words[t : t + K]) for t in range(len(words) - K + 1)]
        rows += [(g, i, label, i < len(BASE), t, len(grams)) for t, g in enumerate(grams)]
    table = spark.createDataFrame(rows, "gram string, template int, label string, base boolean, t int, grams int")
    return table.select(F.xxhash64("gram").alias("hash"), "*")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans): spans is an array of (label, base, first, last, hits, grams, coverage), verified or not.

    ``coverage`` is the share of the template's words covered by k-grams of the merged diagonals from word ``first`` to ``last``.
    """
    spark = docs.sparkSession
    words = id_and_text(docs).select("doc_id", words_of("text").alias("w"))
    # one element more than k-grams: it carries the number of words and always joins, so no second scan is needed
    size = F.size("w")
    gram = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    hits = F.when(size >= K, F.transform(F.sequence(F.lit(0), size - K), lambda i: F.struct(i.cast("int").alias("pos"), gram(i).alias("gram"))))
    empty = F.array().cast("array<struct<pos:int,gram:string>>")
    total = F.array(F.struct(size.cast("int").alias("pos"), F.lit(None).cast("string").alias("gram")))
    each = words.select("doc_id", F.explode(F.concat(F.coalesce(hits, empty), total)).alias("g")).select("doc_id", "g.pos", "g.gram")
    each = each.withColumn("hash", F.when(F.col("gram").isNotNull(), F.xxhash64("gram")).otherwise(F.lit(0)))
    templates = template_positions(spark).withColumnRenamed("gram", "t_gram")
    templates = templates.unionByName(spark.createDataFrame([(0,)], "hash long"), allowMissingColumns=True)
    voted = each.join(F.broadcast(templates), "hash").filter(F.col("gram").eqNullSafe(F.col("t_gram")))
    diagonals = voted.groupBy("doc_id", "template", (F.col("pos") - F.coalesce("t", F.lit(0))).alias("diag")).agg(
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.max("grams").alias("grams"),
        F.count("t").alias("votes"),
        F.min("pos").alias("low"),
        F.max("pos").alias("high"),
        F.collect_set("t").alias("ts"),  # bounded by the template's length
        F.sum(F.when(F.col("t").isNull(), F.col("pos"))).alias("words"),
    )
    near = Window.partitionBy("doc_id", "template").orderBy("diag")
    fresh = F.when(F.col("template").isNull() | (F.col("diag") - F.lag("diag").over(near) <= SLACK), 0).otherwise(1)
    merged = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(near))
    # all of a template's k-grams voted for this very diagonal: it stands here word by word
    whole = (F.size("ts") == F.col("grams")) & F.col("template").isNotNull()
    spans = merged.groupBy("doc_id", "template", "span").agg(
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.max("grams").alias("grams"),
        F.min("low").alias("first"),
        (F.max("high") + K - 1).alias("last"),
        F.sum(whole.cast("long")).alias("places"),
        F.min(F.when(whole, F.col("diag"))).alias("first_place"),
        F.max(F.when(whole, F.col("diag"))).alias("last_place"),
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
        F.sum("words").alias("words"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + K - 1)))))
    spans = spans.withColumn("coverage", F.when(F.size("ts") > 0, covered / (F.col("grams") + K - 1)).otherwise(F.lit(0.0)))
    one = F.struct("label", "base", "first", "last", "coverage", "places", "first_place", "last_place")
    return spans.groupBy("doc_id").agg(
        F.sum("words").cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("template").isNotNull(), one)).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts of base phrases, base and verified labels, and the best coverage as score."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s.base & (s.places > 0))
    good = F.filter("spans", lambda s: s.coverage >= VERIFIED)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(F.transform(base, lambda s: s.places), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min(F.transform(base, lambda s: s.first_place)).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s.last_place)).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, good)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"),
        good.alias("verified"),
    )
