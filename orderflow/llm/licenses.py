"""License scans by diagonal voting, in DataFrame operations only.

All rolling two-word grams of all texts are joined by their hash with the grams of the templates, a literal
table. A hit at word ``pos`` on template position ``at`` votes for the diagonal ``pos - at``. Votes are
aggregated by document, template and diagonal (partial aggregation runs before the shuffle, which only hits
and one row a document reach). A diagonal with all grams of a phrase is an exact place. Diagonals within
``reach`` words of each other are merged, which joins what inserted or missing words have shifted; a merged
span is accepted if it has enough of the template's grams within a bounded length. Hits compare the words too,
so a hash collision cannot make one.

Defined cases: a null or empty text has no words, no label and score 0; rows are independent, so repeated rows
and ids give a row each; an empty table gives an empty result; other input columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import ascii_lower

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases of the contract and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Usual notices of public licences.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
]
REACH, COVERAGE, STRETCH = 2, 0.7, 1.5


def template_grams(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """``first, second, gram, template, label, base, at, n_grams`` for each word pair of each template."""
    rows = []
    for number, (phrase, label) in enumerate([*BASE, *notices]):
        words = phrase.split()
        for at, pair in enumerate(zip(words, words[1:])):
            rows.append((*pair, number, label, number < len(BASE), at, len(words) - 1))
    kind = "first string, second string, template int, label string, base boolean, at int, n_grams int"
    return spark.createDataFrame(rows, kind).withColumn("gram", F.xxhash64("first", "second"))


def hits(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Votes by document and diagonal, and one row without a template for each document."""
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>")).alias("words"),
    ).withColumn("n_words", F.size("words").cast("bigint"))
    pairs = F.arrays_zip(
        F.col("words").alias("one"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(0))).alias("two")
    )
    grams = words.select("row", "doc_id", "n_words", F.posexplode_outer(pairs).alias("pos", "pair"))
    grams = grams.select("row", "doc_id", "n_words", "pos", F.col("pair")["one"].alias("one"), F.col("pair")["two"].alias("two"))
    table = F.broadcast(template_grams(docs.sparkSession, notices))  # a literal of about a hundred rows
    found = grams.join(
        table,
        (F.xxhash64("one", "two") == F.col("gram")) & (F.col("one") == F.col("first")) & (F.col("two") == F.col("second")),
        "left",
    ).filter(F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    return found.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.when(F.col("template").isNotNull(), F.expr("shiftleft(1L, at)"))).alias("mask"),
        F.min(F.when(F.col("template").isNotNull(), F.col("pos"))).alias("begin"),
        F.max(F.when(F.col("template").isNotNull(), F.col("pos") + 2)).alias("end"),
    )


def spans(votes: DataFrame) -> DataFrame:
    """Neighbouring diagonals of a document and template as one span with all their grams, and the exact
    places in it. The row without a template stays a span of its own."""
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    exact = F.bit_count("mask") == F.col("n_grams")
    return (
        votes.withColumn("starts", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= REACH, 0).otherwise(1))
        .withColumn("group", F.sum("starts").over(along))
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "group")
        .agg(
            F.bit_or("mask").alias("mask"),
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.count_if(exact).alias("n_exact"),
            F.min(F.when(exact, F.col("diagonal"))).alias("first_exact"),
            F.max(F.when(exact, F.col("diagonal"))).alias("last_exact"),
        )
        .withColumn("coverage", F.bit_count("mask") / F.col("n_grams"))
        .withColumn(
            "accepted",
            (F.col("n_exact") > 0)
            | (F.col("coverage") >= COVERAGE) & (F.col("end") - F.col("begin") <= (F.col("n_grams") + 1) * STRETCH),
        )
    )


def license_spans(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Accepted spans: ``doc_id, label, begin, end`` (in words, the end excluded) and ``coverage``."""
    return spans(hits(docs, notices)).filter("accepted").select("doc_id", "label", "begin", "end", "coverage")


def license_scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Per document: words, exact places of the base phrases, their labels, all labels and a score: the share of
    the best accepted template's grams, 0 where nothing is accepted."""
    found = spans(hits(docs, notices)).withColumn("in_base", F.col("base") & (F.col("n_exact") > 0))

    def labels(condition):
        chosen = F.array_sort(F.collect_set(F.when(condition, F.col("label"))))
        return F.array_join(chosen, ",")

    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(F.col("in_base"), F.col("n_exact"))), F.lit(0)).alias("n_base"),
            F.min(F.when(F.col("in_base"), F.col("first_exact"))).cast("bigint").alias("first_word"),
            F.max(F.when(F.col("in_base"), F.col("last_exact"))).cast("bigint").alias("last_word"),
            labels(F.col("in_base")).alias("base_labels"),
            labels(F.col("accepted")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("accepted"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
