"""License notices by diagonal voting over word k-grams.

Every rolling k-gram of a document's words is joined by hash with the k-grams of
the templates and compared word by word. A hit at word p for template position t
votes for the diagonal p - t: a verbatim copy puts all its votes on one
diagonal, an inserted or missing word moves the rest to a neighbour. Neighbouring
diagonals of a template are merged and the merged span is verified by the share
of the template's k-grams it holds. A phrase counts where one diagonal has all
its k-grams, which is the phrase word for word.

Only DataFrame functions run here. Documents are read once; what is shuffled is
one small row for each document and one for each hit. The template side is
broadcast: it is bounded by ``TEMPLATE_GRAMS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM = 3
#: Most k-grams all templates may have together; more is refused, since the table is broadcast.
TEMPLATE_GRAMS = 100_000
#: Diagonals at most this far apart belong to one copy.
NEIGHBOURS = 6
#: Share of a template's k-grams that a span must hold.
COVERED = 0.7

# --- fixed values: phrases that must stand word for word, and standard notices -----
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
# -----------------------------------------------------------------------------------


def words_of(text) -> object:
    """Lower-cased words: everything but ASCII characters other than letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, phrase, grams, at, t0, t1, t2): one row for each k-gram of each template."""
    rows = []
    for number, (label, text, phrase) in enumerate([(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in notices]):
        words = text.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        grams = len(words) - GRAM + 1
        rows += [(number, label, phrase, grams, at, *words[at : at + GRAM]) for at in range(grams)]
    if len(rows) > TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; at most {TEMPLATE_GRAMS} are allowed")
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, at int, t0 string, t1 string, t2 string")


def license_spans(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each document and found span, and one without a span for each document.

    (row, doc_id, n_words, label, phrase, first_word, last_word, coverage):
    ``row`` tells rows of ``docs`` (doc_id, text, any others) apart, also
    repeated ones. first_word and last_word bound the span in words from 0. Null
    and empty texts have no words and no spans; other columns are not read.
    """
    grams = template_grams(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    grams = F.broadcast(grams.withColumn("hash", F.xxhash64("t0", "t1", "t2")))
    worded = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    n = F.greatest(F.size("words") - (GRAM - 1), F.lit(0))
    rolling = F.arrays_zip(*[F.slice("words", k + 1, n).alias(f"w{k}") for k in range(GRAM)])
    placed = worded.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(rolling).alias("pos", "gram"))
    placed = placed.select("row", "doc_id", "n_words", "pos", *[F.col("gram")[f"w{k}"].alias(f"w{k}") for k in range(GRAM)])
    hits = placed.withColumn("hash", F.xxhash64("w0", "w1", "w2")).join(grams, "hash", "left").where(
        "pos is null or pos = 0 or (w0 = t0 and w1 = t1 and w2 = t2)")
    found = F.expr("w0 = t0 and w1 = t1 and w2 = t2")
    voted = hits.withColumn("at", F.when(found, F.col("at"))).withColumn("template", F.when(found, F.col("template")))
    diagonals = voted.groupBy("row", "doc_id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("at").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"),
        *[F.any_value(c).alias(c) for c in ("label", "phrase", "grams")])

    by = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOURS) | F.col("template").isNull()
    runs = diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.any_value(c).alias(c) for c in ("label", "phrase", "grams")])
    coverage = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    verified = F.col("template").isNotNull() & F.when(F.col("phrase"), F.col("votes") == F.col("grams")).otherwise(
        (coverage >= COVERED) & (F.col("last") - F.col("first") < 2 * (F.col("grams") + GRAM - 1)))
    return spans.select("row", "doc_id", "n_words", *[F.when(verified, c).alias(name) for c, name in (
        (F.col("label"), "label"), (F.col("phrase"), "phrase"), (F.col("first").cast("long"), "first_word"),
        (F.col("last").cast("long"), "last_word"), (coverage, "coverage"))])


def license_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: places and labels of the phrases, all labels, and the best coverage as score."""
    spans = license_spans(docs)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    phrase = F.col("phrase")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(phrase, 1)).alias("n_base"), F.min(F.when(phrase, F.col("first_word"))).alias("first_word"),
        F.max(F.when(phrase, F.col("first_word"))).alias("last_word"), labels(F.when(phrase, F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score")).drop("row")
