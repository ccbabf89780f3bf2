"""License scans by diagonal voting, in DataFrame operations alone.

Templates (license names and notices) are cut to rolling word k-grams. Every k-gram of a text that hashes like one of a
template is joined to the template's places of that k-gram, and the text of both is compared. A pair of places votes for the
diagonal on which the template would begin, its place in the text less that in the template. Votes are summed by diagonal,
neighbouring diagonals are merged, since words put in or left out shift the rest of a notice, and a merged span is verified:
the share of the template's k-grams that it holds must reach what the template asks for.

A text's words are split once, in one scan; only the few k-grams that may be a template's leave it. They are shuffled once,
by document, and all counting stays there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_below, row_key

#: What lies between words, after A-Z were lower-cased (fixed values).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Templates of so many words and more are cut to LONG_GRAM words, shorter ones to SHORT_GRAM.
_LONG, SHORT_GRAM, LONG_GRAM = 16, 2, 4
# Share of a notice's k-grams that a span must hold.
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A text to look for. ``share``: of its k-grams, how many a span must hold; a ``base`` template is a plain phrase."""

    label: str
    text: str
    share: float = SHARE
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", self.text.translate({c: c + 32 for c in range(65, 91)}))

    @property
    def gram(self) -> int:
        return LONG_GRAM if len(self.words) >= _LONG else SHORT_GRAM

    @property
    def grams(self) -> list[str]:
        words = self.words
        return [" ".join(words[i : i + self.gram]) for i in range(len(words) - self.gram + 1)]

    @property
    def slack(self) -> int:
        """Diagonals this far apart are neighbours: none for a phrase."""
        return 0 if self.base else len(self.words) // 8


#: The phrases of the three base labels (fixed values).
PHRASES = [
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
]

#: Opening words of public license notices (fixed values). Where one word makes the label, all words are asked for.
NOTICES = [
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("mit-name", "Released under the MIT License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl-2.0", "GNU General Public License, version 2", 1.0),
    Template("gpl-3.0", "GNU General Public License, version 3", 1.0),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("agpl", "under the terms of the GNU Affero General Public License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "Creative Commons Attribution 4.0 International License", 1.0),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]

TEMPLATES = PHRASES + NOTICES


def _grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``template, k, t, gram``: every place of every template's k-grams, hinted for broadcast if they are few."""
    rows = [(n, p.gram, t, g) for n, p in enumerate(templates) for t, g in enumerate(p.grams)]
    if any(not p.grams for p in templates):
        raise ValueError(f"a template has at least {SHORT_GRAM} words")
    size = sum(len(r[3].encode()) + 64 for r in rows)
    table = spark.createDataFrame(rows, "template int, k int, t int, gram string").withColumn("h", F.xxhash64("gram"))
    return broadcast_if_below(table, len(rows), -(-size // len(rows)))


def _lower(text: Column) -> Column:
    """Lower-case words as far as templates can tell: Kelvin signs and dotted capitals, which would become ASCII letters, stay."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("K") | text.contains("İ"), plain).otherwise(F.lower(text))


def _candidates(docs: DataFrame, templates: list[Template], starts: DataFrame) -> DataFrame:
    """``doc_id, th, n_words, p, k, gram``: for every row of ``docs`` one row without a place (``p`` is null) and one for each
    k-gram that begins like a template's."""
    words = row_key(docs).select("doc_id", "th", F.split(_lower(F.coalesce("text", F.lit(""))), _BETWEEN).alias("ws"))
    empty_first = (F.get("ws", F.lit(0)) == "").cast("int")
    empty_last = ((F.size("ws") > 1) & (F.element_at("ws", -1) == "")).cast("int")
    words = words.withColumns({"first": empty_first, "n_words": F.size("ws") - empty_first - empty_last})
    begin = lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1))
    known = [r[0] for r in starts.collect()]  # as many as the templates have k-grams
    at = words.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: begin(i).isin(known)))
    sizes = sorted({p.gram for p in templates})

    def of_size(k: int) -> Column:
        gram = lambda i: F.struct((i - F.col("first")).alias("p"), F.lit(k).alias("k"), F.array_join(F.slice("ws", i + 1, k), " ").alias("gram"))
        return F.transform("at", gram)

    none = F.array(F.struct(F.lit(None).cast("int").alias("p"), F.lit(0).alias("k"), F.lit("").alias("gram")))
    hits = F.concat(none, *[of_size(k) for k in sizes])
    return at.select("doc_id", "th", "n_words", F.explode(hits).alias("hit")).select("doc_id", "th", "n_words", "hit.*")


def _spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """``doc_id, th, n_words, copies, template, start, end, share``: verified spans, and for every different row of ``docs``
    one row without a template but with the number of its ``copies``."""
    spark = docs.sparkSession
    grams = _grams(spark, templates)
    starts = spark.createDataFrame(sorted({tuple(g.split(" ")[:2]) for p in templates for g in p.grams}), "a string, b string")
    found = _candidates(docs, templates, starts.select(F.xxhash64("a", "b")))
    found = found.withColumn("h", F.xxhash64("gram")).alias("d").join(
        grams.alias("g"), F.expr("d.h = g.h AND d.k = g.k AND d.gram = g.gram"), "left")
    found = found.filter("p IS NULL OR template IS NOT NULL").select("doc_id", "th", "n_words", "p", "d.k", "template", "t")
    # from here on everything about a document is in one place
    placed = found.withColumn("diagonal", F.col("p") - F.col("t")).repartition("doc_id", "th")
    key = ["doc_id", "th", "template"]
    votes = placed.groupBy(*key, "diagonal", "t", "k").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    slack = F.element_at(F.array(*[F.lit(p.slack) for p in templates]), F.col("template") + 1)
    n_grams = F.element_at(F.array(*[F.lit(len(p.grams)) for p in templates]), F.col("template") + 1)
    needed = F.element_at(F.array(*[F.lit(float(p.share)) for p in templates]), F.col("template") + 1)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True)).cast("int")
    merged = votes.withColumn("_new", apart).withColumn("span", F.sum("_new").over(along.rangeBetween(Window.unboundedPreceding, 0)))
    return (
        merged.groupBy(*key, "span").agg(
            F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.countDistinct("t").alias("held"),
            F.min(F.col("diagonal") + F.col("t")).alias("start"), F.max(F.col("diagonal") + F.col("t") + F.col("k")).alias("end"))
        .withColumn("share", F.when(F.col("template").isNotNull(), F.col("held") / n_grams))
        .filter(F.col("template").isNull() | (F.col("share") >= needed))
        .select("doc_id", "th", "n_words", "copies", "template", "start", "end", "share")
    )


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``doc_id, th, label, start, end, share``: the spans (words from 0, end exclusive) of the different rows of ``docs`` that
    hold enough of a template; ``th`` is ``xxhash64`` of the text. A null or empty text has none."""
    labels = F.array(*[F.lit(p.label) for p in templates])
    spans = _spans(docs, templates).filter("template IS NOT NULL")
    return spans.select("doc_id", "th", F.element_at(labels, F.col("template") + 1).alias("label"), "start", "end", "share")


def license_report(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: for every row its words, the places of
    base phrases with the smallest and largest, the labels of these and of all templates found (different ones, sorted,
    comma-joined) and the largest share of a template that one span holds (0 without a span, 1 with a phrase).

    Every row of ``docs`` comes back, as often as it comes, rows without an id too; an empty table gives an empty one. A null
    or empty text has no words and no labels. Texts of any length are scanned whole. Columns other than ``doc_id`` and
    ``text`` are not looked at. A template longer than a phrase is found with words changed, put in or left out as long as
    its share is reached.
    """
    labels = F.element_at(F.array(*[F.lit(p.label) for p in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(p.base) for p in templates]), F.col("template") + 1)
    found = F.col("template").isNotNull()  # a document's row without a template has no label and is no phrase
    of_base = lambda x: F.when(found & base, x)
    # a document's spans may be many, its labels are at most as many as templates
    each = _spans(docs, templates).groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count(of_base(F.lit(1))).alias("n_base"), F.min(of_base(F.col("start"))).cast("long").alias("first_word"),
        F.max(of_base(F.col("start"))).cast("long").alias("last_word"), F.collect_set(of_base(labels)).alias("base_labels"),
        F.collect_set(F.when(found, labels)).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    result = each.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return result.drop("_copy")
