"""License scan: an exact set-similarity join of text blocks and notice templates, in DataFrame functions only.

A block begins with a line of a text: it holds the line's words and, for a
template of k words, the k words behind the line. A notice is thus found in one
line as well as wrapped over several. A block matches a template where it holds at
least THRESHOLD of the template's distinct words. The join finds every such pair:

- global order: template words are ranked by how often they occur in all texts,
  counted in one pass with map-side combination; ties go by the word.
- prefix filter: a match must hold one of a template's rarest
  size - needed + 1 words, so texts without any such word are left at once, and
  blocks of the others are joined on those words only. The templates are a
  parameter, their words a few hundred rows, and are broadcast for that reason.
- length filter: a block must have as many distinct words as are needed.
- positional filter: in the global order, the words behind the first common one
  must suffice on both sides.
- what is left is verified by the exact intersection.

Texts are brought to words with blanks between them and line ends once, in a
stored table from which all else is read; the phrase count is made beside it.
Results in edge cases: a null or empty text has no words; lines without words are
no blocks; a text of one very long line is one block; repeated rows get equal
results; an empty table gives an empty result; without templates only phrases
give labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words within a line: all of ASCII but letters, digits and the line feed.
GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses (fixed values), in lower case and without punctuation.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
)
THRESHOLD = 0.9


def lines_of(text: Column) -> Column:
    """The words of a text with one blank between them, or one line feed where they are of different lines, and none at the ends."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " ")
    return F.btrim(F.regexp_replace(plain, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def _spaced(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and lines of each row of docs (doc_id, text_hash, text)."""
    return docs.select("doc_id", "text_hash", lines_of(F.col("text")).alias("lines"))


def _base(spaced: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels of each row."""
    line = spaced.select("doc_id", "text_hash", F.translate("lines", "\n", " ").alias("words"))
    count = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long")
    # each word gets a blank of its own on either side, so neighbours share none
    spaced = F.when(F.contains("words", F.lit("license")), F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" ")))
    line = line.select("doc_id", "text_hash", count.alias("n_words"), spaced.alias("spaced"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    number, first, last, label = [], [], [], []
    for phrase, name in PHRASES:
        own = " " + phrase.replace(" ", "  ") + " "
        has = F.contains("spaced", F.lit(own))
        number.append(F.when(has, (F.length("spaced") - F.length(F.replace("spaced", F.lit(own), F.lit("")))) / len(own)).otherwise(0).cast("long"))
        first.append(F.when(has, (blanks(F.substring_index("spaced", own, 1)) / 2).cast("long")))
        last.append(F.when(has, F.col("n_words") - len(phrase.split()) - (blanks(F.substring_index("spaced", own, -1)) / 2).cast("long")))
        label.append(F.when(has, F.lit(name)))
    return line.select(
        "doc_id",
        "text_hash",
        "n_words",
        sum(number[1:], number[0]).alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*label)).alias("base"),
    )


def _blocks(spaced: DataFrame, behind: int, rare: Column) -> DataFrame:
    """For each line that has words: how many, and these words with up to `behind` more that follow; blocks without a rare word are left out."""
    lines = spaced.where("lines <> ''").select("doc_id", "text_hash", F.transform(F.split("lines", "\n"), lambda x: F.split(x, " ")).alias("all"))
    # each line has a word at least, so as many lines as words suffice
    more = lambda i: F.slice(F.flatten(F.slice("all", i + 2, behind)), 1, behind)
    block = F.transform("all", lambda x, i: F.struct(i.alias("block"), F.size(x).alias("own"), F.concat(x, more(i)).alias("words")))
    return lines.select("doc_id", "text_hash", F.explode(F.filter(block, lambda x: F.arrays_overlap(x["words"], rare))).alias("b")).select("doc_id", "text_hash", "b.*")


def frequencies(spaced: DataFrame, words: set[str]) -> dict[str, int]:
    """How often each of the given words occurs in all texts. At most as many rows as words come to the driver."""
    spark = spaced.sparkSession
    asked = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    seen = spaced.select(F.explode(F.split(F.translate("lines", "\n", " "), " ")).alias("token")).join(F.broadcast(asked), "token")
    return {r.token: r.n for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, block, template, label, common, containment) for each block and template that meet the threshold. docs: doc_id, text_hash, text."""
    return _matches(stored(_spaced(docs), "lines"), templates, threshold)


def _listed(templates) -> list[tuple[str, str]]:
    """Templates may be a table (text, label); it is small and comes to the driver."""
    return [(r.text, r.label) for r in templates.select("text", "label").collect()] if isinstance(templates, DataFrame) else list(templates)


def _matches(spaced: DataFrame, templates, threshold: float) -> DataFrame:
    spark = spaced.sparkSession
    sets = [(sorted(set(t.split())), label, len(t.split())) for t, label in _listed(templates)]
    seen = frequencies(spaced, {w for s, *_ in sets for w in s})
    order = sorted({w for s, *_ in sets for w in s}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefix, cut = [], []
    for number, (own, label, length) in enumerate(sets):
        own = sorted(own, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        cut += own[: len(own) - need + 1]
        prefix += [(own[j], rank[own[j]], j, number, label, own, need, length) for j in range(len(own) - need + 1)]
    index = spark.createDataFrame(prefix, "token string, rank int, place int, template int, label string, template_words array<string>, need int, length int")
    rare = F.array(*(F.lit(w) for w in sorted(set(cut)))) if cut else F.array().cast("array<string>")

    # a text without any prefix word holds no match: what is left is cut into blocks
    near = spaced.where(F.arrays_overlap(F.split(F.translate("lines", "\n", " "), " "), rare)) if cut else spaced.limit(0)
    blocks = _blocks(near, max((x[2] for x in sets), default=1), rare)
    hit = blocks.withColumn("token", F.explode(F.array_intersect("words", rare))).join(F.broadcast(index), "token")
    # template words come in the global order, and so do those that the block has of them
    hit = hit.withColumn("tokens", F.array_distinct(F.slice("words", 1, F.col("own") + F.col("length")))).where(F.size("tokens") >= F.col("need"))
    hit = hit.withColumn("both", F.array_intersect("template_words", "tokens"))
    # the words before the joined one can only add what they have in common, so the first common word alone must pass
    first = F.element_at("both", 1) == F.col("token")
    behind = F.least(F.size("tokens"), F.size("template_words") - F.col("place"))
    return (
        hit.where((F.size("both") > 0) & (behind >= F.col("need")))
        .where(first & (F.size("both") >= F.col("need")))
        .select("doc_id", "text_hash", "block", "template", "label", F.size("both").alias("common"), (F.size("both") / F.size("template_words")).alias("containment"))
    )


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_hash"), F.col(text).alias("text"))
    spaced = stored(_spaced(own), "lines")
    # where a block holds several templates, such as one notice within another, the one with most words names it
    by_line = _matches(spaced, templates, threshold).groupBy("doc_id", "text_hash", "block").agg(F.max_by("label", F.struct("common", "template")).alias("label"), F.max("containment").alias("best"))
    found = by_line.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("label").alias("found"), F.max("best").alias("best"))
    joined = _base(spaced).join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    text_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        text_of("base").alias("base_labels"),
        text_of(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
