"""Licence scan by an exact set-similarity join: blocks of a text that hold enough of the words of a
template, found with prefix, length and positional filters over globally ordered words. A block is a
window of words about as long as the template, wherever the text breaks its lines."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.text import let
from draftlake.llm.common import row_keys, whole

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base rule and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates of the join (label, text): usual notices of public licences, own selection.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved, no part of this work may be reproduced without permission"),
)

THRESHOLD = 0.8
#: Places of a chunk at which windows start; a chunk goes on until the last of them is whole.
CHUNK = 256
#: The only letter beyond ASCII (Kelvin sign) whose lower case is an ASCII letter; it stays as it is.
KELVIN = "\u212a"


def spaced(text: Column) -> Column:
    """The words of the text in lower case with one space before each and one at the end. Letters
    beyond ASCII are word characters in either case and no letter of a phrase or template, so it does
    not matter that their case changes too; the one that would become a "k" is put aside first."""
    plain = F.lower(F.replace(text, F.lit(KELVIN), F.lit("\u00e5")))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, SEPARATORS, " ")), F.lit(" "))


def word_count(words: Column) -> Column:
    """Number of words of a spaced text."""
    return F.when(F.length(words) <= 2, 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) - 1).cast("bigint")


def phrase_places(words: Column) -> Column:
    """Struct (n, first, last, labels) of the places of the base phrases in a spaced text. No two of
    the phrases can overlap, so the leftmost places are all of them; the spaces before a place count
    the words before it."""
    pattern = " (?:" + "|".join(PHRASES) + ")(?= )"
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")
    none = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"),
        F.array().cast("array<string>").alias("labels"),
    )
    table = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])

    def of(hits: Column) -> Column:
        return let(F.split(words, pattern, -1), lambda gaps: F.struct(
            F.size(hits).cast("bigint").alias("n"),
            spaces(F.element_at(gaps, 1)).alias("first"),
            (spaces(words) - 1 - (spaces(F.element_at(gaps, -1)) - 1) - spaces(F.element_at(hits, -1))).alias("last"),
            F.array_distinct(F.transform(hits, lambda h: F.element_at(table, F.btrim(h)))).alias("labels"),
        ))

    return F.when(words.rlike(pattern), let(F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def template_words(text: str) -> set[str]:
    return {w for w in re.split(SEPARATORS, text.lower()) if w}


def window_words(text: str, threshold: float = THRESHOLD) -> int:
    """Words of a block: those of the template, repeats included, and as many more as it may lack."""
    return math.ceil(sum(1 for w in re.split(SEPARATORS, text) if w) / threshold - 1e-9)


def word_frequency(docs: DataFrame, text: str, templates=TEMPLATES) -> dict[str, int]:
    """Number of documents with each word of the templates, over the whole corpus. The driver gets
    one row per word of the templates."""
    vocabulary = sorted(set().union(*(template_words(t) for _, t in templates)))
    found = docs.select(F.explode(F.array_intersect(F.split(spaced(whole(text)), " "), F.lit(vocabulary))).alias("word"))
    return {w: 0 for w in vocabulary} | {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def prefix_index(frequency: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(word, template, label, words, place, size, need, window) for the prefix of each template: in
    the global order (rarest first, ties by the word) a block with ``need`` of the ``size`` words
    holds one of the first size - need + 1."""
    out = []
    for i, (label, text) in enumerate(templates):
        words = sorted(template_words(text), key=lambda w: (frequency[w], w))
        need = math.ceil(len(words) * threshold - 1e-9)
        window = window_words(text, threshold)
        out += [(w, i, label, words, k, len(words), need, window) for k, w in enumerate(words[:len(words) - need + 1])]
    return out


def chunks(words: Column, longest: int) -> Column:
    """The words cut into chunks of ``CHUNK`` places, each with the words that windows starting there
    still reach. A chunk holds at most CHUNK + longest words, whatever the text."""
    return let(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(w, c * CHUNK + 1, F.lit(CHUNK + longest - 1)),
    ))


def best_window(part: Column, words: Column, window: Column) -> Column:
    """Struct (shared, back) of the window of a chunk with most distinct ``words``; ``back`` is minus
    its place, so the first of equal windows wins. A window that starts between words of the template
    holds no more than the one that starts at the next of them."""
    places = F.sequence(F.lit(0), F.least(F.size(part), F.lit(CHUNK)) - 1)
    starts = F.filter(places, lambda i: F.array_contains(words, F.get(part, i)))
    return F.array_max(F.transform(starts, lambda i: F.struct(
        F.size(F.array_intersect(words, F.slice(part, i + 1, window))).alias("shared"), (-i).alias("back"),
    )))


def block_matches(
    docs: DataFrame, key: list[str], text: str = "text", *, templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, block, label, shared, score) of every template of which a block of the text holds at least
    ``threshold`` of the distinct words; per chunk of the text the best block, ``block`` is the place of
    its first word, from 0.

    Chunks with a prefix word meet the prefix index on that word; the index has a few rows per
    template, whatever the corpus, so it is broadcast. Length filter: the chunk has ``need`` words of templates.
    Positional filter: from the shared word on, both sides still have ``need`` words. Only the
    rarest shared word makes the pair, so each pair is verified once, window by window."""
    spark = docs.sparkSession
    frequency = word_frequency(docs, text, templates)
    rows = prefix_index(frequency, templates, threshold)
    index = spark.createDataFrame(
        rows, "word string, template int, label string, t_words array<string>, t_place int, size int, need int, window int")
    order = F.lit(sorted(frequency, key=lambda w: (frequency[w], w)))
    first = F.lit(sorted({r[0] for r in rows}))
    words = F.split(F.btrim(spaced(whole(text))), " ")
    cut = docs.where(F.arrays_overlap(words, first)).select(
        *key, F.posexplode(chunks(words, max(r[7] for r in rows))).alias("chunk", "part"))
    held = cut.select(*key, "chunk", "part", F.array_intersect(order, "part").alias("b_words"))
    each = held.select(*key, "chunk", "part", "b_words", F.posexplode("b_words").alias("b_place", "word"))
    left = F.least(F.col("size") - F.col("t_place"), F.size("b_words") - F.col("b_place"))
    common = F.array_intersect("t_words", "b_words")
    pairs = each.join(F.broadcast(index), "word").where((F.size("b_words") >= F.col("need")) & (left >= F.col("need")))
    alike = pairs.where((F.element_at(common, 1) == F.col("word")) & (F.size(common) >= F.col("need")))
    return (
        alike.withColumn("best", best_window(F.col("part"), F.col("t_words"), F.col("window")))
        .where(F.col("best.shared") >= F.col("need"))
        .select(
            *key, (F.col("chunk") * CHUNK - F.col("best.back")).alias("block"), "label", F.col("best.shared").alias("shared"),
            (F.col("best.shared") / F.col("size")).alias("score"),
        )
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with a struct ``licence`` (n_words, n_base, first_word, last_word,
    base_labels, labels, score).

    ``score`` is the best containment of a block, 1 where a base phrase stands, else 0. Line feeds do
    not matter: a notice wrapped over lines is met as a whole, and words strewn over a long line are not. Null or empty
    text has no word and no label; null ids are allowed; repeated rows get equal results (matches are
    combined by id and text); an empty table gives an empty table; extra columns pass through."""
    key = row_keys(doc_id, text)
    keyed = docs.select(*key, F.col(text).alias("__text"))
    found = block_matches(keyed, ["__i", "__h"], "__text", templates=templates, threshold=threshold)
    best = found.groupBy("__i", "__h").agg(F.collect_set("label").alias("__labels"), F.max("score").alias("__score"))
    rest = [c for c in docs.columns if c != "licence"]
    base = docs.select(*rest, *key, spaced(whole(text)).alias("__words"))
    base = base.select(*rest, "__i", "__h", word_count(F.col("__words")).alias("__n"), phrase_places(F.col("__words")).alias("__p"))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return base.join(best, ["__i", "__h"], "left").select(*rest, F.struct(
        F.col("__n").alias("n_words"), F.col("__p.n").alias("n_base"), F.col("__p.first").alias("first_word"), F.col("__p.last").alias("last_word"),
        join(F.col("__p.labels")).alias("base_labels"),
        join(F.concat(F.col("__p.labels"), F.coalesce("__labels", none))).alias("labels"),
        F.when(F.col("__p.n") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    ).alias("licence"))
