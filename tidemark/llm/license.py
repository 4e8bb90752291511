"""License scans: fixed phrases, and an exact containment join of text blocks with license templates.

A block is a line of the text (or lines_per_block lines from each line on). A template matches a block that holds at least the
threshold's share of its distinct words. Only words of templates can count, so a block is cut down to those, which changes no
containment. The words are ordered by how many blocks of the corpus hold them, rarest first. A block with enough
words of a template must hold one of the template's first m - need + 1 (prefix filter), at least need words at all (length filter),
and at a place that leaves room for need common words (positional filter). What passes is counted exactly. The templates are a
parameter of a few hundred words, so what is broadcast or collected is bounded by them and not by the corpus.

With windows, runs of words at every place of a text count as well, line ends ignored, each as long as the template may be where
the threshold's share of its words is the template's. A run with enough words of a template also holds one of its first
m - need + 1, so only the surroundings of those are looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, saved, small, spaced, word_list

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Lines of license notices.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike License"],
    "gpl": ["This work is licensed under the GNU General Public License", "either version 3 of the License, or at your option any later version"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
}
#: The most words that all templates together may have; they are held in plans and broadcast.
MAX_TEMPLATE_WORDS = 20_000


def words_of(text: str) -> list[str]:
    """Distinct words of a template, by the word rule of the texts."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sorted(set(filter(None, re.split(GAP, low))))


def need(m: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * m - 1e-9))


def run_length(text: str, threshold: float) -> int:
    """How many words a run may have of which the threshold's share is the template's."""
    return math.ceil(len(list(filter(None, re.split(GAP, text.lower())))) / threshold)


def _starts(words: Column, parts: list[str]):
    """For a word and its place: the place, if the parts of a phrase stand from there on."""

    def at(w: Column, i: Column) -> Column:
        same = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(same, i)

    return at


def phrase_columns(line: Column, words: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels, of a line made by spaced() and its words."""
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    found, labels = [], []
    for phrase, label in phrases.items():
        there = F.contains(padded, F.lit(f" {phrase} "))
        parts = phrase.split(" ")

        none = F.array().cast("array<int>")
        found.append(F.when(there, F.filter(F.transform(words, _starts(words, parts)), lambda i: i.isNotNull())).otherwise(none))
        labels.append(F.when(there, F.lit(label)))
    found = found or [F.array().cast("array<int>")]
    return {"_places": F.concat(*found), "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels, F.lit(None).cast("string")))))}


def blocks(text: Column, lines_per_block: int = 1) -> Column:
    """The blocks of a text as lines of words."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    if lines_per_block == 1:
        return F.transform(lines, spaced)
    return F.flatten(F.transform(F.array(lines), lambda ls: F.transform(ls, lambda _, i: spaced(F.array_join(F.slice(ls, i + 1, lines_per_block), " ")))))


def word_frequencies(df: DataFrame, vocabulary: list[str], text: str = "text", lines_per_block: int = 1) -> DataFrame:
    """In how many blocks of the corpus each of these words stands: word, n; words that stand nowhere are left out."""
    per_block = F.transform(blocks(F.col(text), lines_per_block), lambda b: F.array_distinct(F.filter(F.split(b, " "), lambda w: w.isin(vocabulary))))
    return df.select(F.explode(F.flatten(per_block)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def containment_join(df: DataFrame, keys: list[str], templates: Mapping[str, list[str]], threshold: float, text: str = "text", lines_per_block: int = 1, windows: bool = False) -> DataFrame:
    """Every pair of a block and a template that it contains: keys, block (from 0), label, containment.

    keys name columns of df that stay with a block. A text may match a label by several of its templates; each is a row. With windows
    come rows, without a block, for the best run of words around each place of a template's rarest words.
    """
    templates = {label: [t for t in texts if words_of(t)] for label, texts in templates.items()}  # one without words is in no text
    sides = [(label, words_of(t)) for label, texts in sorted(templates.items()) for t in texts]
    vocabulary = sorted({w for _, ws in sides for w in ws})
    if not vocabulary:  # no template, nothing to find
        return df.select(*keys, F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).where("false")
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} words; more than {MAX_TEMPLATE_WORDS} are not held in a plan")
    counts = {r["word"]: r["n"] for r in word_frequencies(df, vocabulary, text, lines_per_block).collect()}  # a row for each template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [(label, sorted(rank[w] for w in ws)) for label, ws in sides]
    prefix = [(i, t, r, p, len(ws), need(len(ws), threshold), ws, label) for t, (label, ws) in enumerate(ordered) for p, r in enumerate(ws[: len(ws) - need(len(ws), threshold) + 1]) for i in [r]]
    spark = df.sparkSession
    index = spark.createDataFrame([(r, t, p, m, n, ws, label) for _, t, r, p, m, n, ws, label in prefix], "rank int, template int, place int, m int, need int, words array<int>, label string")
    first = sorted({w for w in vocabulary if rank[w] in {x[0] for x in prefix}})
    least = min(x[5] for x in prefix)
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])

    own = F.transform(blocks(F.col(text), lines_per_block), lambda b: F.filter(F.split(b, " "), lambda w: w.isin(vocabulary)))
    rows = df.select(*keys, F.posexplode(own).alias("block", "_words"))
    rows = rows.where(F.exists("_words", lambda w: w.isin(first)))
    rows = rows.withColumn("_ranks", F.array_sort(F.transform(F.array_distinct("_words"), lambda w: F.element_at(ranks, w)))).where(F.size("_ranks") >= least)
    seen = rows.select(*keys, "block", "_ranks", F.posexplode("_ranks").alias("_place", "rank"))
    pairs = seen.join(F.broadcast(index), "rank")
    size = F.size("_ranks")
    room = F.least("place", "_place") + 1 + F.least(F.col("m") - F.col("place") - 1, size - F.col("_place") - 1)
    pairs = pairs.where((size >= F.col("need")) & (room >= F.col("need")))
    # a pair may meet at several prefix words; it is taken at the first only
    common = F.array_intersect("_ranks", "words")
    pairs = pairs.where(F.col("rank") == F.get(common, F.lit(0)))
    share = F.size(common) / F.col("m")
    out = pairs.where(F.size(common) >= F.col("need")).select(*keys, "block", "label", share.alias("containment"))
    if not windows:
        return out
    runs = {(label, tuple(words_of(t))): run_length(t, threshold) for label, texts in sorted(templates.items()) for t in sorted(texts, key=len)}
    near = [(w, label, list(ws), need(len(ws), threshold), n) for (label, ws), n in runs.items() for w in sorted(ws, key=rank.get)[: len(ws) - need(len(ws), threshold) + 1]]
    return out.unionByName(_window_rows(df, keys, near, text))


def _window_rows(df: DataFrame, keys: list[str], near: list[tuple[str, str, list[str], int, int]], text: str) -> DataFrame:
    """Rows of containment_join for runs of words; near has each word to look around with label, template's words, need and run length."""
    index = df.sparkSession.createDataFrame(near, "anchor string, label string, words array<string>, need int, n int")
    first, longest = sorted({x[0] for x in near}), max((x[4] for x in near), default=1)
    around = lambda ws: F.transform(
        F.array_compact(F.transform(ws, lambda w, i: F.when(w.isin(first), i))),
        lambda i: F.struct(F.get(ws, i).alias("anchor"), F.least(i, F.lit(longest - 1)).alias("at"), F.slice(ws, F.greatest(i - longest + 2, F.lit(1)), F.least(i, F.lit(longest - 1)) + longest).alias("ctx")),
    )
    rows = df.select(*keys, F.explode(F.transform(F.array(F.split(spaced(F.col(text)), " ")), around)).alias("_near")).select(*keys, F.explode("_near").alias("_near"))
    rows = rows.select(*keys, "_near.*").join(F.broadcast(index), "anchor")
    # of the longest run around the place, what this template's runs can reach
    rows = rows.withColumn("ctx", F.slice("ctx", F.greatest(F.col("at") - F.col("n") + 2, F.lit(1)), F.least(F.col("at"), F.col("n") - 1) + F.col("n")))
    rows = rows.where(F.size(F.array_intersect("ctx", "words")) >= F.col("need"))
    counts = F.transform("ctx", lambda w, i: F.when(F.array_contains("words", w), F.size(F.array_intersect(F.slice("ctx", i + 1, F.col("n")), F.col("words")))))
    rows = rows.withColumn("_most", F.array_max(counts)).where(F.col("_most") >= F.col("need"))
    return rows.select(*keys, F.lit(None).cast("int").alias("block"), "label", (F.col("_most") / F.size("words")).alias("containment"))


def licenses(df: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = 0.9, text: str = "text", lines_per_block: int = 1, keep: list[str] | None = None, windows: bool = False) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word (long), base_labels, labels (string) and score (double) to the columns in keep, or else all.

    score is the largest containment found, 1 where a phrase stands. With windows a notice may be wrapped over lines. Null and empty texts have no words, labels or score above 0, nor has any text where there are no phrases and templates.
    Matches belong to a text's content, so repeated rows give repeated results. Texts of any length are looked at whole, in time in proportion. An empty table gives an empty result. The columns that it adds replace columns of the
    same names.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in (keep or df.columns) if c not in added]
    key = [F.xxhash64(F.col(text)).alias("_key"), F.hash(F.col(text), F.lit(1)).alias("_key2")]
    rows = df.select(*keep, *key, spaced(F.col(text)).alias("_line"))
    rows = rows.withColumn("_words", F.when(F.rlike("_line", F.lit("|".join(f"\\b{p}\\b" for p in phrases) or "(?!)")), word_list(F.col("_line"))))
    rows = rows.withColumns(phrase_columns(F.col("_line"), F.col("_words"), phrases))
    n = F.when(F.col("_line") == "", 0).otherwise(F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select(
        *keep, "_key", "_key2", n.cast("long").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"), "_base",
    )
    found = containment_join(df.select(*key, F.col(text).alias("_text")), ["_key", "_key2"], templates, threshold, "_text", lines_per_block, windows)
    found = found.groupBy("_key", "_key2").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_score"))
    found = small(saved(found, "licenses"))  # only texts with a template are in it: as a rule few enough to be sent to all tasks, so equal texts don't meet in one
    rows = rows.join(found, ["_key", "_key2"], "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    return rows.select(*keep, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
