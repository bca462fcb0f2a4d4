"""License notices in texts by phrase and by exact set-similarity join with notice templates."""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.functions.arrays import let
from truthmill.operators.shared import stored

# The phrases and their labels, and one-line notices with theirs.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
THRESHOLD = 0.8

_PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what parts words


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def tokens(text: str) -> list[str]:
    return sorted(set(words_of(text)))


def needed(size: int, threshold: float) -> int:
    """The least overlap that contains the threshold's share of a template."""
    return max(1, math.ceil(round(threshold * size, 9)))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _prefixes(order: list[str], templates, threshold: float) -> Column:
    """One struct for each token in a template's prefix: its rarest size - needed + 1 tokens."""
    place = {word: i for i, word in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        ranked = sorted(tokens(text), key=place.__getitem__)
        least = needed(len(ranked), threshold)
        for at, word in enumerate(ranked[: len(ranked) - least + 1]):
            rows.append(
                F.struct(
                    F.lit(word).alias("token"), F.lit(number).alias("template"), F.lit(label).alias("label"), F.lit(len(words_of(text))).alias("length"),
                    F.lit(at).alias("at"), F.lit(least).alias("needed"), _strings(ranked).alias("ranked"),
                )
            )
    return F.array(*rows)


def _windows(lower: Column, templates, threshold: float) -> Column:
    """Stretches of words that cross line ends, as sets of template words with the line they start in.

    A stretch is as long as a template and stands for the templates of that length (``reach``): in a longer
    one, words of other notices would make up a short template. Only stretches that start at a
    template word are taken: the others hold no more template words than the next of these.
    """
    sets = {}
    for _, text in templates:
        sets.setdefault(len(words_of(text)), []).append(tokens(text))

    def of(t: Column, reach: int) -> Column:
        vocabulary = sorted(set().union(*sets[reach]))
        last = lambda i: F.get(t, F.least(i + (reach - 1), F.size(t) - 1))
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))),
            lambda i: F.get(t, i)["word"].isin(vocabulary) & (last(i)["line"] > F.get(t, i)["line"]),
        )
        found = F.transform(
            starts,
            lambda i: F.struct(
                F.get(t, i)["line"].alias("line"),
                F.lit(reach).alias("reach"),
                F.array_intersect(F.transform(F.slice(t, i + 1, reach), lambda x: x["word"]), _strings(vocabulary)).alias("words"),
            ),
        )
        return F.filter(found, lambda b: F.size(b["words"]) >= min(needed(len(s), threshold) for s in sets[reach]))

    words = F.transform(
        F.split(lower, "\n"),
        lambda line, i: F.transform(F.filter(F.split(line, _PART), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word"))),
    )
    return let(F.flatten(words), lambda t: F.concat(*[of(t, reach) for reach in sets]))


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """Phrase places and notice labels of every text; one row per input row.

    A block is a line, or for each template a stretch of as many words that crosses line
    ends, as a set of its words, so a notice wrapped over lines is one block too.
    Every block that holds at least the
    threshold's share of a template's words is found by a prefix-filtered join: words are
    ranked by the number of texts that hold them, rarest first; a block and a template can
    only reach the needed overlap if they share a word in both prefixes, the block is long
    enough, and enough words stand behind the shared one on both sides. Pairs that pass
    are confirmed on the full sets. Words in no template cannot count and are left out.

    Returns key, n_words, n_base, first_word, last_word, base_labels, labels, score and
    blocks (the confirmed lines and stretches: number of the line or of the stretch's first
    line, label, largest share of the template from there). A null or
    empty text has no words, no labels and score 0. Repeated rows each get their row; a
    null key stays null; other columns are not read. The score is 1 where a phrase stands,
    else the largest share of a template in a confirmed block, else 0.
    """
    sets = [tokens(t) for _, t in templates]
    vocabulary = sorted(set().union(*sets))
    least = min(needed(len(s), threshold) for s in sets)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)  # A-Z only: other letters have lower forms in them
    rows = docs.select(F.col(key).alias("_key"), lower.alias("_lower"))
    rows = rows.select("_key", "_lower", F.concat(F.lit(" "), F.trim(F.regexp_replace("_lower", _PART, " ")), F.lit(" ")).alias("_line"))
    rows = rows.withColumn("_words", F.split(F.trim("_line"), " "))
    rows = rows.withColumn("_seen", F.array_intersect("_words", _strings(vocabulary)))
    word = lambda i, k: F.get("_words", i + k)
    places = {p: p.split(" ") for p in phrases}

    def starts(i: Column) -> Column:
        found = F.lit(False)
        for parts in places.values():
            here = F.lit(True)
            for k, part in enumerate(parts):
                here = here & word(i, k).eqNullSafe(F.lit(part))
            found = found | here
        return found

    any_phrase = F.col("_line").rlike(" (" + "|".join(phrases) + ") ")
    at = F.when(any_phrase, F.filter(F.sequence(F.lit(0), F.size("_words") - 1), starts)).otherwise(F.array().cast("array<int>"))
    named = F.filter(
        F.array(*[F.when(F.contains("_line", F.lit(f" {p} ")), F.lit(label)) for p, label in phrases.items()]),
        lambda x: x.isNotNull(),
    )
    some = F.lit(False)  # a text that as a whole has too few words of every template has no such block
    for words in sets:
        some = some | (F.size(F.array_intersect("_seen", _strings(words))) >= needed(len(words), threshold))
    lines = F.transform(
        F.split("_lower", "\n"),
        lambda line, i: F.struct(
            i.alias("line"), F.lit(None).cast("int").alias("reach"), F.array_intersect(F.split(line, _PART), _strings(vocabulary)).alias("words")
        ),
    )
    lines = F.filter(lines, lambda b: F.size(b["words"]) >= least)
    blocks = F.concat(lines, _windows(F.col("_lower"), templates, threshold))
    blocks = F.when(some, blocks).otherwise(F.array().cast("array<struct<line:int,reach:int,words:array<string>>>"))
    rows = stored(
        rows.select(
            F.monotonically_increasing_id().alias("_row"),
            "_key",
            F.when(F.trim("_line") == "", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
            at.alias("_at"),
            F.array_sort(F.array_distinct(named)).alias("_base"),
            "_seen",
            blocks.alias("_blocks"),
        )
    )

    counts = rows.select(F.explode("_seen").alias("token")).groupBy("token").count().collect()  # a row per template word
    seen = {r["token"]: r["count"] for r in counts}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    spark = docs.sparkSession
    prefixes = spark.range(1).select(F.inline(_prefixes(order, templates, threshold)))
    sides = rows.select("_row", F.explode("_blocks").alias("b")).select(
        "_row", F.col("b.line").alias("line"), F.col("b.reach").alias("reach"), F.array_intersect(_strings(order), "b.words").alias("words")
    )
    size = F.size("words")
    found = (
        sides.select("*", F.posexplode("words").alias("pos", "token"))
        .filter(F.col("pos") <= size - least)
        .join(F.broadcast(prefixes), "token")
        .filter(
            (F.col("reach").isNull() | (F.col("reach") == F.col("length")))
            & (size >= F.col("needed"))
            & (F.col("pos") <= size - F.col("needed"))
            & (F.least(size - F.col("pos"), F.size("ranked") - F.col("at")) >= F.col("needed"))
        )
        .withColumn("overlap", F.size(F.array_intersect("words", "ranked")))
        .filter(F.col("overlap") >= F.col("needed"))
        .groupBy("_row", "line", "template", "label")
        .agg(F.max(F.col("overlap") / F.size("ranked")).alias("share"))
    )
    hits = found.groupBy("_row").agg(
        F.collect_set("label").alias("_found"),
        F.max("share").alias("_share"),
        F.array_sort(F.collect_list(F.struct("line", "label", "share"))).alias("blocks"),
    )
    none = F.array().cast("array<string>")
    found_labels = F.coalesce("_found", none)
    n_base = F.size("_at")
    return rows.join(hits, "_row", "left").select(
        F.col("_key").alias(key),
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, F.array_min("_at")).cast("long").alias("first_word"),
        F.when(n_base > 0, F.array_max("_at")).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", found_labels)), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.array().cast("array<struct<line:int,label:string,share:double>>")).alias("blocks"),
    )
