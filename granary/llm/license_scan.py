"""License scan by diagonal voting, in DataFrame operations only.

Every rolling pair of words of every document is hashed and joined to the positions of that pair in
the templates (a fixed library, so its broadcast is bounded). A hit votes for a diagonal, its place in the document
minus its place in the template. Votes are gathered by document, template and diagonal, as the set of the template's
places that have one; a place and a diagonal give the place in the document. Neighbouring
diagonals (words added or left out) are merged, and a merged span is verified: each place of the template counts once, by
its earliest hit, and only if that stands behind the hits of all places before it; the share of the places
that count decides. A phrase stands somewhere word by word exactly if one diagonal has all its places.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import text_rows, with_ids

#: What parts words: every ASCII character but digits and letters; A-Z are lower-cased first.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases of the contract, and usual notices by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
# Identifiers as in `SPDX-License-Identifier: MIT`, by label.
IDENTIFIERS = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-2.0": "GPL-2.0", "gpl-3.0": "GPL-3.0", "lgpl": "LGPL-2.1 LGPL-3.0", "agpl": "AGPL-3.0", "bsd": "BSD-2-Clause BSD-3-Clause",
    "mpl-2.0": "MPL-2.0", "isc": "ISC", "unlicense": "Unlicense", "cc0": "CC0-1.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0",
}
NOTICES += [(label, f"spdx license identifier {i.lower().replace('-', ' ').replace('.', ' ')}") for label, ids in IDENTIFIERS.items() for i in ids.split()]


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BREAKS), lambda w: w != "")


def templates(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(pair, template, at, pairs, label, is_base): a row for each word pair of each template."""
    texts = [(label, text, True) for label, text in phrases.items()] + [(label, text, False) for label, text in notices]
    rows = []
    for number, (label, text, is_base) in enumerate(texts):
        parts = text.split()
        rows += [(a, b, number, at, len(parts) - 1, label, is_base) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
    frame = spark.createDataFrame(rows, "a string, b string, template int, at int, pairs int, label string, is_base boolean")
    return frame.select(F.xxhash64("a", "b").alias("pair"), F.col("a").alias("ta"), F.col("b").alias("tb"), "template", "at", "pairs", "label", "is_base")


def in_order(merged: Column, pairs: Column) -> Column:
    """How many places of a template count in merged diagonals, an array of (diagonal, places)."""
    first = lambda at: F.array_min(F.transform(F.filter(merged, lambda d: F.array_contains(d["places"], at)), lambda d: d["diagonal"])) + at
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    step = lambda s, at: F.when(first(at) > s["last"], F.struct(first(at).alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(0), pairs - 1), start, step, lambda s: s["n"])


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, least: float = 0.9, slack: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A notice is found where a diagonal and those up to `slack` above it together hold at least the share `least` of its
    pairs, in the template's order; score is the largest such share, 1 for a base phrase, 0 without any.
    Templates have two words or more. Null, empty and wordless texts have n_words 0 and no label. Repeated rows
    and null ids stay rows of their own; other columns are ignored.
    """
    rows = with_ids(text_rows(docs, id_col, text_col), docs.schema[id_col].dataType.simpleString())
    listed = rows.select("uid", "id", words(F.col("text")).alias("words")).select("uid", "id", F.size("words").alias("n_words"), "words")
    pairs = listed.select("uid", "id", "n_words", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.col("n_words"), F.lit(1))).alias("b"))).alias("pos", "w"))
    pairs = pairs.select("uid", "id", "n_words", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.xxhash64("w.a", "w.b").alias("pair"))
    known = F.broadcast(templates(docs.sparkSession, phrases, notices))
    # a document keeps its first row even without a hit
    hits = pairs.join(known, "pair", "left").filter("template is not null or pos = 0 or pos is null")
    hits = hits.withColumn("hit", F.coalesce((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), F.lit(False)))
    who = ["uid", "id", "n_words"]
    what = ["template", "label", "is_base", "pairs"]
    voted = hits.select(*who, *(F.when(F.col("hit"), F.col(c)).alias(c) for c in what), F.when(F.col("hit"), F.col("pos") - F.col("at")).alias("diagonal"), F.when(F.col("hit"), F.col("at")).alias("at"))
    votes = voted.groupBy(*who, *what, "diagonal").agg(F.collect_set("at").alias("places"))
    near = Window.partitionBy("uid", "template").orderBy("diagonal").rangeBetween(0, slack)
    merged = votes.withColumn("merged", F.collect_list(F.struct("diagonal", "places")).over(near))
    exact = F.coalesce(F.col("is_base") & (F.size("places") == F.col("pairs")), F.lit(False))
    held = F.aggregate("merged", F.lit(0), lambda n, d: n + F.size(d["places"]))
    # most diagonals hold too few votes to be looked at
    share = F.when(~F.col("is_base") & (held >= least * F.col("pairs")), in_order(F.col("merged"), F.col("pairs")) / F.col("pairs"))
    spans = merged.select(*who, "label", "diagonal", exact.alias("exact"), F.coalesce(share, F.lit(0.0)).alias("share"))
    is_found = F.col("exact") | (F.col("share") >= least)
    named = lambda test: F.concat_ws(",", F.sort_array(F.collect_set(F.when(test, F.col("label")))))
    return (
        spans.groupBy(*who)
        .agg(
            F.count_if("exact").alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("diagonal"))).cast("long").alias("last_word"),
            named(F.col("exact")).alias("base_labels"),
            named(is_found).alias("labels"),
            F.coalesce(F.max(F.when(F.col("exact"), 1.0).when(is_found, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .select(F.col("id").alias(id_col), F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
