"""License notices: an exact set-similarity join of text blocks with templates, in DataFrame functions only."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count, and their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Notices and sentences of the licenses' own texts; several may bear a label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: A template of n distinct words is looked for in every WIDE * n consecutive words of a paragraph.
WIDE = 2
LINES = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"

#: What separates words once only A-Z, a-z, 0-9 and non-ASCII characters make them.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each template."""
    return [(label, sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))))) for label, text in templates]


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where a phrase's words stand consecutively.  Labels also hold the label of each template
    of whose n distinct words at least `threshold` stand in one block: any WIDE * n consecutive words of a paragraph,
    however they are dealt over lines (a line without words ends a paragraph).  score is the largest such share, 1
    where a phrase stands, 0 without labels.

    The join: words that templates hold are ordered by the number of texts that hold them, rarest first.  Only
    texts with a word of some template's prefix are cut into paragraphs.  A paragraph meets a template at the first
    word of the template's prefix that it holds, if it has words enough (length filter) and enough template words
    from that one on (positional filter); each pair that is left is verified once, block by block, where only
    template words begin blocks.  The templates are constants, so their words and prefixes are bounded and broadcast.

    Null text is empty: no words, no labels.  Each row is judged by its own text, whatever its doc_id, which may
    be null or repeated.  An empty table gives no rows.  Extra columns are ignored.
    """
    sets = [(label, words, ceil(threshold * len(words) - 1e-9)) for label, words in template_sets(templates) if words]
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    lower = F.translate("text", UPPER, LOWER)
    words = F.split(spaced(lower), " ")
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<string>")

    vocabulary = sorted({w for _, words, _ in sets for w in words})
    held = docs.select(F.explode(F.array_intersect(listed(vocabulary), words)).alias("word"))
    counts = dict(map(tuple, held.groupBy("word").count().collect()))  # no more rows than the templates have words
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}

    starts = [(word, t, need) for t, (_, of, need) in enumerate(sets) for word in sorted(of, key=rank.get)[: len(of) - need + 1]]
    prefix = docs.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(word).alias("word"), F.lit(t).alias("t"), F.lit(need).alias("need")) for word, t, need in starts)))) if starts else docs.sparkSession.createDataFrame([], "word string, t int, need int")
    likely = docs.filter(F.arrays_overlap(words, listed(sorted({word for word, *_ in starts}))))
    paragraphs = likely.select("doc_id", digest, F.explode(F.split(F.array_join(F.transform(F.split(lower, LINES), spaced), "\n"), "\n\n+")).alias("block")).filter("block <> ''")
    paragraphs = paragraphs.select("doc_id", "digest", F.split("block", "[ \n]+").alias("words")).withColumn("held", F.array_intersect(listed(ranked), "words"))
    paragraphs = paragraphs.filter(F.size("held") >= min((need for *_, need in sets), default=0))
    at = lambda values: F.array(*values)[F.col("t")]
    own, ahead = at([listed(of) for _, of, _ in sets]), at([listed(sorted(of, key=rank.get)[: len(of) - need + 1]) for _, of, need in sets])
    probes = paragraphs.select("doc_id", "digest", "words", "held", F.posexplode("held").alias("pos", "word"))
    pairs = probes.join(F.broadcast(prefix), "word").filter((F.size("words") >= F.col("need")) & (F.size("held") - F.col("pos") >= F.col("need")))
    pairs = pairs.filter((F.get(F.array_intersect("held", ahead), F.lit(0)) == F.col("word")) & (F.size(F.array_intersect("held", own)) >= F.col("need")))
    width = at([F.lit(WIDE * len(of)) for _, of, _ in sets])
    placed = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("own", x["w"]))
    block = lambda x, j: F.filter(F.slice("placed", j + 1, F.col("width")), lambda y: y["i"] < x["i"] + F.col("width"))
    both = F.array_max(F.transform("placed", lambda x, j: F.size(F.array_distinct(F.transform(block(x, j), lambda y: y["w"])))))
    met = pairs.withColumn("own", own).withColumn("width", width).withColumn("placed", placed).select("doc_id", "digest", "t", "need", both.alias("both")).filter("both >= need")
    met = met.groupBy("doc_id", "digest").agg(F.collect_set(at([F.lit(label) for label, *_ in sets])).alias("more"), F.max(F.col("both") / at([F.lit(len(of)) for _, of, _ in sets])).alias("share"))

    any_phrase = "(?:" + "|".join(phrases.values()) + ")"
    places = rf"(?i) {any_phrase}(?= )"  # without (?u), case is ASCII's
    base = docs.select("doc_id", digest, F.concat(F.lit(" "), spaced(F.col("text")), F.lit(" ")).alias("s"))
    base = base.withColumn("n_words", F.when(F.col("s") == "  ", 0).otherwise(spaces(F.col("s")) - 1)).withColumn("n_base", F.regexp_count("s", F.lit(places)))
    found = F.col("n_base") > 0
    last = F.element_at(F.regexp_extract_all("s", F.lit(rf"(?i) ({any_phrase})(?= )"), F.lit(1)), -1)
    labels = F.array_compact(F.array(*(F.when(F.col("s").rlike(rf"(?i) {phrase}(?= )"), F.lit(label)) for label, phrase in phrases.items())))
    base = base.select(
        "doc_id",
        "digest",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_base").cast("long").alias("n_base"),
        F.when(found, spaces(F.element_at(F.split("s", places), 1))).cast("long").alias("first_word"),
        F.when(found, F.col("n_words") - (spaces(F.element_at(F.split("s", places), -1)) - 1) - (spaces(last) + 1)).cast("long").alias("last_word"),
        F.when(found, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    out = base.join(met, base["doc_id"].eqNullSafe(met["doc_id"]) & (base["digest"] == met["digest"]), "left")
    return out.select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
    )
