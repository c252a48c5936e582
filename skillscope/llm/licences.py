"""Licence scans, in DataFrame functions only.

Units of text (each line, and the whole document when it is about as long as a
template) are normalised - lower case, everything but letters and digits turned
into single spaces - and reduced to their set of word bigrams.  A unit matches
a template when the Dice coefficient of the two sets reaches the threshold.

Size bounds prune templates before any set is compared: a coefficient of t is
impossible unless the smaller set has at least t / (2 - t) times the larger
one's size.  So each template is listed under every set size it could match,
and units find their candidates by an equality join on size.  The template
tables are fixed (a few thousand small rows), so they are broadcast whatever
the corpus is; no text is shuffled.

Passages - a notice wrapped over lines of a longer text, or inside a line of
prose - are runs of words from one shared bigram to another.  A match shares at
least t / (2 - t) of the template's bigrams, so documents without any of a few
words that every such share contains are out by one pattern, and of the others
only templates with that many bigrams in the document are looked at.  Of
a template's overlapping passages the best stays (the longest of equals, then
the first).  One that overlaps a line, or lies in a whole document, that matches
the same template, or any other at least as well, is part of that match and not
reported again; a line no longer than the template can match is judged as a
whole, so no passage inside it is.

Defined results: null and empty texts, and units with fewer than two words,
match nothing; a unit may match several templates and gives a row for each;
repeated rows give repeated matches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"
#: ``unit`` of a whole document; lines count from 0.
WHOLE = -1
#: Words that say little about a licence: a pattern of words avoids them where it can.
COMMON = set("a an and any as be by following for free from in is of on or other that the this to under use with work".split())

# Public licence texts, notices and one-line statements.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "BSD-2-or-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Licensed under the BSD License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, number of the template, distinct word bigrams)."""
    rows = []
    for licence, texts in templates.items():
        for k, text in enumerate(texts):
            words = re.sub(r"[\W_]+", " ", text.lower()).split()
            rows.append((licence, k, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return rows


def size_range(size: int, threshold: float) -> range:
    """Set sizes whose Dice coefficient with a set of ``size`` can reach the threshold."""
    ratio = threshold / (2 - threshold)
    return range(math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9) + 1)


def least_shared(size: int, threshold: float) -> int:
    """Bigrams that a unit must share with a template of ``size`` bigrams to match."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def telling_words(rows: list[tuple[str, int, list[str]]], threshold: float) -> list[str]:
    """Words of which every match of every template holds at least one: so few
    bigrams are without them that they alone are no match."""
    chosen: set[str] = set()
    for *_, grams in rows:
        words = sorted({w for g in grams for w in g.split()} - chosen, key=lambda w: (w in COMMON, -len(w), w))
        while sum(not chosen & set(g.split()) for g in grams) >= max(1, least_shared(len(grams), threshold)):
            chosen.add(words.pop(0))
    return sorted(chosen)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), NOT_WORD, " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct word bigrams (empty for fewer than two words)."""
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, unit, licence, template, n_bigrams, dice) of every match.

    ``unit`` is the line number, or -1 for the whole document, which is a unit
    if it has several lines and no more words than the longest match could
    have without repeating a bigram.  A passage has the number of the line in
    which it begins."""
    spark: SparkSession = docs.sparkSession
    rows = template_bigrams(templates or TEMPLATES)
    sizes = [(n, licence, k) for licence, k, grams in rows for n in size_range(len(grams), threshold)]
    known = F.broadcast(spark.createDataFrame(rows, "licence string, template int, grams array<string>"))
    fitting = F.broadcast(spark.createDataFrame(sizes, "n_bigrams int, licence string, template int"))
    least, most = min(n for n, *_ in sizes), max(n for n, *_ in sizes)

    lines = F.transform(F.split(F.col("body"), "\n"), words_of)
    whole = F.array(F.struct(F.lit(WHOLE).alias("unit"), F.flatten("lines").alias("words")))
    words = F.aggregate("lines", F.lit(0), lambda n, w: n + F.size(w))
    numbered = F.transform("lines", lambda w, i: F.struct(i.alias("unit"), w.alias("words")))
    # a set of bigrams has at most one entry for each word but the last, so shorter units are out at once
    units = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
             .select("doc_id", lines.alias("lines"))
             .select("doc_id", F.explode_outer(F.when((F.size("lines") > 1) & (words <= most + 1), F.concat(whole, numbered))
                                               .otherwise(numbered)).alias("u"))
             .filter(F.size("u.words") > least)
             .select("doc_id", "u.unit", bigrams_of(F.col("u.words")).alias("found"))
             .select("doc_id", "unit", "found", F.size("found").alias("n_bigrams"))
             .filter(F.col("n_bigrams").between(least, most)))
    shared = F.size(F.array_intersect("found", "grams"))
    dice = 2 * shared / (F.col("n_bigrams") + F.size("grams"))
    return (units.join(fitting, "n_bigrams").join(known, ["licence", "template"])
            .select("doc_id", "unit", "licence", "template", "n_bigrams", dice.alias("dice"))
            .filter(F.col("dice") >= threshold)
            .unionByName(passages(docs, id_col, text_col, threshold, rows)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, computed once a row: behind a generator the
    optimiser cannot copy them into the functions that read them."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("made")
    return df.select("*", made).select(*df.columns, "made.*")


def passages(docs: DataFrame, id_col: str, text_col: str, threshold: float,
             rows: list[tuple[str, int, list[str]]]) -> DataFrame:
    """The matches of :func:`scan` that are neither a line nor a whole document."""
    most = max(max(size_range(len(g), threshold)) for *_, g in rows)
    known = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(k).alias("template"), F.lit(grams).alias("grams"),
                               F.lit(least_shared(len(grams), threshold)).alias("need"),
                               F.lit(max(size_range(len(grams), threshold))).alias("longest"))
                      for licence, k, grams in rows if grams])

    def dice(found: Column, grams: Column = F.col("grams")) -> Column:
        return 2 * F.size(F.array_intersect(found, grams)) / (F.size(found) + F.size(grams))

    def matched(found: Column, first: Column, end: Column) -> Column:
        """Of a line or document: its words, whether it matches this template, and its best match of any."""
        best = F.array_max(F.transform(known, lambda t: dice(found, t["grams"])))
        return F.when(F.size(found).between(1, most) & (best >= threshold), F.struct(
            first.alias("first"), end.alias("end"), (dice(found) >= threshold).alias("own"), best.alias("best")))

    words = F.col("words")
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    # every template against the documents that hold a telling word
    near = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
            .filter(F.lower("body").rlike("|".join(telling_words(rows, threshold))))
            .select("doc_id", F.transform(F.split("body", "\n"), words_of).alias("lines"))
            .select("doc_id", "lines", F.flatten("lines").alias("words"))
            .select("doc_id", "lines", F.filter(pairs, lambda p: p.isNotNull()).alias("pairs"))
            .select("doc_id", "lines", "pairs", F.array_distinct("pairs").alias("all"), F.explode(known).alias("t"))
            .select("doc_id", "lines", "pairs", "all", "t.*")
            .filter(F.size(F.array_intersect("all", "grams")) >= F.col("need")))
    # where shared bigrams are, where lines begin, and which word ranges are reported already
    begins = F.aggregate("lines", F.array(F.lit(0)), lambda b, w: F.concat(b, F.array(F.element_at(b, -1) + F.size(w))))
    at = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains("grams", p), i)), lambda i: i.isNotNull())
    near = once(near, begins=begins, at=at, by_line=F.transform("lines", bigrams_of))
    whole = F.when((F.size("lines") > 1) & (F.size("pairs") <= most), matched(F.col("all"), F.lit(0), F.size("pairs") + 1))
    taken = F.filter(F.concat(F.array(whole), F.transform("by_line", lambda g, i: matched(
        g, F.get("begins", i), F.get("begins", i + 1)))), lambda x: x.isNotNull())

    def ends(first: Column, i: Column) -> Column:
        later = F.slice("at", i + F.col("need"), F.col("longest"))      # fewer shared bigrams are no match
        fit = F.filter(later, lambda last: last - first < F.col("longest"))
        return F.transform(fit, lambda last: F.struct(first.alias("first"), (last + 2).alias("end")))

    short = F.filter(F.transform("by_line", lambda g, i: F.when(F.size(g).between(1, F.col("longest")), F.struct(
        F.get("begins", i).alias("first"), F.get("begins", i + 1).alias("end")))), lambda x: x.isNotNull())
    near = once(near, all_runs=F.flatten(F.transform("at", ends)), short=short)
    near = once(near, runs=F.filter("all_runs", lambda r: ~F.exists(
        "short", lambda x: (x["first"] <= r["first"]) & (r["end"] <= x["end"])))).filter(F.size("runs") > 0)
    found = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["end"].alias("end"), F.array_distinct(
        F.slice("pairs", r["first"] + 1, r["end"] - r["first"] - 1)).alias("found")))
    scored = F.filter(F.transform(found, lambda r: F.struct(
        (-dice(r["found"])).alias("order"), (-F.size(r["found"])).alias("size"), r["first"].alias("first"),
        r["end"].alias("end"))), lambda r: -r["order"] >= threshold)
    near = once(once(near, scored=scored).filter(F.size("scored") > 0), taken=taken)
    fresh = F.filter("scored", lambda r: ~F.exists("taken", lambda x: (r["first"] < x["end"]) & (
        x["first"] < r["end"]) & (x["own"] | (x["best"] >= -r["order"]))))
    best = F.aggregate(F.array_sort("s"), F.slice("s", 1, 0), lambda kept, r: F.when(
        F.exists(kept, lambda x: (r["first"] < x["end"]) & (x["first"] < r["end"])), kept).otherwise(
        F.concat(kept, F.array(r))))
    return (near.select("doc_id", "licence", "template", "begins", fresh.alias("s")).filter(F.size("s") > 0)
            .select("doc_id", "licence", "template", "begins", F.explode(best).alias("r"))
            .select("doc_id", (F.size(F.filter("begins", lambda b: b <= F.col("r.first"))) - 1).alias("unit"),
                    "licence", "template", (-F.col("r.size")).alias("n_bigrams"), (-F.col("r.order")).alias("dice")))
