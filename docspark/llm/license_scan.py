"""License scans by diagonal voting, in DataFrame functions only.

Words are runs of characters other than the ASCII separators of ``SEPARATOR``, with A-Z lower-cased by case-insensitive matching.
Every rolling K-gram of a document's words is hashed and joined to the positions where a template holds it (the templates are a fixed
list, so their table is broadcast).  A match at document place p and template place t votes for the diagonal p - t; votes are counted per
(document, template, diagonal), diagonals at most ``SLACK`` apart are merged into one span, and a span is verified by the share
of the template's K-grams found on it, each counted once, and then by its words themselves.  Verified spans give labels and a score; base labels come from fixed phrases and always stay.

Null or empty text: no words, no labels, score 0.  Repeated rows are scanned each.  Empty table: empty result.  The columns named in
``keep`` pass through; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import small, spread, written
from docspark.llm.native import let, sums_before

# of the text as it stands: once A-Z are lower-cased, all of \x3A-\x60 are separators
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of a gram; a power of two.
K = 4
SLACK = 3
#: Share of a template's K-grams that a span must hold to count.
VERIFIED = 0.5

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License names and notices as they stand in files, by label.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc-by-sa": ("Text is available under the Creative Commons Attribution-ShareAlike License", "Licensed under CC BY-SA 4.0."),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "CC0 1.0 Universal Public Domain Dedication",
    ),
    "epl-2": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",
    ),
    "mpl-2-notice": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "all-rights-reserved": ("Copyright. All rights reserved.",),
}


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(WORD + "+", text)]


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """template, label, place, grams (in all) and gram (hash) of every K-gram of the templates."""
    rows = []
    for n, (label, w) in enumerate((label, template_words(t)) for label, ts in TEMPLATES.items() for t in ts):
        rows += [(n, label, i, len(w) - k + 1, *w[i : i + k]) for i in range(len(w) - k + 1)]
    words = [f"w{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "template int, label string, place int, grams int, " + ", ".join(f"{w} string" for w in words))
    return df.select("template", "label", "place", "grams", F.element_at(_doubled(F.array(*(F.xxhash64(w) for w in words)), k), 1).alias("gram"))


def pieces(text: Column) -> Column:
    """The text between separators: its words, and an empty piece where it begins or ends with a separator."""
    return F.split(text, SEPARATOR + "+", -1)


def count_words(text: Column) -> Column:
    """Number of words; splitting takes a fraction of the time of counting matches."""
    return let(pieces(text), lambda p: (F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")).cast("long"))


def folded(text: Column) -> Column:
    """Lower case, for comparing with ASCII words: of all other letters only the Kelvin sign becomes an ASCII one, so it is put aside."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def phrase_pattern(phrase: str) -> str:
    """Java pattern of a phrase's words, consecutive, in any case; it consumes the first word only, so places may overlap."""
    first, *rest = phrase.split()
    return f"(?i)(?<!{WORD}){first}(?=" + "".join(f"{SEPARATOR}++{w}" for w in rest) + f"(?!{WORD}))"


def base_places(text: Column) -> Column:
    """array<struct<label, place>>: where the words of a phrase stand, places in words from 0.

    A place is the number of words before the match; only texts with a match are taken apart.
    """

    def places(phrase: str, label: str) -> Column:
        def of(counts: Column, before: Column) -> Column:  # each match takes its first word away
            return F.transform(F.slice(before, F.lit(1), F.size(before) - 1), lambda b, i: F.struct(F.lit(label).alias("label"), (b + F.get(counts, i) + i).alias("place")))

        counts = F.transform(F.split(text, phrase_pattern(phrase), -1), count_words)
        return let(counts, lambda c: let(sums_before(c), lambda before: of(c, before)))

    lower = F.lower(text)

    def possible(phrase: str) -> Column:
        """All words of the phrase occur somewhere: a cheap test before the pattern's."""
        out = F.lit(True)
        for w in sorted(phrase.split(), key=len, reverse=True):
            out = out & F.contains(lower, F.lit(w))
        return out & text.rlike(phrase_pattern(phrase))

    none = F.array().cast("array<struct<label: string, place: bigint>>")
    return F.concat(*(F.when(possible(p), places(p, label)).otherwise(none) for p, label in PHRASES.items()))


def _doubled(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words from those of single words: pairs, pairs of pairs, and so on; k is a power of two."""
    width = 1
    while width < k:
        hashes = F.zip_with(hashes, F.slice(hashes, width + 1, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        width *= 2
    return hashes


def votes(docs: DataFrame, k: int = K) -> DataFrame:
    """Votes by diagonal: doc_id, __text (hash of the text), template, label, grams, diagonal, first, last and places found.

    One row per (document, template, diagonal); ``found`` is the set of template places, of which a template has a fixed number.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.xxhash64(text).alias("__text"), pieces(folded(text)).alias("__pieces"))
    df = df.select("doc_id", "__text", (F.get("__pieces", F.lit(0)) == "").cast("int").alias("__shift"), F.transform("__pieces", lambda w: F.xxhash64(w)).alias("__grams"))
    grams = _doubled(F.col("__grams"), k)
    df = df.select("doc_id", "__text", "__shift", grams.alias("__grams"))
    # outer: else a filter is inferred that takes every text apart a second time
    each = df.select("doc_id", "__text", "__shift", F.posexplode_outer("__grams").alias("__at", "gram"))
    hits = each.join(F.broadcast(template_grams(docs.sparkSession, k)), "gram")
    place = F.col("__at") - F.col("__shift")
    by = ["doc_id", "__text", "template", "label", "grams"]
    return hits.groupBy(*by, (place - F.col("place")).alias("diagonal")).agg(
        F.min(place).alias("first"), (F.max(place) + k - 1).alias("last"), F.collect_set("place").alias("found")
    )


def spans(docs: DataFrame, k: int = K, verified: float = VERIFIED) -> DataFrame:
    """doc_id, __text and spans of each document that has any: neighbouring diagonals merged, then verified."""
    by = ["doc_id", "__text", "template", "label", "grams"]
    v = votes(docs, k)
    order = Window.partitionBy("doc_id", "__text", "template").orderBy("diagonal")
    v = v.withColumn("__new", (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"))
    v = v.withColumn("__island", F.sum(F.coalesce("__new", F.lit(0))).over(order))
    merged = v.groupBy(*by, "__island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")
    )
    score = F.size("found") / F.col("grams")
    whole = merged.withColumn("score", score).where(F.col("score") >= verified)
    one = F.struct("first", "last", "label", "template", "score")
    return whole.groupBy("doc_id", "__text").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def scan(docs: DataFrame, keep: list[str] | None = None, k: int = K, verified: float = VERIFIED) -> DataFrame:
    """Kept columns (doc_id if none are named), n_words, base (places of phrases) and spans.

    spans: array of (first, last, label, template, score) in words from 0; empty where none is verified.
    """
    keep = keep or ["doc_id"]
    docs = spread(docs)
    found = written(spans(docs, k, verified), "license-spans")
    found = found.select(F.col("doc_id").alias("__doc"), F.col("__text").alias("__hash"), "spans")
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        *keep,
        F.col("doc_id").alias("__id"),
        F.xxhash64(text).alias("__text"),
        text.alias("__whole"),
        count_words(text).alias("n_words"),
        base_places(text).alias("base"),
    )
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__hash"))
    none = F.array().cast(found.schema["spans"].dataType)
    words = F.filter(pieces(folded(F.col("__whole"))), lambda w: w != "")
    held = let(words, lambda w: F.filter("spans", lambda s: _holds(w, s)))
    df = df.join(small(found), same, "left")
    return df.select(*keep, "n_words", "base", F.when(F.col("spans").isNotNull(), held).otherwise(none).alias("spans"))


def _holds(words: Column, span: Column) -> Column:
    """Whether a span's words, as they stand, hold the share ``VERIFIED`` of the template's distinct words."""
    texts = [" ".join(sorted(set(template_words(t)))) for ts in TEMPLATES.values() for t in ts]
    want = F.split(F.get(F.array(*map(F.lit, texts)), span["template"]), " ")
    have = F.slice(words, (span["first"] + 1).cast("int"), (span["last"] - span["first"] + 1).cast("int"))
    return F.size(F.array_intersect(want, have)) >= F.size(want) * VERIFIED


def labels(base: Column, spans_: Column | None = None) -> Column:
    """Distinct labels in order, comma-joined."""
    of = lambda a: F.transform(a, lambda x: x["label"])
    return F.array_join(F.array_sort(F.array_distinct(F.concat(of(base), of(spans_)) if spans_ is not None else of(base))), ",")


def score(base: Column, spans_: Column) -> Column:
    """1 with a phrase, else the best span's score, 0 without any."""
    best = F.array_max(F.transform(spans_, lambda x: x["score"]))
    return F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
