"""Licence scan: Dice coefficient over word bigrams, as SQL functions only.

The units of a text are its lines, its paragraphs (between blank lines) and the
whole of it.  A unit is normalised to lower-case runs of letters and digits,
and its distinct word bigrams are compared to those of each licence template:
``2 * |A & B| / (|A| + |B|)``.  A unit of b bigrams can reach the least
coefficient d only with templates of b * d / (2 - d) to b * (2 - d) / d
bigrams; others are never compared, and units too short for the shortest
template or too long for the longest are dropped before any comparison.

Notices inside other prose are found by windows: a run of as many words of the
whole text as a template has, beginning with one of its bigrams or ending the
text, compared like a unit.  Two thirds of a template's bigrams at least are in
such a window, so templates of which a text has fewer are dropped first.
Overlapping windows give way to the best of them, and a licence that no unit
has counts once more, with its best window.

A text is scanned at all only if it has one of the words that no match can do
without: whatever two thirds of a template's bigrams are, one of them has one of
its chosen words.

A unit's licence is that of its best template (ties: the alphabetically last
id).  Equal units of a document count once.  Null and empty texts have none.
Null doc_ids and repeated rows are kept; other columns are kept as they are.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import unused

#: Least Dice coefficient.
LEAST = 0.8

# Notices as their publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
]

# Licence identifiers, as files name them in one line.
IDENTIFIERS = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _needed(templates, least: float) -> list[str]:
    """Words of which every text with a match has one.

    A match has share = least / (2 - least) of a template's bigrams at least, so
    one of any more than 1 - share of them; words are chosen, long ones first,
    until the bigrams with one of them are as many.
    """
    share, chosen = least / (2 - least), set()
    for _, text in templates:
        bigrams = [set(b.split()) for b in _bigrams(text)]
        few = len(bigrams) - math.ceil(share * len(bigrams) - 1e-9) + 1
        for word in [*sorted(chosen), *sorted(_words(text), key=lambda w: (-len(w), w))]:
            if sum(1 for b in bigrams if b & chosen) >= few:
                break
            chosen.add(word)
    return sorted(chosen)


def scan(docs: DataFrame, least: float = LEAST, templates=tuple(TEMPLATES), text: str = "text", out: str = "licence_hits") -> DataFrame:
    """docs with the column ``out``: array<struct<dice, licence>> of the units with
    a licence.  A column of docs with that name is replaced."""
    known = [(name, _bigrams(t)) for name, t in templates]
    low, high = least / (2 - least), (2 - least) / least
    fewest, most = min(len(b) for _, b in known) * low, max(len(b) for _, b in known) * high
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n")) for name, b in known])

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # other texts have no match: they count as empty from here on
    t = F.when(F.lower(t).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_needed(templates, least))})(?![\p{{L}}\p{{N}}])"), t).otherwise(F.lit(""))
    units = F.array_distinct(F.concat(F.split(t, r"\R"), F.split(t, r"\R[\x20\t]*\R"), F.array(t)))
    normal = F.transform(units, lambda u: F.split(F.trim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " ")), " "))
    # b distinct bigrams need b + 1 words at least
    normal = F.filter(normal, lambda w: F.size(w) > fewest - 1e-9)
    pairs = F.transform(normal, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    pairs = F.array_distinct(F.filter(pairs, lambda p: (F.size(p) >= fewest - 1e-9) & (F.size(p) <= most + 1e-9)))

    def best(p):
        near = F.filter(table, lambda x: (F.size(p) >= x["n"] * low - 1e-9) & (F.size(p) <= x["n"] * high + 1e-9))
        scored = F.transform(near, lambda x: F.struct((2.0 * F.size(F.array_intersect(p, x["bigrams"])) / (F.size(p) + x["n"])).alias("dice"), x["licence"].alias("licence")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= least - 1e-12))

    own, run, hit = unused([*docs.columns, out], "pairs", "run", "units")
    found = docs.withColumn(own, pairs).withColumn(run, _run(t)).withColumn(hit, F.filter(F.transform(own, best), lambda x: x.isNotNull()))
    inside = F.filter(_windows(F.col(run), least, templates), lambda x: ~F.array_contains(f"{hit}.licence", x["licence"]))
    return found.withColumn(out, F.concat(hit, inside)).drop(own, run, hit)


def _run(t):
    """Bigrams of the whole text, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.element_at(F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))), 1)


def _windows(run, least: float, templates):
    """array<struct<dice, licence>> of the licences of windows, one of each."""
    known = [(name, _bigrams(x), len(_words(x)) - 1) for name, x in templates]
    every = F.array(*map(F.lit, dict.fromkeys(p for _, b, _ in known for p in b)))
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n"), F.lit(size).alias("size")) for name, b, size in known])
    # c >= d / 2 * (c + n) for c common bigrams
    share = least / (2 - least)
    spans = "array<struct<dice:double,licence:string,begin:int,end:int>>"

    def scored(x):
        last = F.size(run) - x["size"]
        begins = F.filter(F.transform(run, lambda p, i: F.when((i <= last) & ((i == last) | F.array_contains(x["bigrams"], p)), i)), lambda i: i.isNotNull())

        def one(i):
            return F.transform(F.array(F.array_distinct(F.slice(run, i + 1, x["size"]))), lambda w: F.struct((2.0 * F.size(F.array_intersect(w, x["bigrams"])) / (F.size(w) + x["n"])).alias("dice"), x["licence"].alias("licence"), i.alias("begin"), (i + x["size"] + 1).alias("end")))[0]

        return F.filter(F.transform(begins, one), lambda w: w["dice"] >= least - 1e-12)

    def apart(found):
        # best first; begins negated so that the first of equals comes first
        order = F.reverse(F.array_sort(F.transform(found, lambda w: F.struct(w["dice"].alias("dice"), w["licence"].alias("licence"), (-w["begin"]).alias("back"), w["end"].alias("end")))))
        kept = F.aggregate(order, F.array().cast(spans), lambda acc, w: F.when(F.exists(acc, lambda k: (k["begin"] < w["end"]) & (-w["back"] < k["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(w["dice"].alias("dice"), w["licence"].alias("licence"), (-w["back"]).alias("begin"), w["end"].alias("end"))))))
        return F.transform(F.array(kept), lambda k: F.transform(F.array_distinct(F.transform(k, lambda w: w["licence"])), lambda n: F.struct(F.array_max(F.transform(F.filter(k, lambda w: w["licence"] == n), lambda w: w["dice"])).alias("dice"), n.alias("licence"))))[0]

    def of(had):
        near = F.filter(table, lambda x: F.size(F.array_intersect(had, x["bigrams"])) >= x["n"] * share - 1e-9)
        return F.transform(F.array(F.flatten(F.transform(near, scored))), apart)[0]

    none = F.array().cast("array<struct<dice:double,licence:string>>")
    return F.coalesce(F.transform(F.array(F.array_intersect(run, every)), lambda had: F.when(F.size(had) >= 1, of(had)).otherwise(none))[0], none)


def report(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_hits, licences (comma-joined), licence and dice of the best unit."""
    hits = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), least).select("doc_id", "licence_hits", F.array_max("licence_hits").alias("top"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("licence_hits.licence"))), ",")
    return hits.select("doc_id", F.size("licence_hits").cast("long").alias("n_hits"), names.alias("licences"), F.col("top.licence").alias("licence"), F.round("top.dice", 6).alias("dice"))
