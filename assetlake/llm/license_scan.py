"""License scans by patience alignment of texts with license templates.

Words that occur once in the text's region and once in the template are anchors; the longest run
of anchors in increasing order on both sides is kept; the gaps between them are aligned in the same
way, down to gaps without anchors. A template's coverage is the share of its words so aligned.

A text is compared with a template where it can matter: regions around the text's words that
the template has, cut where a whole template length has none of them. A region in which the
template's words all repeat (a notice twice in a row) is also tried in windows of two template
lengths, each starting one length after the other, so every occurrence lies in one window. Only
texts that hold enough of a template's distinct words are aligned; that bound is exact, as coverage
cannot be higher than the share of template words that the text has at all.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotate import annotate
from .grams import text_buffers, word_hashes, words

#: The notices searched for by default, (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.8


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs ordered by their first part, a longest subsequence whose second parts increase."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(y)
            last.append(i)
        else:
            tops[pile], last[pile] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _once(side: list[int], low: int, high: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for i in range(low, high):
        found[side[i]] = -1 if side[i] in found else i
    return found


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing on both sides."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = _once(a, a0, a1), _once(b, b0, b1)
        anchors = longest_increasing([(i, there[w]) for w, i in here.items() if i >= 0 and there.get(w, -1) >= 0])
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges[:-1], edges[1:])]
    return sorted(out)


def best_alignment(text: np.ndarray, template: list[int], known: np.ndarray, threshold: float) -> tuple[int, int, int]:
    """(aligned words, first word, word after the last) of the best region; known: places of the text's template words."""
    n, best = len(template), (0, 0, 0)
    cuts = np.flatnonzero(np.diff(known) > n) + 1
    for part in np.split(known, cuts):
        if len(part) < threshold * n:
            continue
        low, high = int(part[0]), int(part[-1]) + 1
        tries = [(low, high)]
        if high - low > n:
            tries += [(s, min(s + 2 * n, high)) for s in range(low, high, n)]
        for s, e in tries:
            found = patience(text[s:e].tolist(), template)
            if len(found) > best[0]:
                best = (len(found), s + found[0][0], s + found[-1][0] + 1)
            if best[0] == n:
                return best
    return best


def scan_licenses(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD, carry=None) -> DataFrame:
    """docs with ``licenses``: of each template that a text covers, license, template, aligned, coverage, first_word and words.

    template is its number in ``templates``; coverage: aligned words over template words, at least
    ``threshold``; first_word, words: where the aligned words begin in the text and how many words they
    span. Words are runs without white space, A-Z as a-z. Templates that cover equally well are all
    listed, in their order. Null, empty and short texts have none; each row is judged alone, the
    whole text however long; a column of docs called licenses is replaced.
    """
    sets: list = []

    def prepare():
        import pyarrow as pa

        data, offsets = text_buffers(pa.array([t for _, t in templates]))
        starts, ends, first = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        own = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        distinct = [np.unique(x, return_counts=True) for x in own]
        every = np.unique(hashes)
        return own, distinct, every

    def compute(data, offsets, batch):
        if not sets:
            sets.append(prepare())
        own, distinct, every = sets[0]
        starts, ends, first = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        at = np.flatnonzero(np.isin(hashes, every))
        bounds = np.searchsorted(at, first)
        out = []
        for d in range(len(offsets) - 1):
            places = at[bounds[d] : bounds[d + 1]]
            found = []
            if len(places):
                here = hashes[places]
                present = np.unique(here)
                for i, ((name, _), template, (vocabulary, counts)) in enumerate(zip(templates, own, distinct)):
                    if counts[np.isin(vocabulary, present)].sum() < threshold * len(template):
                        continue
                    known = places[np.isin(here, vocabulary)] - first[d]
                    aligned, low, high = best_alignment(hashes[first[d] : first[d + 1]], template.tolist(), known, threshold)
                    if aligned >= threshold * len(template):
                        found.append({"license": name, "template": i, "aligned": aligned, "coverage": aligned / len(template), "first_word": low, "words": high - low})
            out.append(found)
        return [out]

    return annotate(docs, "licenses array<struct<license:string,template:int,aligned:int,coverage:double,first_word:int,words:int>>", compute, carry=carry)


def op1_license_scan(spark, sf_dir):
    """A row for each document: doc_id, license (the best covered, null if none), coverage, first_word, words, and all licenses found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs, carry=["doc_id"])
    best = F.element_at(F.array_sort("licenses", lambda x, y: F.when(x["coverage"] != y["coverage"], F.signum(y["coverage"] - x["coverage"]).cast("int")).when(x["aligned"] != y["aligned"], y["aligned"] - x["aligned"]).otherwise(x["template"] - y["template"])), 1)
    found = found.withColumn("best", F.when(F.size("licenses") > 0, best))
    return found.select("doc_id", "best.license", "best.coverage", "best.first_word", "best.words", F.array_distinct("licenses.license").alias("licenses"))
