"""License scans by patience alignment with known notices.

Words unique to both a stretch of text and a template anchor them; the longest
increasing subsequence of anchors stays, and the gaps between are aligned the
same way.  The aligned share of the template's words is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.licence_texts import FULL_TEXTS
from chatlens.llm.tables import sliced, small_batches
from chatlens.llm.words import FOLDED, span_hashes, text_buffers, word_spans

#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: Between two aligned words lie at most this share of the template's length in other words (and one in any case).
APART = 0.25

#: Short forms of public licence notices.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}
TEMPLATES = NOTICES | FULL_TEXTS

_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(i).isalnum() for i in range(128)]


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Folded hash of every word (a run of letters and digits), and its row."""
    raw, at = text_buffers(column)
    start, end, row = word_spans(raw, at, _GAPS)
    return span_hashes(raw, start, end, FOLDED), row


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
        back[i] = ends[k - 1] if k else -1
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned pairs of places of ``a`` and ``b``.

    A gap without common unique words falls back to its longest common
    subsequence, so repeated words align as well.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a: dict = {}
        times_b: dict = {}
        for k in range(a0, a1):
            times_a.setdefault(a[k], []).append(k)
        for k in range(b0, b1):
            times_b.setdefault(b[k], []).append(k)
        unique = sorted((at[0], times_a[w][0]) for w, at in times_b.items() if len(at) == 1 and len(times_a.get(w, ())) == 1)
        anchors = [unique[k] for k in rising([x for _, x in unique])]
        if anchors:
            for y, x in anchors:
                out.append((x, y))
                work.append((a0, x, b0, y))
                a0, b0 = x + 1, y + 1
            work.append((a0, a1, b0, b1))
            continue
        if not times_a.keys() & times_b.keys():
            continue
        best = [[0] * (b1 - b0 + 1) for _ in range(a1 - a0 + 1)]
        for i in range(a1 - a0 - 1, -1, -1):
            for j in range(b1 - b0 - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < a1 - a0 and j < b1 - b0:
            if a[a0 + i] == b[b0 + j]:
                out.append((a0 + i, b0 + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return sorted(out)


def _aligned(held: list, place: list[int], a: int, e: int, floor: int, template: list, apart: int) -> list[tuple[int, int]]:
    """Pairs of places of ``held[a:e]`` and ``template``, and what goes on before and after.

    The template's words before the first pair and after the last are aligned
    with the words next to the stretch, so it ends where the notice does.  Of
    pairs that lie too far apart the longest chain stays.
    """
    pairs = [(a + i, j) for i, j in patience(held[a:e], template)]
    if not pairs:
        return []
    lead, rest = pairs[0][1], pairs[-1][1] + 1
    if lead:
        low = max(floor, pairs[0][0] - 2 * lead)
        pairs = [(low + i, j) for i, j in patience(held[low: pairs[0][0]], template[:lead])] + pairs
    if rest < len(template):
        low = pairs[-1][0] + 1
        pairs += [(low + i, rest + j) for i, j in patience(held[low: low + 2 * (len(template) - rest)], template[rest:])]
    cuts = [0, *[k for k in range(1, len(pairs)) if place[pairs[k][0]] - place[pairs[k - 1][0]] > apart + 1], len(pairs)]
    return max((pairs[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)), key=len)


def _in_run(held: list, place: list[int], template: list, need: int, apart: int) -> list[tuple[int, int, int]]:
    """The notices among a run of template words ``held`` at the places ``place``."""
    wanted, have = Counter(template), Counter()
    out: list[tuple[int, int, int]] = []
    a = e = floor = held_of = 0
    while e < len(held):
        have[held[e]] += 1
        held_of += have[held[e]] <= wanted[held[e]]
        e += 1
        while held_of >= need:  # the least stretch that ends here with enough of the template's words
            while have[held[a]] > wanted[held[a]]:
                have[held[a]] -= 1
                a += 1
            pairs = _aligned(held, place, a, e, floor, template, apart)
            if len(pairs) >= need:
                out.append((place[pairs[0][0]], place[pairs[-1][0]], len(pairs)))
                a = e = floor = pairs[-1][0] + 1
                have.clear()
                held_of = 0
            else:
                have[held[a]] -= 1
                held_of -= 1
                a += 1
    return out


def found(words: np.ndarray, template: np.ndarray, coverage: float, apart: float = APART) -> list[tuple[int, int, int]]:
    """Stretches that hold the template: ``(first word, last word, aligned words)``, left to right and apart.

    A stretch has no fixed width: it runs from the first aligned word to the
    last, with at most ``apart`` of the template's length in other words
    between two of them.  Only words of the template are aligned, and only
    runs of them with enough of its words, in any order, are looked at; that
    bound is exact, so no run that could reach ``coverage`` is missed.
    """
    m = len(template)
    need, gap = int(np.ceil(coverage * m)), max(1, int(apart * m))
    kinds, times = np.unique(template, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    spots = np.flatnonzero(kinds[at] == words)
    bounds = np.r_[0, np.flatnonzero(np.diff(spots) > gap + 1) + 1, len(spots)]
    out: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(np.diff(bounds) >= need).tolist():
        run = spots[bounds[k]: bounds[k + 1]]
        if np.minimum(np.bincount(at[run], minlength=len(kinds)), times).sum() >= need:
            out += _in_run(words[run].tolist(), run.tolist(), template.tolist(), need, gap)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, license, first_word, last_word, n_aligned, coverage)`` of every notice in every text; no shuffle.

    A text may hold several, and one notice more than once; each has its row.
    ``templates`` maps names to texts of any length (``TEMPLATES`` where none are given).

    Defined results: null, empty and blank texts have none; repeated rows are
    scanned each; null ids stay null; stretches of one template don't overlap,
    the first that reaches ``coverage`` counts, with all that aligns next to it;
    a full text and a notice that is part of it have a row each; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = list(templates or TEMPLATES)
    marks = [word_hashes(pa.array([(templates or TEMPLATES)[n]]))[0] for n in names]
    vocabulary = np.unique(np.concatenate(marks))
    weight = np.stack([np.bincount(np.searchsorted(vocabulary, t), minlength=len(vocabulary)) for t in marks], 1).astype(np.float32)
    needs = np.array([np.ceil(coverage * len(t)) for t in marks])

    def run(batches):
        for b in sliced(batches, 1):
            word, row = word_hashes(b.column(1))
            n = len(b.column(1))
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            hit = vocabulary[at] == word
            has = np.zeros((n, len(vocabulary)), np.float32)
            has[row[hit], at[hit]] = 1
            begin = np.searchsorted(row, np.arange(n + 1))
            out = {k: [] for k in ("row", "license", "first_word", "last_word", "n_aligned", "coverage")}
            for i, t in np.argwhere(has @ weight >= needs).tolist():
                for first, last, many in found(word[begin[i]: begin[i + 1]], marks[t], coverage):
                    for k, v in zip(out, (i, names[t], first, last, many, many / len(marks[t])), strict=True):
                        out[k].append(v)
            rows = out.pop("row")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out["license"], pa.string()),
                                              *[pa.array(out[k], pa.int64()) for k in ("first_word", "last_word", "n_aligned")], pa.array(out["coverage"], pa.float64())],
                                             names=["doc_id", *out])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, license string, first_word long, last_word long, n_aligned long, coverage double")
