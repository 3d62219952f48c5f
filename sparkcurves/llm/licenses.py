"""License texts in documents by conditional compression.

1. Candidates: the words around every line that shares a telling word with a template, read over line ends in overlapping windows, each longer than
   any template; comment marks are no words. The telling words come from the templates; a native filter drops texts without any before Python runs.
2. A window is compressed once by itself and once with each template as a raw Zstandard dictionary. The templates that make it smaller are its
   candidates, ranked by what they save; no other template is looked at.
3. Exact wording confirms candidates in that order: the template is aligned with the window and the differences counted. Blanks in a template (words
   in angle brackets) match anything. Every stretch that differs in few words, and that its template alone shortens enough, is a notice, unless a
   better notice claims its words.
4. A line with a telling word but without a notice is judged by itself in the same way and reported with the template that ranks first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurves.llm import shared as S

#: License notices as they are commonly worded.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "copyright": "Copyright (c) <year> <owner>. All rights reserved.",
}
COMMON = frozenset("the a an and or of to in is it this under with without any you may not use that by from for as can be are work file copy terms "
                   "free public form forms source code program following conditions met binary associated international version all use person".split())
_WORD = re.compile(r"<[^<>]*>|[^\W_]+(?:[.'-][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def telling_words(templates: Mapping[str, str]) -> list[str]:
    """Words of the templates that are not common; every template has at least one."""
    found = set()
    for text in templates.values():
        own = [w for w in words(text) if w[0] != "<"]
        telling = [w for w in own if w not in COMMON and not w[0].isdigit() and len(w) > 2]
        found.update(telling or own)
    return sorted(found)


def aligned(candidate: list[str], template: list[str]) -> tuple[int, int, int, int, int]:
    """(missing, added, replaced, start, end): the cheapest alignment of a template with a stretch of the candidate, of equal ones the shortest.

    Words before and after the stretch are free, so a notice may stand inside a longer line. A blank stands for one word or more.
    """
    n = len(candidate)
    row = [(0, 0, 0, 0, -j) for j in range(n + 1)]  # total, missing, added, replaced, start; free start anywhere
    for t in template:
        previous, row = row, [(row[0][0] + 1, row[0][1] + 1, row[0][2], row[0][3], 0)]
        blank = t[0] == "<"
        for j, c in enumerate(candidate, 1):
            a, b, d = previous[j - 1], previous[j], row[j - 1]
            same = blank or c == t
            row.append(min((a[0] + (not same), a[1], a[2], a[3] + (not same), a[4]), (b[0] + 1, b[1] + 1, b[2], b[3], b[4]),
                           (d[0] + (not blank), d[1], d[2] + (not blank), d[3], d[4])))
    end = min(range(n + 1), key=lambda j: (row[j][:4], j + row[j][4], j))
    return (*row[end][1:4], -row[end][4], end)


def differences(candidate: list[str], template: list[str]) -> tuple[int, int, int]:
    """(missing, added, replaced) words of the cheapest alignment of a template with a stretch of the candidate."""
    return aligned(candidate, template)[:3]


@lru_cache(maxsize=8)
def _compressors(templates: tuple[tuple[str, str], ...], level: int):
    import zstandard

    plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
    each = [zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False,
                                     dict_data=zstandard.ZstdCompressionDict((text.lower() * (1 + 64 // max(len(text), 1))).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, text in templates]
    return plain, each


@lru_cache(maxsize=8)
def _word_compressors(templates: tuple[tuple[str, str], ...], level: int):
    """Compressors for runs of bare words: a template's dictionary is its words between single spaces, without blanks."""
    return _compressors(tuple((name, " ".join(["", *(w for w in words(text) if w[0] != "<"), ""])) for name, text in templates), level)


def candidates(window: list[str], templates: tuple[tuple[str, str], ...], level: int) -> list[int]:
    """Templates that make a window of words smaller when it is compressed with them, the largest saving first."""
    plain, each = _word_compressors(templates, level)
    data = " ".join(window).encode()
    alone = len(plain.compress(data))
    saved = [alone - len(c.compress(data)) for c in each]
    return sorted((i for i in range(len(each)) if saved[i] > 0), key=lambda i: (-saved[i], i))


def blocks(line: str, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """The line, or if it is long, stretches of its words that overlap by more than the longest template."""
    longest = max(len(text.split()) for _, text in templates) + 8
    own = line.split()
    if len(own) <= 3 * longest:
        return [line]
    return [" ".join(own[i : i + 2 * longest]) for i in range(0, len(own) - longest, longest)]


def judge(line: str, templates: tuple[tuple[str, str], ...], level: int, most_changed: float, least_saved: int) -> list[tuple]:
    """(license, bytes alone, bytes given, reduction, missing, added, replaced, confirmed) for each license confirmed in a line.

    For every block, templates rank by the size they leave. Those that save `least_saved` bytes are winners, compared by wording; of a block's
    winners that with the fewest differences counts. A line without a confirmed license has one row, for its most reduced block.
    """
    plain, each = _compressors(templates, level)
    confirmed: dict[str, tuple] = {}
    rest = None
    for block in blocks(line, templates):
        data = block.lower().encode()
        alone = len(plain.compress(data))
        given = [len(c.compress(data)) for c in each]
        order = sorted(range(len(each)), key=lambda i: (given[i], abs(len(templates[i][1]) - len(block)), i))
        own, best = words(block), None
        for i in order:
            if alone - given[i] < least_saved:
                break
            aim = words(templates[i][1])
            changed = differences(own, aim)
            key = (sum(changed) > most_changed * len(aim), sum(changed), -len(aim))
            if best is None or key < best[0]:
                best = key, i, changed
        i, changed = (best[1], best[2]) if best else (order[0], (None, None, None))
        row = (templates[i][0], alone, given[i], 1 - given[i] / alone, *changed, bool(best and not best[0][0]))
        if row[-1]:
            if row[0] not in confirmed or sum(changed) < sum(confirmed[row[0]][4:7]):
                confirmed[row[0]] = row
        elif rest is None or row[3] > rest[3]:
            rest = row
    return list(confirmed.values()) or [rest]


_COMMENT = re.compile(r"^\s*(?:rem|dnl)\s", re.IGNORECASE)  # marks of comments that are made of letters


@lru_cache(maxsize=8)
def _aims(templates: tuple[tuple[str, str], ...]) -> list[tuple[list[str], dict[str, int], int]]:
    """Words of each template, how often each of its own comes, and how many of them there are."""
    out = []
    for _, text in templates:
        aim = words(text)
        own: dict[str, int] = {}
        for w in aim:
            if w[0] != "<":
                own[w] = own.get(w, 0) + 1
        out.append((aim, own, sum(own.values())))
    return out


def _found(own: list[str], template: int, lo: int, hi: int, templates: tuple[tuple[str, str], ...], most_changed: float) -> Iterator[tuple]:
    """(changed words, -length, template, start, end, missing, added, replaced) of every notice of a template in own[lo:hi], the best one first."""
    todo = [(lo, hi)]
    aim, wanted, _ = _aims(templates)[template]
    while todo:
        lo, hi = todo.pop()
        here = own[lo:hi]
        # each of the template's words that is not there is a difference, so most stretches need no alignment
        if sum(max(0, n - here.count(w)) for w, n in wanted.items()) > most_changed * len(aim):
            continue
        missing, added, replaced, start, end = aligned(here, aim)
        if missing + added + replaced > most_changed * len(aim) or start == end:
            continue
        yield missing + added + replaced, -len(aim), template, lo + start, lo + end, missing, added, replaced
        todo += [(lo, lo + start), (lo + end, hi)]


def notices(lines: list[str], hits: list[int], templates: tuple[tuple[str, str], ...], level: int, most_changed: float, least_saved: int) -> list[tuple]:
    """(first line, last line, license, bytes alone, bytes given, reduction, missing, added, replaced, True) of all notices around some lines of a text."""
    plain, each = _word_compressors(templates, level)
    aims = _aims(templates)
    reach = 2 * max(len(aim) for aim, _, _ in aims) + 8
    by_line: dict[int, list[str]] = {}

    def read(i: int) -> list[str]:
        if i not in by_line:
            by_line[i] = _WORD.findall(_COMMENT.sub(" ", lines[i]))
        return by_line[i]

    spans: list[list[int]] = []  # runs of lines that reach some words beyond the hits
    for hit in hits:
        low, n = hit, 0
        while low and n < reach:
            low -= 1
            n += len(read(low))
        if spans and low <= spans[-1][1]:
            low = spans.pop()[0]
        high, n = hit, 0
        while high + 1 < len(lines) and n < reach:
            high += 1
            n += len(read(high))
        spans.append([low, high])
    out = []
    for low, high in spans:
        raw = [w for i in range(low, high + 1) for w in read(i)]
        line_of = [i for i in range(low, high + 1) for _ in read(i)]
        own = [w.lower() for w in raw]
        found = {f for lo in range(0, max(len(own) - reach, 1), reach) for i in candidates(own[lo : lo + 2 * reach], templates, level)
                 for f in _found(own, i, lo, min(lo + 2 * reach, len(own)), templates, most_changed)}
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: (f[0] / -f[1] > 0, f[1], f[0], f[2:])):  # exact ones first, then the longest templates
            start, end = f[3:5]
            # a better notice claims words that are its own; what only stands in its blanks is free
            if any(g[3] < end and start < g[4] and (g[2] == f[2] or (g[3] <= start and end <= g[4] and 2 * sum(w in aims[g[2]][1] for w in own[start:end]) >= end - start))
                   for g in kept):
                continue
            data = " ".join(own[start:end]).encode()
            alone, given = len(plain.compress(data)), len(each[f[2]].compress(data))
            if alone - given >= least_saved:
                kept.append(f)
                out.append((line_of[start], line_of[end - 1], templates[f[2]][0], alone, given, 1 - given / alone, *f[5:], True))
    return sorted(out)


def examine(text: str, hits: list[int], known: dict, templates: tuple[tuple[str, str], ...], level: int, most_changed: float, least_saved: int) -> list[tuple]:
    """(line, license, ...) for all notices of a text, and for lines with a telling word that are in no notice."""
    lines = text.split("\n")
    found = notices(lines, hits, templates, level, most_changed, least_saved)
    out = [(f[0], *f[2:]) for f in found]
    covered = {i for f in found for i in range(f[0], f[1] + 1)}
    for i in hits:
        if i not in covered:
            if lines[i] not in known:
                if len(known) > 100_000:
                    known.clear()
                known[lines[i]] = judge(lines[i], templates, level, most_changed, least_saved)
            out += [(i, *f) for f in known[lines[i]]]
    return sorted(out, key=lambda r: r[0])


def scan(documents: DataFrame, templates: Mapping[str, str] | None = None, level: int = 9, most_changed: float = 0.2, least_saved: int = 6) -> DataFrame:
    """documents(doc_id, text) -> doc_id, line, license, bytes_alone, bytes_given, reduction, missing, added, replaced, confirmed.

    A confirmed row for each notice, which may run over lines and stand beside others: a stretch of words of which no more than `most_changed` of the
    template's words differ and at least `least_saved` bytes are saved. Where the words of several templates are the same, the exact or longest one
    counts. `line` counts the text's lines from 0 and is the notice's first. A line with a telling word that no notice covers has a row with the
    nearest of the templates that save `least_saved` bytes, ties by size; it is confirmed only if the line's own wording is as near. Null and empty texts have no candidates; equal lines
    have a row each; a null doc_id stays null; lines may be of any length. An empty table gives an empty result; other columns are ignored.
    """
    chosen = tuple(sorted((templates or TEMPLATES).items()))
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(re.escape(w) for w in telling_words(dict(chosen))) + r")(?![\p{L}\p{N}])"
    texts = S.pick(documents, doc_id="doc_id", text="text").where(F.col("text").rlike(pattern))
    # the same pattern for RE2, which has no look-around
    inside = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in telling_words(dict(chosen))) + r")(?:$|[^\p{L}\p{N}])"
    names = ("license", "bytes_alone", "bytes_given", "reduction", "missing", "added", "replaced", "confirmed")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hits = pc.match_substring_regex(pa.array(text.split("\n"), pa.string()), inside).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
                rows = examine(text, hits, known, chosen, level, most_changed, least_saved)
                found += rows
                at += [i] * len(rows)
            if found:
                columns = {name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True), 1)}
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "line": pa.array([f[0] for f in found], pa.int64()), **columns})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return S.map_arrow(texts, run, f"doc_id {kind}, line long, license string, bytes_alone long, bytes_given long, reduction double, "
                                                "missing long, added long, replaced long, confirmed boolean")
