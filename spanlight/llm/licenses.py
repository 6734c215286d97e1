"""Licence notices in texts, by patience alignment with templates.

A stretch of a document that has enough of a template's words is aligned with
it: words that occur once in both are anchors, the longest increasing chain of
them is kept, and the gaps between its links are aligned in the same way, after
equal words at both ends of a gap are matched.  The share of the template's
words that are matched is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches

#: Names and texts of public notices and licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Least coverage; a stretch may be so many times as long as a template.
COVERAGE, STRETCH = 0.85, 1.25
WORD = re.compile(r"\w(?:[\w.-]*\w)?")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first place, that also rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b), ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = chain([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((i0 + 1, i1, j0 + 1, j1))
        out += anchors
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.words = {n: words(t) for n, t in sorted(templates.items())}
        self.words = {n: w for n, w in self.words.items() if w}
        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.where: dict[str, list[str]] = {}
        for n, c in self.counts.items():
            for w in c:
                self.where.setdefault(w, []).append(n)

    def matches(self, text: str | None, coverage: float) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of each stretch that covers a template."""
        own = words(text)
        spots: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            for n in self.where.get(w, ()):
                spots.setdefault(n, []).append(i)
        out = []
        for n, at in spots.items():
            template, counts = self.words[n], self.counts[n]
            need, span = coverage * len(template), int(STRETCH * len(template))
            i = j = 0
            while i < len(at):
                j = max(j, i)
                while j < len(at) and at[j] < at[i] + span:
                    j += 1
                # No alignment can match more than the words in common.
                if j - i >= need and sum(min(c, counts[w]) for w, c in Counter(own[k] for k in at[i:j]).items()) >= need:
                    pairs = patience(own[at[i] : at[j - 1] + 1], template)
                    if len(pairs) >= need:
                        out.append((n, len(pairs) / len(template), at[i] + pairs[0][0], at[i] + pairs[-1][0]))
                        while i < len(at) and at[i] <= out[-1][3]:
                            i += 1
                        continue
                i += 1
        return best(out)


def best(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of stretches that overlap, the one with the most matched words stays: the longer, then the better covered."""
    out: list[tuple[str, float, int, int]] = []
    for x in sorted(found, key=lambda m: (-(m[3] - m[2] + 1) * m[1] ** 4, m[0])):
        if all(x[3] < y[2] or y[3] < x[2] for y in out):
            out.append(x)
    return sorted(out, key=lambda m: m[2])


def scan(templates: dict[str, str], coverage: float):
    def run(batches):
        import pyarrow as pa

        known = Templates(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        for batch in batches:
            found = [known.matches(t, coverage) for t in batch.column(1).to_pylist()]
            rows = [[{"license": n, "coverage": c, "first_word": a, "last_word": b} for n, c, a, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    return run


def license_scan(spark: SparkSession, docs: DataFrame, templates=None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, matches) for each row of docs(doc_id, text); matches: array of (license, coverage, first_word, last_word).

    A null or empty text has no matches; neither has an empty template.  A
    notice that occurs again is reported again.  Ids may be null, repeated rows
    give a row each, no rows give no rows.
    """
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, matches array<struct<license string, coverage double, first_word int, last_word int>>"
    return rows.mapInArrow(scan(dict(TEMPLATES if templates is None else templates), coverage), kind)
