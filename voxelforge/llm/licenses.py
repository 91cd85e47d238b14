"""License scans: Dice coefficient over word bigrams against templates, with size bounds.

Units of comparison are the lines of a text (where notices stand), the whole
text (where a licence is the text) and windows of words, across line breaks, of
about a template's size (where a licence is wrapped or stands within a longer
text or line). Lines and whole texts are compared with the short notices, windows
with these and with the whole licence texts and standard headers of
``license_texts``. A unit and a template are sets of bigrams of
normalised words (lower case, punctuation dropped; a single word counts as a
bigram with nothing). For a Dice coefficient of t the sizes a and b must satisfy
t / (2 - t) <= a / b <= (2 - t) / t, so templates are kept by size and only
those within the bounds are compared; units that are out of bounds for all
templates, by bytes already, are never tokenised.

A window begins and ends with bigrams of its template and has at most
(2 - t) / t times its words. A text must hold t / (2 - t) of a template's
bigrams for any window to reach t, so counting them by text loses none; only
windows of the texts left are looked at, all of them. Of windows that overlap
the one with the most Dice times common bigrams stays; it is reported by the
line in which it begins, unless it overlaps a line or whole text that matched
the same licence. Templates of one word have no windows.

Null and empty texts match nothing. Ties go to the template that sorts first by
name. Each row is scanned for itself, whatever its id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, WORD_SQL, bounded_batches, buffers, lowered, shingle_hashes, slices, word_hashes

THRESHOLD = 0.8
# Short notices of common licences by SPDX identifier, and the permission paragraphs of two.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licence texts and standard headers, by SPDX identifier; read on the driver only."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return tuple((f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in files)


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, ...]]:
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """Templates sorted by number of bigrams, and the bounds that a threshold sets."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        rows = [(bigrams(WORD.findall(text.lower().encode())), name, i) for i, (name, text) in enumerate(sorted(templates))]
        self.rows = sorted((r for r in rows if r[0]), key=lambda r: (len(r[0]), r[2]))
        self.sizes = [len(r[0]) for r in self.rows]
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        #: a unit has at least 2 bytes for each distinct bigram's second word and gap
        self.least_bytes = int(2 * self.ratio * self.sizes[0]) if self.rows else 1 << 62

    def best(self, unit: bytes) -> tuple[float, str] | None:
        """The best template of at least the threshold for a lower-cased unit."""
        if len(unit) < self.least_bytes:
            return None
        own = bigrams(WORD.findall(unit))
        lo, hi = bisect_left(self.sizes, len(own) * self.ratio - 1e-9), bisect_right(self.sizes, len(own) / self.ratio + 1e-9)
        found = [(-d, i, name) for grams, name, i in self.rows[lo:hi] if (d := dice(own, grams)) >= self.threshold] if own else []
        return (-min(found)[0], min(found)[2]) if found else None


class Windows:
    """Templates as sets of bigram hashes, for the search of windows of words."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        self.rows: list[tuple[str, np.ndarray, int]] = []
        for name, text in sorted(set(templates)):
            grams, _ = self._grams(*word_hashes(*buffers(lowered(pa.array([text]))))[::3])
            if len(grams):
                self.rows.append((name, np.unique(grams), int(len(grams) / self.ratio)))
        every = np.concatenate([g for _, g, _ in self.rows]) if self.rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.rows)), [len(g) for _, g, _ in self.rows])
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.first, self.owner = np.append(first, len(every)), owner[order]
        self.least = np.array([np.ceil(self.ratio * len(g) - 1e-9) for _, g, _ in self.rows], np.int64)

    @staticmethod
    def _grams(words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return shingle_hashes(words, woff, 2)

    def search(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, str, float]]]:
        """(first line, last line, licence, dice) of the windows of each lower-cased text that has any."""
        words, start, end, woff = word_hashes(data, off)
        grams, at = self._grams(words, woff)
        if not len(grams) or not len(self.keys):
            return {}
        owner = np.searchsorted(woff, at, "right") - 1
        slot = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[slot] == grams)
        pairs = np.unique(owner[hit] * len(self.keys) + slot[hit])
        doc, key = np.divmod(pairs, len(self.keys))
        n = self.first[key + 1] - self.first[key]
        place = np.arange(int(n.sum())) + np.repeat(self.first[key] - (np.cumsum(n) - n), n)
        seen, count = np.unique(np.repeat(doc, n) * len(self.rows) + self.owner[place], return_counts=True)
        doc, row = np.divmod(seen, len(self.rows))
        enough = count >= self.least[row]
        wanted: dict[int, list[int]] = {}
        for d, r in zip(doc[enough].tolist(), row[enough].tolist(), strict=True):
            wanted.setdefault(d, []).append(r)
        out = {}
        for d, rows in wanted.items():
            lo, hi = np.searchsorted(owner, [d, d + 1])
            breaks = off[d] + np.flatnonzero(data[off[d] : off[d + 1]] == 10)
            line = lambda byte, breaks=breaks: int(np.searchsorted(breaks, byte)) + 1
            out[d] = [(line(start[at[lo + s]]), line(end[at[lo + e] + 1] - 1), self.rows[r][0], v) for s, e, r, v in self._disjoint(grams[lo:hi], rows)]
        return out

    def _disjoint(self, grams: np.ndarray, rows: list[int]) -> list[tuple[int, int, int, float]]:
        """(first, last, template, dice) of the best windows that do not overlap, in order."""
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1)
        same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        before[order[same + 1]] = order[same]
        found = []
        for r in rows:
            _, own, width = self.rows[r]
            pos = np.flatnonzero(np.isin(grams, own))
            until = np.searchsorted(pos, pos + width)
            for i in np.flatnonzero(until - np.arange(len(pos)) >= self.least[r]).tolist():
                p, s = pos[i : until[i]], int(pos[i])
                common = np.cumsum(before[p] < s)
                if common[-1] < self.least[r]:
                    continue
                values = 2 * common / (np.cumsum(before[s : p[-1] + 1] < s)[p - s] + len(own))
                k = int(np.argmax(values))
                if values[k] >= self.threshold:
                    found.append((-values[k] * common[k], r, s, int(p[k]), float(values[k])))
        taken: list[tuple[int, int, int, float]] = []
        for _, r, s, e, v in sorted(found):
            if all(e + 1 < a or b + 1 < s for a, b, _, _ in taken):
                taken.append((s, e, r, v))
        return sorted(taken)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, full: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each document: id and its matches array<struct<line, license, dice>>; line 0 is the whole text. No shuffle.

    ``full`` are templates of windows only.
    """
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    id_type = inner.schema["__id"].dataType.simpleString()
    longer = list(full_texts() if full is None else full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, windows = Matcher(templates, threshold), Windows([*templates, *longer], threshold)
        for batch in batches:
            for part in slices(batch, "__t"):
                data, off = buffers(lowered(part.column("__t")))
                raw = data.tobytes()
                wide = windows.search(data, off)
                rows = [with_windows(matches(raw[off[i] : off[i + 1]], matcher), wide.get(i, [])) for i in range(part.num_rows)]
                cols = [pa.array([[m[k] for m in r] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *cols], names=["__id", "lines", "licenses", "dices"])

    out = inner.mapInArrow(run, f"__id {id_type}, lines array<long>, licenses array<string>, dices array<double>")
    zipped = F.transform(F.arrays_zip("lines", "licenses", "dices"), lambda m: F.struct(m["lines"].alias("line"), m["licenses"].alias("license"), m["dices"].alias("dice")))
    return out.select(F.col("__id").alias(id_col), zipped.alias("matches"))


def matches(text: bytes, matcher: Matcher) -> list[tuple[int, str, float]]:
    """Matches of a lower-cased text: the whole (line 0) if it has several lines, then its lines from 1."""
    lines = text.split(b"\n")
    out = []
    units = [(i, line) for i, line in enumerate(lines, 1)]
    if len(lines) > 1:
        units.insert(0, (0, text))
    for i, unit in units:
        if (m := matcher.best(unit)) is not None:
            out.append((i, m[1], m[0]))
    return out


def with_windows(found: list[tuple[int, str, float]], wide: list[tuple[int, int, str, float]]) -> list[tuple[int, str, float]]:
    """Matches and the windows that overlap none of the same licence, by line."""
    new = [(a, name, v) for a, b, name, v in wide if not any(n == name and (i == 0 or a <= i <= b) for i, n, _ in found)]
    return sorted(found + new, key=lambda m: m[0]) if new else found


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.round(F.coalesce(best, F.lit(0.0)), 6).alias("best_dice"))


def _values() -> str:
    rows = ", ".join(f"({i}, '{name}', '{text.lower().replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(sorted(TEMPLATES)))
    return f"(VALUES {rows}) v(t, name, body)"


_GRAMS = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
OP2_SQL = f"""
WITH t AS (SELECT t, name, {_GRAMS} AS g FROM (SELECT t, name, regexp_extract_all(body, '{WORD_SQL}') AS w FROM {_values()})),
l AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS p FROM documents)),
u AS (SELECT doc_id, i, p[i] AS x FROM l UNION ALL SELECT doc_id, 0, lower(text) FROM documents WHERE contains(text, chr(10))),
g AS (SELECT doc_id, i, {_GRAMS} AS g FROM (SELECT doc_id, i, regexp_extract_all(x, '{WORD_SQL}') AS w FROM u) WHERE len(w) > 0),
s AS (SELECT g.doc_id, g.i, t.t, t.name, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS d
      FROM g JOIN t ON len(g.g) * 1.5 >= len(t.g) AND len(t.g) * 1.5 >= len(g.g)),
b AS (SELECT doc_id, i, name, d FROM s WHERE d >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY d DESC, t) = 1)
SELECT d.doc_id, CAST(count(b.i) AS BIGINT) AS n_matches, coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '') AS licenses,
       round(coalesce(max(b.d), 0.0::DOUBLE), 6) AS best_dice
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY d.doc_id
"""
