"""Licence notices in texts, by Dice coefficient over word bigrams.

Units of a text (its lines, and its paragraphs of two or more lines) are normalised to lower
case words and compared with licence templates: twice the bigrams in common over the bigrams
of both. A template can only reach the threshold t against a unit of a bigrams if it has
between a * t / (2 - t) and a * (2 - t) / t, so templates are kept by size and only those
within the bounds are compared; and of these only those that share enough single words.

Defined results: a null or empty text has no matches; a unit of fewer than two words has no
bigrams and matches nothing; of equally close templates the first by licence name counts;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only, text_or_empty

THRESHOLD = 0.8

# Paragraphs of published licences and the usual notices that name them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
        "License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("Proprietary", "All rights reserved."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
)

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter[tuple[str, str]]:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


@dataclass(frozen=True)
class Template:
    licence: str
    size: int
    words: frozenset[str]
    grams: Counter[tuple[str, str]]


class Templates:
    """Templates in order of size."""

    def __init__(self, texts: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        made = []
        for licence, text in texts:
            words = words_of(text)
            made.append(Template(licence, len(words) - 1, frozenset(words), bigrams(words)))
        self._by_size = sorted(made, key=lambda t: t.size)
        self._sizes = [t.size for t in self._by_size]
        self._shrink = threshold / (2 - threshold)
        self.vocabulary = frozenset().union(*(t.words for t in made))
        self.longest = self._sizes[-1] / self._shrink + 1 if made else 0

    def closest(self, words: list[str]) -> tuple[float, str] | None:
        """Coefficient and licence of the closest template that reaches the threshold."""
        size = len(words) - 1
        if size < 1:
            return None
        # A margin for rounding: pruning must not decide what the coefficient decides.
        low = bisect_left(self._sizes, size * self._shrink - 1e-6)
        high = bisect_right(self._sizes, size / self._shrink + 1e-6)
        grams, best = None, None
        for template in self._by_size[low:high]:
            common = sum(w in template.words for w in words)
            if 2 * common < self.threshold * (size + template.size):
                continue  # each common bigram starts with a common word
            grams = grams or bigrams(words)
            found = dice(grams, template.grams)
            key = (-found, template.licence)
            if found >= self.threshold and (best is None or key < best):
                best = key
        return (-best[0], best[1]) if best else None


def matches(text: str, templates: Templates) -> list[tuple[int, int, str, float]]:
    """First and last line, licence and coefficient of every unit that matches."""
    found = []
    paragraph: list[tuple[int, list[str]]] = []
    for number, line in enumerate([*text.split("\n"), ""]):
        words = words_of(line)
        if words:
            paragraph.append((number, words))
            found += _unit(number, number, words, templates)
        else:
            if len(paragraph) > 1 and sum(len(w) for _, w in paragraph) <= templates.longest:
                joined = [w for _, part in paragraph for w in part]
                found += _unit(paragraph[0][0], paragraph[-1][0], joined, templates)
            paragraph = []
    return found


def _unit(first: int, last: int, words: list[str], templates: Templates) -> list:
    if len(words) > templates.longest or templates.vocabulary.isdisjoint(words):
        return []
    best = templates.closest(words)
    return [(first, last, best[1], best[0])] if best else []


def scanned(
    docs: DataFrame,
    texts: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id`` and, for every unit that matches, its lines, licence and coefficient:
    ``first, last array<int>, licence array<string>, dice array<double>``."""
    templates = Templates(texts, threshold)
    names = ("first", "last", "licence", "dice")

    def work(rows: pa.RecordBatch) -> dict:
        found = [matches(text, templates) for text in rows.column("text").to_pylist()]
        out = {n: [[m[i] for m in own] for own in found] for i, n in enumerate(names)}
        return out | {"doc_id": rows.column("doc_id")}

    kinds = ("int", "int", "string", "double")
    schema = ", ".join(["doc_id long", *(f"{n} array<{k}>" for n, k in zip(names, kinds))])
    chosen = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text")
    )
    return in_batches(chosen, work, schema)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(texts: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """``doc_id, licences, n_matches, best_dice``: the registered query in SQL."""
    values = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(texts))
    word = r"'[\p{L}\p{N}]+'"
    return rf"""
WITH template(t, licence, text) AS (VALUES {values}),
tw AS (SELECT t, licence, regexp_extract_all(lower(text), {word}) AS w FROM template),
tg AS MATERIALIZED (
  SELECT t, licence, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS g, count(*) AS n
  FROM tw, unnest(range(1, len(w))) AS r(i) GROUP BY ALL
),
lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l,
         regexp_split_to_array(coalesce(text, ''), '\n(?:[^\p{{L}}\p{{N}}\n]*\n)+') AS p
  FROM documents
),
units AS (
  SELECT doc_id, 0 AS kind, j, l[j] AS unit FROM lines, unnest(range(1, len(l) + 1)) AS r(j)
  UNION ALL
  SELECT doc_id, 1, j, p[j] FROM lines, unnest(range(1, len(p) + 1)) AS r(j)
  WHERE regexp_matches(p[j], '[\p{{L}}\p{{N}}][^\n]*\n[^\n]*[\p{{L}}\p{{N}}]')
),
uw AS MATERIALIZED (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(lower(unit), {word}) AS w FROM units
),
ug AS (
  SELECT u, doc_id, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS g, count(*) AS n
  FROM uw, unnest(range(1, len(w))) AS r(i) GROUP BY ALL
),
scored AS (
  SELECT u, doc_id, licence, t, 2 * sum(least(ug.n, tg.n))::DOUBLE / any_value(ug.size + tg.size)::DOUBLE AS dice
  FROM ug JOIN tg USING (g) GROUP BY u, doc_id, licence, t
),
best AS (
  SELECT u, doc_id, licence, dice FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY dice DESC, licence, t) = 1
),
found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
         count(*) AS n_matches, max(dice) AS best_dice
  FROM best GROUP BY doc_id
)
SELECT d.doc_id, coalesce(licences, '') AS licences,
       CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM documents d LEFT JOIN found ON found.doc_id = d.doc_id
"""
