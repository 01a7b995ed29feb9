"""License scans (operator 7): patience alignment of texts with license templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.tokens import rows_of

#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: Other words that a passage may hold among the template's: so many, or a quarter of the template's words if that is more.
GAP = 6

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""

#: License notices, by SPDX identifier and form.
TEMPLATES = {
    ("MIT", "statement"): "Released under the MIT License.",
    ("MIT", "licensed"): "Licensed under the MIT License.",
    ("MIT", "grant"): _MIT_GRANT,
    ("Apache-2.0", "statement"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ("GPL-3.0", "statement"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "header"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.""",
    ("GPL-2.0", "statement"): "This work is licensed under the GNU General Public License, version 2.",
    ("LGPL-3.0", "statement"): "Licensed under the GNU Lesser General Public License, version 3.",
    ("AGPL-3.0", "statement"): "Licensed under the GNU Affero General Public License, version 3.",
    ("MPL-2.0", "statement"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ("BSD-3-Clause", "redistribution"): """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met""",
    ("ISC", "grant"): """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ("CC-BY-NC-4.0", "statement"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "statement"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "statement"): "Licensed under CC BY-SA 4.0.",
}

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _TOKEN.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting: each value goes on the leftmost pile whose top is
    not smaller and remembers the top of the pile before."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        tops[at : at + 1] = [v]
        piles[at : at + 1] = [i]
        before.append(piles[at - 1] if at else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal words, ascending in both: equal ends first, then words unique to both sides as
    anchors (a longest increasing subsequence of them), then each gap between anchors in the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        pairs = [(p, place[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place]
        anchors = [pairs[x] for x in longest_increasing([q for _, q in pairs])]
        for p, q in anchors:
            todo.append((i, p, k, q))
            out.append((p, q))
            i, k = p + 1, q + 1
        if anchors:
            todo.append((i, j, k, m))
    return sorted(out)


class Template:
    def __init__(self, name: tuple[str, str], text: str, common: Counter) -> None:
        self.license, self.form = name
        self.words = tokens(text)
        self.count = Counter(self.words)
        #: Aligned words that make the coverage, and the most words of a passage.
        self.need = math.ceil(COVERAGE * len(self.words) - 1e-9)
        self.reach = len(self.words) + max(GAP, len(self.words) // 4)
        lost, keys = len(self.words) - self.need, []
        #: One of these words begins each passage: no more words than ``lost`` can be missing before it.
        self.first = frozenset(self.words[: lost + 1])
        for w in sorted(self.count, key=lambda w: (common[w], -len(w), w)):  # from the rarest among templates
            keys.append(w)
            lost -= self.count[w]
            if lost < 0:
                break
        #: Without any of these words, too few are left for the coverage.
        self.keys = keys


def _templates(texts: dict[tuple[str, str], str]) -> list[Template]:
    common = Counter(w for t in texts.values() for w in set(tokens(t)))
    # words of ordinary prose come last as keys
    common.update({w: 100 for w in "the of and to in a any or by is this that with under be for as are not use all you it an".split()})
    return [Template(n, t, common) for n, t in texts.items()]


def starts(words: list[str], template: Template) -> Iterator[int]:
    """Places of one of the template's first words from which the next ``reach`` words hold enough of the template, counted as sets
    with repeats: no passage starts anywhere else. One pass with a sliding window over the template's words alone."""
    places = [i for i, w in enumerate(words) if w in template.count]
    have: Counter = Counter()
    shared, end = 0, 0
    for i in places:
        while end < len(places) and places[end] < i + template.reach:
            new = words[places[end]]
            have[new] += 1
            shared += have[new] <= template.count[new]
            end += 1
        w = words[i]
        if shared >= template.need and w in template.first:
            yield i
        shared -= have[w] <= template.count[w]
        have[w] -= 1


Found = tuple[int, float, Template, int, int]


def passages(words: list[str], template: Template) -> list[Found]:
    """Alignments (aligned words, coverage, template, first word, word after the last) with enough coverage, from every start; the
    window is the template's length or the whole reach, whichever aligns more (then the former). After a passage that has
    all of the template's words and no others, starts inside it are passed over: none could take its place."""
    out, done = [], 0
    for i in starts(words, template):
        if i < done:
            continue
        tried = (align(words[i : i + n], template.words) for n in (len(template.words), template.reach))
        pairs = max(tried, key=len)
        if len(pairs) >= template.need:
            first, last = i + pairs[0][0], i + pairs[-1][0] + 1
            out.append((len(pairs), len(pairs) / len(template.words), template, first, last))
            if len(pairs) == len(template.words) == last - first:
                done = last
    return out


def best_apart(found: list[Found]) -> list[tuple[str, str, float, int, int]]:
    """Passages that don't overlap, in order: the one with more aligned words goes first, then more coverage, then the earlier."""
    kept: list[tuple[int, int, Found]] = []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[3], f[2].license, f[2].form)):
        at = bisect_left(kept, (f[3],))
        if (at == len(kept) or f[4] <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= f[3]):
            kept.insert(at, (f[3], f[4], f))
    return [(f[2].license, f[2].form, round(f[1], 6), a, b) for a, b, f in kept]


def scan(text: str, templates: list[Template]) -> list[tuple[str, str, float, int, int]]:
    """License passages (license, form, coverage, first word, word after the last), ascending and apart."""
    low = text.lower()
    able = [t for t in templates if any(k in low for k in t.keys)]
    if not able:
        return []
    words = _TOKEN.findall(low)
    have = Counter(words)
    able = [t for t in able if sum(min(n, have[w]) for w, n in t.count.items() if w in have) >= t.need]  # the whole text has enough of it
    return best_apart([f for t in able for f in passages(words, t)])


PASSAGE = T.ArrayType(
    T.StructType([T.StructField("license", T.StringType()), T.StructField("form", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("form", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", templates: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Per document: the id, passages (license, form, coverage, start and end in words), licenses (distinct, sorted), best (the license
    of the passage with the greatest coverage; ties: the first) and coverage (its share, 0 without).

    Each task aligns its own texts: no shuffle. A template is tried only where one of its key words stands, without which
    the coverage can't be reached, and aligned from every place where a passage could begin. Null and empty texts have no
    passage; null and repeated ids stay; other columns are ignored; an empty table gives no row.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(texts)
        for batch in batches:
            found = [scan(t, known) for (t,) in rows_of(iter([batch.select([1])]))]
            best = [max(f, key=lambda p: p[2], default=None) for f in found]
            as_rows = [[dict(zip(("license", "form", "coverage", "start", "end"), p, strict=True)) for p in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(as_rows, _ARROW), pa.array([sorted({p[0] for p in f}) for f in found], pa.list_(pa.string())), pa.array([b and b[0] for b in best], pa.string()), pa.array([b[2] if b else 0.0 for b in best], pa.float64())],
                schema.names,
            )

    schema = T.StructType([docs.schema[id_column], T.StructField("passages", PASSAGE), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("best", T.StringType()), T.StructField("coverage", T.DoubleType())])
    return docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias(text_column)).mapInArrow(run, schema)
