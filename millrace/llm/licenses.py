"""License scan by patience alignment.

Words that tell a template from prose mark where it may stand in a text. Where enough of them follow each other without long
gaps, each smallest range with so many words of the template in order that they reach ``LEAST_COVERAGE`` is a place; whatever stands
before it, such as a title or a copyright line, does not count against it, and repeated notices are separate places. At each place, and
at the place with the words the template has before and after it, the template is aligned to the words: equal words at both ends are matched,
words that are unique on both sides are anchors, the longest increasing subsequence of anchors is kept, and the gaps between them are aligned
in the same way. The coverage is the share of the template's words that are matched; a place counts from ``LEAST_COVERAGE`` on.

Related notices differ in few words, so coverage alone would name the wrong one. The places of a template where such words stand, or
could stand (a version number, "lesser" or "affero" behind "GNU", the parts of a Creative Commons name, the name of a licence), are its slots.
Where the text has other deciding words in a slot, or leaves a filled one out, the match is refused. A one-line template needs all its slots as they are.

Defined cases: a null or empty text has no words and no matches; a text with the same notice twice has two matches; of templates that
overlap in a place the one with more matched words counts, then the larger coverage, then the first by name; rows without id and repeated
rows are scanned like any others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

LEAST_COVERAGE = 0.75
#: Words without a mark that end a place, unless the template itself has longer stretches once the marks it can spare are lost.
LONGEST_GAP = 12

# Texts of public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "apache-1.1-line": "Licensed under the Apache License, Version 1.1.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "bsd-4-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. All advertising materials mentioning features or use of this "
        "software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "lgpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
}
# Fixed word list: words of the templates too common in prose to mark a place.
COMMON = frozenset(
    "a above all an and any are as at be but by can do either even for free from general in is it its list may more must not of on or other "
    "out person persons program public see so such that the this to use used version with without work you your v 0 1 2 3 4".split()
)

# Fixed word lists: deciding words behind "gnu" and behind "cc by", and names of licences.
BEHIND_GNU = frozenset("affero lesser library".split())
BEHIND_CC_BY = frozenset("nc nd sa".split())
NAMES = frozenset("apache bsd isc mit mozilla".split())
#: Templates of fewer words are lines, whose slots must be as they are.
LINE_WORDS = 20

_WORD = re.compile(r"[^\W_]+")


class Slot(NamedTuple):
    """Words ``start`` to ``end`` of a template, which may be none, and what decides there; no ``family`` means numbers."""

    start: int
    end: int
    family: frozenset[str] | None
    value: list[str]


def _deciding(words: Iterable[str], family: frozenset[str] | None) -> list[str]:
    """The deciding words among some; a version is the same with and without zeros at its end."""
    if family is not None:
        return [w for w in words if w in family]
    numbers = [w for w in words if w.isdecimal()]
    while numbers and numbers[-1] == "0":
        numbers.pop()
    return numbers


def slots_of(words: tuple[str, ...]) -> list[Slot]:
    found = []

    def add(start: int, family: frozenset[str] | None) -> None:
        end = start
        while end < len(words) and (words[end].isdecimal() if family is None else words[end] in family):
            end += 1
        found.append(Slot(start, end, family, _deciding(words[start:end], family)))

    for i, word in enumerate(words):
        if word.isdecimal() and not (i and words[i - 1].isdecimal()):
            add(i, None)
        elif word in NAMES:
            add(i, NAMES)
        elif word == "gnu":
            add(i + 1, BEHIND_GNU)
        elif word == "by" and i and words[i - 1] == "cc":
            add(i + 1, BEHIND_CC_BY)
    return found


class Template(NamedTuple):
    name: str
    words: tuple[str, ...]
    marks: Counter
    bits: dict[str, int]  # the places of each word in the template, as bits
    back: dict[str, int]  # the same from its end
    slots: list[Slot]


class Match(NamedTuple):
    name: str
    coverage: float
    start: int
    end: int


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def prepared(templates: dict[str, str]) -> list[Template]:
    made = []
    for name, text in sorted(templates.items()):
        words = tuple(words_of(text))
        bits: Counter = Counter()
        back: Counter = Counter()
        for i, word in enumerate(words):
            bits[word] |= 1 << i
            back[word] |= 1 << len(words) - 1 - i
        made.append(Template(name, words, Counter(w for w in words if w not in COMMON), dict(bits), dict(back), slots_of(words)))
    return made


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first number, in which the second increases."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, value) in enumerate(pairs):
        at = bisect_left(tails, value)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(value)
            ends.append(i)
        else:
            tails[at], ends[at] = value, i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def align(left: tuple[str, ...] | list[str], right: tuple[str, ...] | list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word sequences by patience alignment, in order."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(left[a:b]), Counter(right[c:d])
        place = {right[j]: j for j in range(c, d)}
        unique = [(i, place[left[i]]) for i in range(a, b) if here[left[i]] == 1 and there[left[i]] == 1]
        anchors = _increasing(unique)
        if anchors:
            matched += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, j, k + 1, m) for (i, k), (j, m) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


def _windows(template: Template, words: list[str], start: int, end: int, need: int) -> Iterator[tuple[int, int]]:
    """The smallest ranges within ``start`` and ``end`` that hold ``need`` words of the template in order, by their start.

    Each range that reaches the coverage contains one. The length of the longest common subsequence is kept in the bits of a number.
    """
    bits, full = template.bits, (1 << len(template.words)) - 1
    spots = [(i, bits[words[i]], template.back[words[i]]) for i in range(start, end) if words[i] in bits]
    at = 0
    while True:
        row = full
        for to in range(at, len(spots)):
            same = row & spots[to][1]
            row = ((row + same) | (row - same)) & full
            if same and len(template.words) - row.bit_count() >= need:
                break
        else:
            return
        row = full
        for at in range(to, -1, -1):
            same = row & spots[at][2]
            row = ((row + same) | (row - same)) & full
            if same and len(template.words) - row.bit_count() >= need:
                break
        yield spots[at][0], spots[to][0] + 1
        at += 1


def places(template: Template, hits: list[tuple[int, str]], words: list[str], need: int) -> Iterator[tuple[int, int]]:
    """Ranges of words in which ``need`` words of the template stand in order, from the positions of its marks."""
    size, marks = len(template.words), template.marks.total()
    least = max(1, need - (size - marks))  # marks among as many words
    # with all other marks lost, the others may stand so far apart
    spots = [-1, *(i for i, w in enumerate(template.words) if w in template.marks), size]
    lost = marks - least
    reach = max([LONGEST_GAP, *(j - i for i, j in zip(spots, spots[lost + 1 :], strict=False))])
    longest = max(marks * (LONGEST_GAP + 1), 2 * size) + 2 * reach
    i = 0
    while i < len(hits):
        k = i + 1
        while k < len(hits) and hits[k][0] - hits[k - 1][0] <= reach:
            k += 1
        start, end = max(0, hits[i][0] - reach), min(len(words), hits[k - 1][0] + 1 + reach)
        # a long chain of marks is searched in parts that overlap, so that each place is whole in one of them
        for low in range(start, max(start + 1, end - longest), longest):
            high = min(end, low + 2 * longest)
            held = Counter(word for _, word in hits[bisect_left(hits, (low, ""), i, k) : bisect_left(hits, (high, ""), i, k)])
            if (held & template.marks).total() >= least:
                yield from _windows(template, words, low, high, need)
        i = k


def contradicted(template: Template, pairs: list[tuple[int, int]], words: list[str]) -> bool:
    """Whether the text has other deciding words in a slot of an aligned template than the template; ``pairs`` are its matched words."""
    line = len(template.words) < LINE_WORDS
    places = [i for i, _ in pairs]
    for slot in template.slots:
        before, behind = bisect_left(places, slot.start) - 1, bisect_left(places, slot.end)
        size = slot.end - slot.start
        high = pairs[behind][1] if behind < len(pairs) else pairs[before][1] + 1 + size
        low = pairs[before][1] + 1 if before >= 0 else max(0, high - size)
        stretch = words[low : min(high, low + size + 3)]
        value = _deciding(stretch, slot.family)
        if value == slot.value:
            continue
        # neighbours that stand side by side in the text leave the slot out
        left_out = not stretch and places[before] == slot.start - 1 and behind < len(pairs) and places[behind] == slot.end
        if value or line or left_out:
            return True
    return False


def matches(template: Template, hits: list[tuple[int, str]], words: list[str], least: float) -> Iterator[Match]:
    """Alignments at the places of a template, each also with the words that the template has before and after it."""
    size = len(template.words)
    need = next((n for n in range(size + 1) if n / size >= least), size + 1)
    tried: set[tuple[int, int]] = set()
    for place in places(template, hits, words, need):
        start, end = place
        pairs = align(template.words, words[start:end])
        wider = (max(0, start - pairs[0][0]), end + size - 1 - pairs[-1][0]) if pairs else place
        for start, end in dict.fromkeys((place, wider)):
            if (start, end) in tried:
                continue
            tried.add((start, end))
            pairs = pairs if (start, end) == place else align(template.words, words[start:end])
            if len(pairs) >= need and not contradicted(template, [(i, start + j) for i, j in pairs], words):
                yield Match(template.name, len(pairs) / size, start + pairs[0][1], start + pairs[-1][1] + 1)


def scan_words(words: list[str], templates: list[Template], vocabulary: frozenset[str], least: float = LEAST_COVERAGE) -> list[Match]:
    """Matches in a text, in order; of overlapping ones the best."""
    marked = [(i, w) for i, w in enumerate(words) if w in vocabulary]
    found: list[Match] = []
    for template in templates if marked else ():
        hits = [(i, w) for i, w in marked if w in template.marks]
        if hits:
            found += matches(template, hits, words, least)
    lengths = {t.name: len(t.words) for t in templates}
    kept: list[Match] = []  # by start, without overlaps
    for match in sorted(found, key=lambda m: (-round(m.coverage * lengths[m.name]), -m.coverage, m.name, m.start)):
        at = bisect_left(kept, match.start, key=lambda k: k.start)
        free_before = at == 0 or kept[at - 1].end <= match.start
        free_after = at == len(kept) or match.end <= kept[at].start
        if free_before and free_after:
            kept.insert(at, match)
    return kept


SCHEMA = "doc_id bigint, n_words bigint, matches array<struct<license:string,coverage:double,start_word:bigint,end_word:bigint>>"


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COVERAGE
) -> DataFrame:
    """One row per document with its matches; word positions count from 0, end exclusive."""
    chosen = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepared(chosen)
        vocabulary = frozenset(w for t in ready for w in t.marks)
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found.append([dict(zip(("license", "coverage", "start_word", "end_word"), m, strict=True)) for m in scan_words(words, ready, vocabulary, least)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "matches"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, SCHEMA)
