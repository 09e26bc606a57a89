"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of letters and digits after A-Z are lower-cased: anything but ASCII signs, controls and spaces. A block is
any stretch of consecutive words of a text, across line ends, of at most STRETCH times as many words as the template: notices
are wrapped and carry comment signs, but scattered words are no notice. A template matches a block that holds at least
THRESHOLD of its distinct words. Words of templates are ordered by how many documents of the whole corpus hold them, rarest
first, ties by the word. By the prefix filter a block that meets the threshold holds one of the first
|T| - ceil(THRESHOLD * |T|) + 1 words of T, so only those are indexed, and only blocks around them are looked at; the length
filter drops texts and blocks with fewer distinct words of T than needed; the positional filter drops a hit around which
fewer words of T stand, from its own place in the order on, than needed, as then it isn't the rarest of any match. What
remains is counted exactly, block by block. Matches of a template are reported by their first words, those that overlap once.

Phrases of BASE are found besides, wherever their words stand consecutively, across lines too.

Null and empty texts have no words, no labels and score 0. Rows with equal or null ids stay rows of their own; other
columns are ignored; an empty table gives an empty result. Only the counts of the templates' few words reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# The base phrases, and short notices by which the usual licenses are granted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)
THRESHOLD = Fraction(4, 5)
#: Words of a block at most, as a multiple of the template's words.
STRETCH = Fraction(5, 4)

#: Lower case for A-Z, a space for what no word holds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def template_words(templates=TEMPLATES) -> list[tuple[str, list[bytes]]]:
    return [(label, words_of(text)) for label, text in templates]


class ContainmentIndex:
    """Finds the blocks that contain a template to the threshold; `counts` orders words, absent ones first."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: Fraction = THRESHOLD, stretch: Fraction = STRETCH) -> None:
        self.templates = []
        self.prefixes: dict[bytes, list[int]] = {}
        for number, (label, words) in enumerate(templates):
            order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            need = -(-threshold.numerator * len(order) // threshold.denominator)
            reach = -(-stretch.numerator * len(words) // stretch.denominator)
            for word in order[: len(order) - need + 1]:
                self.prefixes.setdefault(word, []).append(number)
            self.templates.append((label, {w: at for at, w in enumerate(order)}, need, reach))

    def __call__(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word, containment) of the matches of a text, by template and place."""
        present = set(words)
        numbers = sorted({number for word in self.prefixes.keys() & present for number in self.prefixes[word]})
        return [(self.templates[number][0], *match) for number in numbers for match in self._matches(words, present, number)]

    def _matches(self, words: list[bytes], present: set[bytes], number: int) -> Iterator[tuple[int, float]]:
        _, order, need, reach = self.templates[number]
        if sum(w in present for w in order) < need:  # length filter
            return
        held = [(i, order[w]) for i, w in enumerate(words) if w in order]
        spans = list(self._around(held, len(order) - need, need, reach))
        best: tuple[int, int, int] | None = None  # words found, first word, end of the block
        for first, last in spans:
            for start, found, end in self._blocks(held[first:last], need, reach):
                if best and start < best[2]:
                    best = max(best, (found, best[1], best[2]), key=lambda x: x[0])
                    continue
                if best:
                    yield best[1], best[0] / len(order)
                best = (found, start, end)
        if best:
            yield best[1], best[0] / len(order)

    @staticmethod
    def _around(held: list[tuple[int, int]], most: int, need: int, reach: int) -> Iterator[tuple[int, int]]:
        """Ranges of `held` that blocks around a hit of the prefix can cover, joined where they overlap."""
        span, low, high = None, 0, 0
        for at, own in held:
            if own > most:
                continue
            while held[low][0] <= at - reach:
                low += 1
            high = max(high, low)
            while high < len(held) and held[high][0] < at + reach:
                high += 1
            if len({p for _, p in held[low:high] if p >= own}) < need:  # positional filter
                continue
            if span and low < span[1]:
                span = (span[0], high)
            else:
                if span:
                    yield span
                span = (low, high)
        if span:
            yield span

    @staticmethod
    def _blocks(held: list[tuple[int, int]], need: int, reach: int) -> Iterator[tuple[int, int, int]]:
        """(first word, words found, end) of each longest block that starts with a word of the template and has enough of them."""
        counts: Counter = Counter()
        end = 0
        for start, (first, own) in enumerate(held):
            while end < len(held) and held[end][0] < first + reach:
                counts[held[end][1]] += 1
                end += 1
            if len(counts) >= need:
                yield first, len(counts), held[end - 1][0] + 1
            counts[own] -= 1
            if not counts[own]:
                del counts[own]


def places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        at = joined.find(b" " + phrase + b" ")
        word, counted = 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            out.append((word, label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    return sorted(out)


def template_word_counts(documents: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of a template."""
    wanted = frozenset(w for _, words in template_words(templates) for w in words)

    def make():
        def work(batch):
            counts = Counter(w for text in batch["text"].to_pylist() for w in wanted.intersection(words_of(text)))
            return {"word": list(counts), "n": list(counts.values())}

        return work

    rows = arrow_map(documents.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def license_scan(documents: DataFrame, templates=TEMPLATES, base=BASE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment; 1 with a base
    phrase), and blocks: label:word for each match, by its first word (from 0) and label, comma-joined."""
    counts = template_word_counts(documents, templates)
    sets = template_words(templates)
    phrases = {phrase.encode(): label for phrase, label in base.items()}

    def make():
        index = ContainmentIndex(sets, counts, threshold)

        def one(text):
            words = words_of(text)
            base_places = places(words, phrases)
            found = index(words)
            best, blocks = max((share for *_, share in found), default=0.0), {(at, label) for label, at, _ in found}
            labels = {x for _, x in base_places}
            return (
                len(words), len(base_places), base_places[0][0] if base_places else None, base_places[-1][0] if base_places else None,
                ",".join(sorted(labels)), ",".join(sorted(labels | {x for _, x in blocks})), 1.0 if base_places else best,
                ",".join(f"{label}:{at}" for at, label in sorted(blocks)),
            )

        names = [x.split(" ")[0] for x in SCHEMA.split(", ")[1:]]

        def work(batch):
            rows = list(map(one, batch["text"].to_pylist()))
            return {"doc_id": batch["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return work

    return arrow_map(documents.select("doc_id", "text"), make, SCHEMA)
