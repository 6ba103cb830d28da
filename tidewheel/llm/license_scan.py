"""License texts by template markup, compiled into automata over words.

A template is a text with regions: ``[[ ... ]]`` may be left out (regions nest), ``{{name:2-40}}`` stands for any
2 to 40 words, and ``{{name:a b|c}}`` for one of the given wordings.  All other words are mandatory, and a text
matches where they stand exactly so, one after the other.

* A template becomes an automaton over words; its sets of states are made as texts need them and kept.
* The first mandatory words of a template, its *anchor*, must occur in every match.  Texts are scanned
  for hashes of all anchors at once; only where one stands the automata run, forward from the anchor
  over the rest and backward over what may precede it.  Words are compared byte by byte there.
* Phrases are found by the same scan.  Texts are independent, so nothing is shuffled.

Defined edge cases: null text is empty; texts of any length are read whole; templates without a mandatory word are
errors; repeated rows are each answered; an empty table gives no rows; extra columns are carried only when named in
``keep`` and may have any names but those of the results.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import slices, trimmed, utf8
from tidewheel.llm.textscan import ALNUM, LOWER, sequence_hashes, word_hashes, words

#: Bytes of text that are scanned at once.
SCAN_BYTES = 2 << 20
#: Words of an anchor at most, and state sets that an automaton keeps before it starts afresh.
ANCHOR, KEPT = 4, 1 << 14

# Phrases that name a license, and license wordings with their optional and replaceable regions.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_MIT_END = """The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
    AND NONINFRINGEMENT. IN NO EVENT SHALL {{holders:1-20}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """[[Copyright {{owner:1-40}}]] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
    provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {{holders:1-20}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
    FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holders:1-20}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
    NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
    STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[[,]]"""
TEMPLATES = (
    ("mit", """[[[[The]] MIT License [[(MIT)]]]] [[Copyright {{owner:1-40}}]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
    and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: """ + _MIT_END),
    ("isc", """[[ISC License]] [[Copyright {{owner:1-40}}]] Permission to use, copy, modify, [[and/]][[or]] distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{holders:1-20}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{holders:1-20}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
    OF THIS SOFTWARE."""),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3-clause", f"""{_BSD_START} [[3.]] Neither the name of {{{{holders:1-20}}}} nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission. {_BSD_END}"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{thing:this file|this work|this software}} except in compliance with the License. You may obtain a
    copy of the License at {{place:0-12}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will {{holders:1-20}} be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
    [[(see the following)]] in the product documentation would be appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented
    as being the original software. [[3.]] This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
    source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("gpl-3", _GPL + " version 3 of the License [[only]]"),
    ("gpl-3-or-later", _GPL + " either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "licensed under [[the terms of]] the GNU {{kind:general public license|gpl}} [[{{sign:v|version}}]] 3"),
    ("gpl-2", "licensed under [[the terms of]] the GNU {{kind:general public license|gpl}} [[{{sign:v|version}}]] 2"),
    ("cc-by-4", "licensed under [[{{article:a|the}}]] [[Creative Commons]] {{name:cc by|attribution}} 4.0 [[International]] [[License]]"),
    ("cc-by-sa-4", "licensed under [[{{article:a|the}}]] [[Creative Commons]] {{name:cc by sa|attribution sharealike}} 4.0 [[International]] [[License]]"),
    ("cc-by-nc-4", "licensed under [[{{article:a|the}}]] [[Creative Commons]] {{name:cc by nc|attribution noncommercial}} 4.0 [[International]] [[License]]"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PART = re.compile(r"\[\[|\]\]|\{\{([^{}]*)\}\}")


def split(text: str) -> list[bytes]:
    """The words of a text, as UTF-8, with A-Z lower-cased."""
    return [w.encode("utf-8") for w in _WORD.findall(text.encode("utf-8").lower().decode("utf-8"))]


def parsed(markup: str) -> list:
    """Elements of a template: bytes (a mandatory word), (least, most) any words, a tuple of wordings' lists, or a list (optional)."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_PART.finditer(markup), None]:
        stack[-1] += split(markup[at : m.start() if m else len(markup)])
        if m is None:
            break
        at = m.end()
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            if len(stack) < 2:
                raise ValueError(f"no region ends at {at}: {markup[:60]!r}")
            inner = stack.pop()
            stack[-1] += [inner] if inner else []
        else:
            what = m[1].split(":", 1)[-1]
            span = re.fullmatch(r"(\d+)-(\d+)", what.strip())
            stack[-1].append((int(span[1]), int(span[2])) if span else tuple(split(x) for x in what.split("|")))
    if len(stack) > 1:
        raise ValueError(f"a region does not end: {markup[:60]!r}")
    if not any(isinstance(x, bytes) for x in stack[0]):
        raise ValueError(f"a template needs a mandatory word: {markup[:60]!r}")
    return stack[0]


def anchor(elements: list) -> list[bytes]:
    """The first mandatory words that follow each other in a template."""
    first = next(k for k, x in enumerate(elements) if isinstance(x, bytes))
    return list(itertools.takewhile(lambda x: isinstance(x, bytes), elements[first : first + ANCHOR]))


def _wordings(element) -> bool:
    return isinstance(element, tuple) and isinstance(element[0], list)


def _reversed(elements: list) -> list:
    return [_reversed(x) if isinstance(x, list) else tuple(w[::-1] for w in x) if _wordings(x) else x for x in reversed(elements)]


class Automaton:
    """Reads words one by one; sets of states become states of their own as they are met."""

    def __init__(self, elements: list):
        self.on: list[dict[bytes, list[int]]] = [{}]  # by state: the states that a word leads to,
        self.any: list[list[int]] = [[]]  # that any word leads to,
        self.free: list[list[int]] = [[]]  # and that no word is needed for
        self.final = self._add(elements, 0)
        self.known = {w for edges in self.on for w in edges}
        self.start = self._closed({0})
        self.steps: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def _add(self, elements: list, at: int) -> int:
        for x in elements:
            begin = at
            if isinstance(x, bytes):
                at = self._state()
                self.on[begin].setdefault(x, []).append(at)
            elif isinstance(x, list):
                at = self._add(x, begin)
                self.free[begin].append(at)
            elif _wordings(x):
                at = self._state()
                for wording in x:
                    self.free[self._add(wording, begin)].append(at)
            else:
                least, most = x
                chain = [begin]
                for _ in range(most):
                    chain.append(self._state())
                    self.any[chain[-2]].append(chain[-1])
                at = self._state()
                for state in chain[least:]:
                    self.free[state].append(at)
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for nearby in self.free[todo.pop()]:
                if nearby not in states:
                    states.add(nearby)
                    todo.append(nearby)
        return frozenset(states)

    def longest(self, word: Callable[[int], bytes], count: int) -> int | None:
        """How many of the ``count`` words make the longest match from the first on; None if there is none."""
        now, best = self.start, 0 if self.final in self.start else None
        for k in range(count):
            own = word(k)
            own = own if own in self.known else None
            then = self.steps.get((now, own))
            if then is None:
                if len(self.steps) >= KEPT:
                    self.steps.clear()
                then = self._closed({t for s in now for t in (*self.on[s].get(own, ()), *self.any[s])})
                self.steps[now, own] = then
            if not then:
                break
            now = then
            if self.final in now:
                best = k + 1
        return best


class Matcher:
    """All templates and phrases, found by the hashes of their anchors."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]):
        self.found: dict[int, dict[int, list]] = {}  # anchor words -> hash -> entries
        for label, markup in templates:
            elements = parsed(markup)
            own = anchor(elements)
            first = elements.index(own[0])
            self._enter(own, (label, own, Automaton(elements[first:]), Automaton(_reversed(elements[:first]))))
        for phrase, label in phrases.items():
            self._enter(split(phrase), (label, split(phrase), None, None))
        self.keys = {size: np.array(sorted(own), np.uint64) for size, own in self.found.items()}

    def _enter(self, anchor: list[bytes], entry: tuple) -> None:
        raw = np.frombuffer(b" ".join(anchor), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]), ALNUM)
        key = int(sequence_hashes(word_hashes(raw, starts, ends), len(anchor))[0])
        self.found.setdefault(len(anchor), {}).setdefault(key, []).append(entry)

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list, list]]:
        """(words, phrases as (label, start, stop), templates as (label, start, stop)) of each text; places count from its first word."""
        lower = LOWER[raw]
        starts, ends, first = words(lower, offsets, ALNUM)
        hashes = word_hashes(lower, starts, ends)
        out = [(n, [], []) for n in np.diff(first).tolist()]
        data, start, end = lower.tobytes(), starts, ends
        for size, keys in self.keys.items():
            token = sequence_hashes(hashes, size)
            at = np.flatnonzero(np.isin(token, keys))
            docs = np.searchsorted(first, at, side="right") - 1
            for p, d in zip(at.tolist(), docs.tolist()):
                low, high = int(first[d]), int(first[d + 1])
                if p + size > high:
                    continue
                word = lambda k: data[start[k] : end[k]]
                for label, anchor, forward, backward in self.found[size][int(token[p])]:
                    if any(word(p + k) != w for k, w in enumerate(anchor)):
                        continue
                    if forward is None:
                        out[d][1].append((label, p - low, p - low + size))
                        continue
                    after = forward.longest(lambda k: word(p + k), high - p)  # noqa: B023
                    before = backward.longest(lambda k: word(p - 1 - k), p - low) if after is not None else None  # noqa: B023
                    if before is not None:
                        out[d][2].append((label, p - low - before, p - low + after))
        return out


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_RESULTS = "n_words bigint, phrases array<struct<label: string, start: bigint, stop: bigint>>, matches array<struct<label: string, start: bigint, stop: bigint>>"


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``keep`` columns, n_words, ``phrases`` and ``matches``: where phrases and whole templates stand, as label, first word and the word after the last."""
    for _, markup in templates:
        parsed(markup)  # errors show here, not in tasks
    names = [*keep, "n_words", "phrases", "matches"]
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, phrases)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            found = []
            for a, b in slices(offsets, SCAN_BYTES):
                found += matcher.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            spans = [pa.array([[{"label": x, "start": p, "stop": q} for x, p, q in sorted(row[k], key=lambda s: s[1:])] for row in found], _SPAN) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([n for n, *_ in found], pa.int64()), *spans], names)

    return docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{own}, {_RESULTS}" if own else _RESULTS)


def labelled(found: DataFrame) -> DataFrame:
    """A result of ``scan`` with n_base (places of phrases), first_word, last_word, base_labels, labels and score:
    a label counts 1 where a whole template gave it and 1/2 where only a phrase did, and the score is their mean, 0 without labels."""
    starts, base, proven = F.col("phrases.start"), F.col("phrases.label"), F.array_distinct("matches.label")
    labels = F.array_sort(F.array_union(base, "matches.label"))
    return found.withColumns({
        "n_base": F.size("phrases").cast("bigint"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","), "labels": F.array_join(labels, ","),
        "score": F.when(F.size(labels) > 0, (F.size(labels) + F.size(proven)) / (2.0 * F.size(labels))).otherwise(F.lit(0.0)),
    })
