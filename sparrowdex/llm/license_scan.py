"""License scan by matching template markup.

A template is the text of a licence notice with optional and replaceable regions:

    <<beginOptional>>may be left out<<endOptional>>
    <<var;name="year";original="2020";match="[0-9]{4}">>   (replaceable: `match` is a
                                  regular expression over the tokens, joined by spaces)

Templates and documents are cut into the same tokens: words of letters and digits,
lower case, with everything else as separators (a version like 2.0 is two tokens).
A template compiles to an automaton over tokens: a chain for mandatory wording, a
bypass for every optional region (they may nest) and, for a replaceable region, any
run of tokens that matches its expression as a whole: the expression alone bounds it.
A document is accepted at a place if the automaton gets from its start to its end
there: mandatory wording matches token for token, nothing more and nothing less.

Scanning: each template has a mandatory token sequence outside any markup, its
anchor. Only documents that hold an anchor (a C-speed search of the normalised
text) are run through the automaton, so the result is that of trying every place.
Runs for a region are tried from short to long, until no longer one can match.

Ties: of several matches of one template that overlap, the leftmost longest counts; a
match that lies inside a longer one of another template isn't reported.

Defined results: null, empty or tokenless texts match nothing, nor does an empty
table. Texts of any length are scanned in full. Rows that repeat an id and a text give
one result row for each match; different texts that share an id, or have none, give
theirs. Extra columns are never read.

TEMPLATES holds common notices and short licences: MIT, ISC, BSD (two and three
clauses), Boost and Unlicense texts, and the usual notices of MIT, Apache 2.0, the GPL
family, MPL 2.0, CC BY and CC0. The full texts of the long licences aren't among them."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import text_key

_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[a-zA-Z]+=\"(?:[^\"]*)\")*)>>", re.S)
_TOKEN = re.compile(r"[^\W_]+")
_ANYTHING = re.compile(r"\.(?:\*|\+|\{(\d+),(\d*)\})")

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_HOLDER = '<<var;name="copyright";original="the author";match=".{0,500}">>'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

TEMPLATES: dict[str, str] = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY + "IN NO EVENT SHALL " + _HOLDER + " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": '<<var;name="verb";original="Released";match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the <<endOptional>>MIT License<<beginOptional>>, see the LICENSE file for details<<endOptional>>',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License<<endOptional>>",
    "GPL-notice": '<<beginOptional>>This <<var;name="what";original="work";match="work|program|software|file|library">> is <<endOptional>>licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> version <<var;name="version";original="3";match="1|2|3|2 0|3 0">><<beginOptional>> or <<beginOptional>>(at your option) <<endOptional>>any later version<<endOptional>>',
    "CC-BY-notice": '<<beginOptional>>This <<var;name="what";original="work";match="work|document|text|page|article">> is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-<<var;name="kind";original="SA";match="sa|nd">><<endOptional>> <<var;name="version";original="4.0";match="[1-4] [05]">><<beginOptional>> International<<endOptional>><<beginOptional>> License<<endOptional>>',
    "ISC": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,200}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + ' <<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="holder";original="the copyright holder";match=".{1,200}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "GPL-header": "<<beginOptional>>This <<endOptional>><<var;name=\"what\";original=\"program\";match=\"[^ ]+\">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>><<var;name=\"kind\";original=\"Lesser\";match=\"lesser|library|affero\">> <<endOptional>>General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version <<var;name=\"version\";original=\"3\";match=\"1|2|3|2 [01]|3 0\">><<beginOptional>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.<<beginOptional>> If a copy of the MPL was not distributed with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/<<endOptional>>",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.<<beginOptional>> (See accompanying file LICENSE_1_0.txt or copy at http<<beginOptional>>s<<endOptional>>://www.boost.org/LICENSE_1_0.txt)<<endOptional>>",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-notice": '<<beginOptional>>This <<var;name="what";original="work";match="work|document|text|page|article">> is <<endOptional>><<var;name="verb";original="released";match="released|licensed|available|marked|dedicated to the public domain">> under <<beginOptional>>the <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC0<<beginOptional>> 1.0<<endOptional>><<beginOptional>> Universal<<endOptional>>',
}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Region:
    """What a replaceable region may hold: tokens that, joined by spaces, match an expression."""

    def __init__(self, expression: str):
        whole = _ANYTHING.fullmatch(expression)
        self.least = self.most = None
        if whole:  # any text of a length: no need to run the expression
            self.least = int(whole[1] or 0) if "{" in expression else int(expression == ".+")
            self.most = int(whole[2]) if whole[2] else None
        self.expression = regex.compile(expression, regex.S)

    def ends(self, text: str, offsets: list[int], i: int):
        """Every j so that words[i:j] of `text` match, in order; offsets are those of the words and one past the last."""
        at = offsets[i]
        for j in range(i, len(offsets)):
            end = offsets[j] - 1 if j > i else at
            if self.least is not None:
                if self.most is not None and end - at > self.most:
                    return
                if end - at >= self.least:
                    yield j
            else:
                m = self.expression.fullmatch(text, at, end, partial=True)
                if m is None:  # nor can anything longer match
                    return
                if not m.partial or self.expression.fullmatch(text, at, end):
                    yield j


class Words:
    """Tokens of a text, joined by spaces, with the offset of each."""

    def __init__(self, words: list[str]):
        self.words, self.text = words, " ".join(words)
        self.offsets = [0]
        for w in words:
            self.offsets.append(self.offsets[-1] + len(w) + 1)


class Automaton:
    """States are numbers; `moves[s]` lists (token, next), `skips[s]` free moves,
    `regions[s]` (what a replaceable region may hold, next)."""

    def __init__(self, template: str):
        self.moves: list[list[tuple[str, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.regions: list[list[tuple[Region, int]]] = [[]]
        runs: list[list[str]] = [[]]  # mandatory token runs
        open_: list[int] = []
        at = pos = 0
        for mark in [*_MARK.finditer(template), None]:
            for t in tokens(template[pos : mark.start() if mark else len(template)]):
                nxt = self._state()
                self.moves[at].append((t, nxt))
                at = nxt
                if not open_:
                    runs[-1].append(t)
            if mark is None:
                break
            pos = mark.end()
            runs.append([])
            if mark[1] == "beginOptional":
                open_.append(at)
            elif mark[1] == "endOptional":
                if not open_:
                    raise ValueError("endOptional without beginOptional")
                self.skips[open_.pop()].append(at)
            else:
                expression = re.search(r';match="([^"]*)"', mark[2])
                nxt = self._state()
                self.regions[at].append((Region(expression[1] if expression else ".*"), nxt))
                at = nxt
        if open_:
            raise ValueError("beginOptional without endOptional")
        self.end = at
        self.anchor = max(runs, key=lambda r: (sum(map(len, r)), r))
        if not self.anchor:
            raise ValueError("a template needs mandatory wording outside of markup")
        self.next = [self._first(s) for s in range(len(self.moves))]

    def _state(self) -> int:
        for x in (self.moves, self.skips, self.regions):
            x.append([])
        return len(self.moves) - 1

    def _first(self, start: int) -> set[str] | None:
        """Tokens of which the next must be one in a state; None if it may be any, or none."""
        first, todo, seen = set(), [start], set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if self.regions[s] or s == self.end:
                return None
            first |= {t for t, _ in self.moves[s]}
            todo += self.skips[s]
        return first

    def match(self, own: Words, start: int) -> int:
        """Index after the longest match that begins at `start`, or -1."""
        words, best, todo, seen = own.words, -1, [(0, start)], set()
        while todo:
            s, i = todo.pop()
            if (s, i) in seen:
                continue
            seen.add((s, i))
            if s == self.end:
                best = max(best, i)
            todo += [(n, i) for n in self.skips[s]]
            if i < len(words):
                todo += [(n, i + 1) for t, n in self.moves[s] if t == words[i]]
            for region, n in self.regions[s]:
                after = self.next[n]
                todo += [(n, j) for j in region.ends(own.text, own.offsets, i) if after is None or j < len(words) and words[j] in after]
        return best


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.machines = []
        for name, text in (TEMPLATES if templates is None else templates).items():
            m = Automaton(text)
            self.machines.append((name, m, f" {' '.join(m.anchor)} "))
        # a literal that every anchor's document has in some letter case
        self.rare = [max(m.anchor, key=lambda t: (len(t), t)) for _, m, _ in self.machines]

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(license, first token, number of tokens) of every match that counts."""
        if not text:
            return []
        low = text.lower()
        live = [m for m, r in zip(self.machines, self.rare) if r in low]
        if not live:
            return []
        own = Words(_TOKEN.findall(low))
        joined, words, out = f" {own.text} ", own.words, []
        for name, machine, anchor in live:
            if anchor not in joined:
                continue
            i, first = 0, machine.next[0]
            while i < len(words):
                if first is None or words[i] in first:
                    j = machine.match(own, i)
                    if j > i:
                        out.append((name, i, j - i))
                        i = j
                        continue
                i += 1
        return _outermost(out)


def _outermost(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without matches inside a longer one, which is of another template: those of one don't overlap."""
    out, end, same, last = [], -1, None, -1
    for m in sorted(found, key=lambda m: (m[1], -m[2])):
        if m[1:] != same:  # matches of equal extent don't hide each other
            same, end = m[1:], max(end, last)
        if end < m[1] + m[2]:
            out.append(m)
        last = m[1] + m[2]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_token, n_tokens), one row for each match."""

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(d, k, *m) for d, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))) for m in scanner.scan(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "row", "license", "first_token", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long"), text_key(text), text)
    return rows.mapInArrow(run, "doc_id long, row long, license string, first_token long, n_tokens long").distinct().drop("row")
