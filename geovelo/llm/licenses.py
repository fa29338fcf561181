"""License scans: matching statistics over a generalised suffix automaton of licence tokens, chained into template spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, utf8

# Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Characteristic passages of common licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License",
}
# What follows those passages in the licences, so that a file without the opening is seen too.
REST = {
    "mit/2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd/2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd/3": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "apache/2": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "gpl/2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program",
    "isc/2": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
}
#: Matches of fewer tokens are not chained; tokens that a chain may skip; share of a template that a chain must cover.
MIN_MATCH, MAX_GAP, COVER = 4, 8, 0.6

_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or b"").translate(_PLAIN).split()


class Automaton:
    """Suffix automaton over the templates' tokens, a separator of its own after each one. Each state keeps all (template, place) where its strings end."""

    def __init__(self, templates: dict[str, str] | None = None):
        passages = sorted((TEMPLATES | REST).items() if templates is None else templates.items())
        self.names = [n.partition("/")[0] for n, _ in passages]
        told = [words(t.encode()) for _, t in passages]
        self.sizes = [len(w) for w in told]
        self.ids = {w: k + 1 for k, w in enumerate(sorted({x for w in told for x in w}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        last = 0
        for k, w in enumerate(told):
            for at, x in enumerate([*map(self.ids.get, w), -1 - k]):
                last = self._extend(last, x)
                if x > 0:
                    self.ends[last].add((k, at))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= MIN_MATCH:
                self.ends[self.link[s]] |= self.ends[s]

    def _extend(self, last: int, x: int) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                while p >= 0 and self.next[p].get(x) == q:
                    self.next[p][x] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        return new

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, tokens, state) of each match of MIN_MATCH tokens or more that cannot be longer on either side. ids: 0 is a token of no template; a match lies within a run of known tokens, so short runs hold none."""
        known = np.concatenate(([0], ids != 0, [0])).astype(np.int8)
        turns = np.flatnonzero(np.diff(known))
        starts, stops = turns[::2], turns[1::2]
        for lo, hi in zip(starts[stops - starts >= MIN_MATCH].tolist(), stops[stops - starts >= MIN_MATCH].tolist(), strict=True):
            state = size = 0
            for at, x in enumerate(ids[lo:hi].tolist(), lo):
                if x in self.next[state]:
                    state, size = self.next[state][x], size + 1
                    continue
                if size >= MIN_MATCH:
                    yield at - size, size, state
                while state and x not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if x in self.next[state]:
                    state, size = self.next[state][x], size + 1
            if size >= MIN_MATCH:
                yield hi - size, size, state

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first word, last word, share of the template's tokens covered) of each template's chains.

        A chain goes forward in the text and in the template and skips at most MAX_GAP tokens of either between two matches; each match goes on with the chain that covers most. Chains
        that cover COVER of the template are given, the larger first where they overlap; of a template without any, the best one.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: first word, end in the text, end in the template, tokens covered
        good: dict[int, list[tuple[int, int, int]]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for start, size, state in self.matches(ids):
            for k, end in sorted(self.ends[state]):
                begin = end - size + 1
                live = [c for c in open_.get(k, ()) if c[1] >= start - MAX_GAP]
                chain = (start, start + size, end + 1, size)
                for first, to, upto, got in live:
                    lap = max(0, to - start, upto - begin)
                    if 0 <= start + lap - to <= MAX_GAP and 0 <= begin + lap - upto <= MAX_GAP and size > lap and got + size - lap > chain[3]:
                        chain = (first, start + size, end + 1, got + size - lap)
                open_[k] = [*live, chain]
                told = (-chain[3], chain[0], chain[1] - 1)
                best[k] = min(told, best.get(k, told))
                if chain[3] >= COVER * self.sizes[k]:
                    good.setdefault(k, []).append(told)
        found = []
        for k in sorted(best):
            kept: list[tuple[int, int, int]] = []
            for got, a, b in sorted(good.get(k, [best[k]])):
                if all(b < x or a > y for _, x, y in kept):
                    kept.append((got, a, b))
            found += [(self.names[k], a, b, min(1.0, -got / self.sizes[k])) for got, a, b in sorted(kept, key=lambda x: x[1])]
        return found


_PHRASE = {p: re.compile(b"(?= " + p.encode() + b" )") for p in PHRASES}


def places(told: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand consecutively."""
    joined = b" " + b" ".join(told) + b" "
    found = []
    for phrase, label in PHRASES.items():
        if b" " + phrase.encode() + b" " in joined:
            spots = [m.start() for m in _PHRASE[phrase].finditer(joined)]
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            found += [(int(k), label) for k in np.searchsorted(gaps, spots)]
    return sorted(found)


def scan(docs: DataFrame, automaton: Automaton | None = None) -> DataFrame:
    """(doc_id, n_words, places, spans, score) for every row of docs.

    places: array of (word, label) where a base phrase starts; spans: array of (template, first, last, share) of the best
    chains, by template and place. score is the highest share of a template that a chain covers; base phrases don't count for it. Null and empty texts have no
    words; very long texts are read whole; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    own = docs.sparkSession.sparkContext.broadcast(automaton or Automaton())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = own.value
        for part in pieces(batches):
            out = []
            for text in utf8(part.column(1)):
                told = words(text)
                base = places(told)
                spans = known.spans(np.fromiter(map(known.ids.get, told, repeat(0)), np.int64, len(told)))
                score = max((x[3] for x in spans), default=0.0)
                out.append((len(told), [{"word": w, "label": x} for w, x in base], [dict(zip(("template", "first", "last", "share"), x, strict=True)) for x in spans], score))
            n, at, spans, score = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(at, _PLACES), pa.array(spans, _CHAINS), pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, spans array<struct<template:string,first:bigint,last:bigint,share:double>>, score double")


_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_CHAINS = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
