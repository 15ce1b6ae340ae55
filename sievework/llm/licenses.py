"""Licence scans: matching statistics against a generalised suffix automaton of licence templates.

1. *Automaton.*  The words of all templates, short phrases and notices alike, go into one suffix automaton
   (a few thousand states, built once per Python worker).  Every state knows where in the notices its word
   sequences end, and which phrases end with them.
2. *Matching statistics.*  A text is cut into words by Arrow kernels; only stretches whose neighbouring words are
   neighbours in some template enter the automaton, which no match of two words or more can leave.
   At every word the automaton gives the longest word sequence ending there that some template contains.
   Where that sequence ends with a phrase, the phrase stands there.
3. *Chains.*  A sequence of ``MIN_WORDS`` words or more that the next word does not continue is a block of every
   notice that contains it.  The blocks of a notice are chained in order of text and template, over gaps of
   ``GAP`` words at most; a chain that covers ``COVER`` of the notice is a span of it.

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  Every span has its template,
label, words (from 0, end exclusive) and coverage; a phrase's is 1.

Defined cases: null text has no words and no spans; a long text is read whole, a block of texts at a time;
equal chains of one notice are all spans; repeated rows are judged alike; an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.words import text_slices

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_WORDS, GAP, COVER = 6, 12, 0.5

# Phrases of the contract, further phrases, and standard notices with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
}
NOTICES = {
    "mit-permission": (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
    ),
    "apache-2-header": (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    "gpl-header": (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details.""",
    ),
    "bsd-conditions": (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ),
    "isc-permission": (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    "mpl-2-header": (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "cc-by-4-statement": (
        "cc-by",
        """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by/4.0/.""",
    ),
}

SPAN = "template:string,label:string,base:boolean,start:bigint,end:bigint,coverage:double"


class Template:
    def __init__(self, name: str, label: str, words: list[str], base: bool, phrase: bool):
        self.name, self.label, self.words, self.base, self.phrase = name, label, words, base, phrase


def _words(text: str) -> list[str]:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(BETWEEN, low) if w]


def templates() -> list[Template]:
    short = [Template(p, label, _words(p), known is BASE, True) for known in (BASE, PHRASES) for p, label in known.items()]
    return short + [Template(name, label, _words(text), False, False) for name, (label, text) in NOTICES.items()]


class Automaton:
    """Generalised suffix automaton over the words of ``templates``; state 0 is the start."""

    def __init__(self, found: list[Template]):
        self.templates = found
        self.vocabulary = sorted({w for t in found for w in t.words})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        pairs = set()
        for k, template in enumerate(found):
            ids, state = [number[w] for w in template.words], 0
            pairs.update(zip(ids, ids[1:], strict=False))
            for at, word in enumerate(ids):
                state = self._extend(state, word)
                ends[state].append((k, at + 1))
        self.pairs = np.array(sorted(a * len(number) + b for a, b in pairs), dtype=np.int64)
        # What ends in a state ends in every shorter suffix of it as well.
        self.notices: list[list[tuple[int, int]]] = [[] for _ in self.step]
        whole: dict[int, list[int]] = defaultdict(list)
        for state, places in ends.items():
            for k, at in places:
                if found[k].phrase:
                    if at == len(found[k].words):
                        whole[state].append(k)
                    continue
                up = state
                while up > 0:
                    self.notices[up].append((k, at))
                    up = self.link[up]
        self.phrases: list[list[int]] = [[] for _ in self.step]
        for state in range(len(self.step)):
            up = state
            while up > 0:
                self.phrases[state] += whole.get(up, ())
                up = self.link[up]

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, source: int, word: int) -> int:
        """The state of exactly the sequences of ``source`` and ``word``, cut out of a larger one if need be."""
        old = self.step[source][word]
        if self.length[old] == self.length[source] + 1:
            return old
        new = self._new(dict(self.step[old]), self.link[old], self.length[source] + 1)
        self.link[old] = new
        while source >= 0 and self.step[source].get(word) == old:
            self.step[source][word] = new
            source = self.link[source]
        return new

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def scan(self, ids: list[int], at: int, spans: list, blocks: dict[int, list]) -> None:
        """One stretch of words, the first of which is word ``at``: phrases to ``spans``, blocks by notice."""
        state = length = 0
        for k, word in enumerate([*ids, -1]):
            if word not in self.step[state]:
                told = set()
                while state and word not in self.step[state]:
                    if length >= MIN_WORDS:
                        for place in self.notices[state]:
                            if place not in told:
                                told.add(place)
                                blocks[place[0]].append((at + k - length, at + k, place[1] - length, place[1]))
                    state = self.link[state]
                    length = self.length[state]
                if word not in self.step[0] and not state:
                    continue
            state, length = self.step[state][word], length + 1
            for phrase in self.phrases[state]:
                size = len(self.templates[phrase].words)
                if length >= size:
                    spans.append((phrase, at + k + 1 - size, at + k + 1, 1.0))


def chains(blocks: list[tuple[int, int, int, int]], size: int) -> Iterator[tuple[int, int, float]]:
    """``start, end, coverage`` of the best chain from every first block of one notice.

    A block follows another that begins and ends before it in text and template, ``GAP`` words before at most.
    Blocks end at different words, and only those within a block's length and ``GAP`` are looked at, so the work
    is in proportion to the text.
    """
    blocks = sorted(set(blocks), key=lambda b: (b[1], b[3]))
    longest = max(b[1] - b[0] for b in blocks)
    best: list[tuple[int, int]] = []  # words covered, first block of the chain
    top: dict[int, tuple[int, int]] = {}
    for k, (s, e, ts, te) in enumerate(blocks):
        covered, root = e - s, k
        for j in range(k - 1, -1, -1):
            s0, e0, ts0, te0 = blocks[j]
            if e0 < s - GAP - longest:
                break
            if e0 >= s - GAP and s0 < s and e0 < e and ts0 < ts and te0 < te:
                more = best[j][0] + min(e - max(s, e0), te - max(ts, te0))
                if more > covered:
                    covered, root = more, best[j][1]
        best.append((covered, root))
        if root not in top or covered > top[root][0]:
            top[root] = (covered, e)
    for root, (covered, end) in top.items():
        if covered >= COVER * size:
            yield blocks[root][0], end, min(1.0, covered / size)


@functools.cache
def automaton() -> Automaton:
    return Automaton(templates())


def _stretches(ids: np.ndarray, row: np.ndarray, known: Automaton) -> Iterator[tuple[int, int]]:
    """Where neighbouring words are neighbours in a template: first word, and the end."""
    if len(ids) < 2:
        return
    pair = ids[:-1].astype(np.int64) * len(known.vocabulary) + ids[1:]
    there = (ids[:-1] >= 0) & (ids[1:] >= 0) & (row[:-1] == row[1:])
    there[there] = np.isin(pair[there], known.pairs)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], there.astype(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = automaton()
    vocabulary = pa.array(known.vocabulary, pa.string())
    for batch in batches:
        for part in text_slices(batch):
            pieces = pc.split_pattern_regex(pc.ascii_lower(part["text"]), pattern=BETWEEN)
            words, row = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
            real = pc.not_equal(words, "")
            ids = pc.fill_null(pc.index_in(words.filter(real), value_set=vocabulary), -1).to_numpy()
            row = row.filter(real).to_numpy()
            n_words = np.bincount(row, minlength=len(part))
            begun = np.concatenate([[0], np.cumsum(n_words)])
            spans: dict[int, list] = defaultdict(list)
            blocks: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            for a, b in _stretches(ids, row, known):
                doc = int(row[a])
                known.scan(ids[a:b].tolist(), a - int(begun[doc]), spans[doc], blocks[doc])
            for doc, found in blocks.items():
                for k, places in found.items():
                    spans[doc] += [(k, *span) for span in chains(places, len(known.templates[k].words))]
            yield pa.record_batch(
                {
                    "doc_id": part["doc_id"],
                    "n_words": pa.array(n_words, pa.int64()),
                    "spans": pa.array(
                        [
                            [
                                {"template": t.name, "label": t.label, "base": t.base, "start": s, "end": e, "coverage": c}
                                for k, s, e, c in sorted(spans.get(doc, ()), key=lambda x: (x[1], x[2], x[0]))
                                for t in (known.templates[k],)
                            ]
                            for doc in range(len(part))
                        ],
                        pa.list_(
                            pa.struct(
                                [
                                    ("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()),
                                    ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()),
                                ]
                            )
                        ),
                    ),
                }
            )


def license_spans(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_words, spans``: whole phrases and covered stretches of notices, in order of text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scan, f"doc_id long, n_words long, spans array<struct<{SPAN}>>")


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_labels(docs: DataFrame) -> DataFrame:
    """Per row the number, first and last place of base phrases, the labels, and the best coverage as ``score``."""
    base = F.filter("spans", lambda s: s["base"])
    return license_spans(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        _listed(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        _listed(F.col("spans.label")).alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"),
    )
