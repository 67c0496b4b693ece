"""Licence scan: a generalised suffix automaton over the words of licence templates.

A text's words stream through the automaton, which gives at each word, for each template, the length of its longest
passage that ends there (the matching statistics). Matches that no further word prolongs are chained, for each template,
in the order of both text and template across small gaps, into covered spans. Base phrases are in the automaton too; a
phrase stands wherever the matched passage has it as its end, so both come from one walk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

# Phrases whose every place is reported, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Openings of public licences and notices, lower case, words only.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "released under the mit license",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-notice": "licensed under the apache license version 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: Matches of fewer words are not chained; a chain may skip so many words of text or template; it labels a text if it
#: covers that share of its template and four words, or that many words.
LEAST_WORDS, MOST_GAP, LEAST_COVER, LEAST_CHAIN, ENOUGH_WORDS = 3, 6, 0.6, 4, 24
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


class Automaton:
    """Generalised suffix automaton over word ids; each state knows, by template, every end of its passages.

    Ends are kept for each state, so memory goes by the sum of the templates' repeated passages, not by the texts.
    """

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, set[int]]] = [{}]
        self.names = list(templates)
        self.sizes = []
        texts = [t.split() for t in templates.values()]
        for k, words in enumerate([*texts, *(p.split() for p in phrases)]):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, self.vocabulary.setdefault(w.encode(), len(self.vocabulary)))
                if k < len(texts):
                    self.places[last].setdefault(k, set()).add(i + 1)
            self.sizes.append(len(words))
        by_length = sorted(range(1, len(self.go)), key=self.length.__getitem__)
        for v in reversed(by_length):
            for k, ends in self.places[v].items():
                if self.link[v] > 0:
                    self.places[self.link[v]].setdefault(k, set()).update(ends)
        #: By state: each template that has an end of its passages, with the state of the longest such end.
        self.reach: list[dict[int, int]] = [{} for _ in self.go]
        for v in by_length:
            self.reach[v] = self.reach[self.link[v]] | dict.fromkeys(self.places[v], v)
        #: By state: the phrases that end wherever it ends, with the least matched length.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.go]
        for phrase, label in phrases.items():
            words = [self.vocabulary[w.encode()] for w in phrase.split()]
            at = 0
            for w in words:
                at = self.go[at][w]
            for v in range(1, len(self.go)):
                up = v
                while up > 0 and up != at:
                    up = self.link[up]
                if up == at:
                    self.phrases[v].append((len(words), label))

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        self.places.append({})
        return len(self.go) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the shorter passages that reach it from p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = copy
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        if (q := self.go[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Phrase places (start, label); by template, matches (end, length, template, state) of LEAST_WORDS words or more that no further word prolongs."""
        hits, matches = [], []
        go, link, length, phrases = self.go, self.link, self.length, self.phrases
        state = size = 0
        open_: dict[int, tuple[int, int]] = {}
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = size = 0
            else:
                while state and c not in go[state]:
                    state = link[state]
                    size = length[state]
                state = go[state].get(c, 0)
                size = size + 1 if state else 0
                if phrases[state]:
                    hits += [(i + 1 - n, label) for n, label in phrases[state] if size >= n]
            if open_ or size >= LEAST_WORDS:
                now = {k: (n, v) for k, v in self.reach[state].items() if (n := min(size, length[v])) >= LEAST_WORDS}
                matches += [(i, n, k, v) for k, (n, v) in open_.items() if k not in now or now[k][0] != n + 1]
                open_ = now
        return hits, matches + [(len(words), n, k, v) for k, (n, v) in open_.items()]

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, end, words covered, share of the template) of the chains that label a text.

        A match stands for a link at every place of its passage in the template. For each link the chain of greatest cover
        that ends with it is found (ties: the one that begins last); of those that label, a template keeps the ones that
        share no word of the text and cover most in sum. A link looks back over links within its own length and MOST_GAP
        only, so the time goes by the text's length times the templates' sizes.
        """
        links: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, size, k, v in matches:
            links.setdefault(k, []).extend((end - size, end, at - size, at) for at in sorted(self.places[v][k]))
        done = []
        for k, own in links.items():
            best: list[tuple[int, int]] = []
            low = 0
            for j, (start, end, begin, upto) in enumerate(own):
                while own[low][1] < start - MOST_GAP:
                    low += 1
                got = (end - start, start)
                for i in range(low, j):
                    _, last, _, at = own[i]
                    new = end - start - max(0, last - start, at - begin)
                    if new > 0 and begin - at <= MOST_GAP:
                        got = max(got, (best[i][0] + new, best[i][1]))
                best.append(got)
            ends = [x[1] for x in own]
            total, taken = [0], []
            for j, (cover, first) in enumerate(best):
                labels = cover >= ENOUGH_WORDS or (cover >= LEAST_CHAIN and cover >= LEAST_COVER * self.sizes[k])
                before = bisect_right(ends, first, 0, j)
                taken.append(before if labels and total[before] + cover > total[j] else -1)
                total.append(total[before] + cover if taken[j] >= 0 else total[j])
            j = len(own)
            while j:
                if taken[j - 1] < 0:
                    j -= 1
                else:
                    cover, first = best[j - 1]
                    done.append((self.names[k], first, ends[j - 1], cover, cover / self.sizes[k]))
                    j = taken[j - 1]
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=2)
def automaton(templates: tuple = tuple(TEMPLATES.items()), phrases: tuple = tuple(PHRASES.items())) -> Automaton:
    return Automaton(dict(templates), dict(phrases))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of 0-9, a-z and everything beyond ASCII."""
    return text.translate(_TO_WORDS).split()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (template, first, end, covered, share), words from 0, end exclusive. score: the largest share of a
    template that a span covers, 1 where a base phrase stands. templates and phrases: lower-case words by name (a name's
    ending `-notice` is no part of its label), and labels by phrase. Null and empty texts have no words, empty labels and score
    0; ids may be null or repeated; other columns are ignored.
    """

    wanted = tuple(templates.items()), tuple(phrases.items())

    def rows(texts):
        a = automaton(*wanted)
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for t in texts:
            words = words_of(t)
            hits, matches = a.scan(words)
            spans = a.chain(matches) if matches else []
            base = {label for _, label in hits}
            at = [i for i, _ in hits]
            found = (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0].removesuffix("-notice") for s in spans})), max([float(bool(hits)), *(s[4] for s in spans)]), [dict(zip(("template", "first", "end", "covered", "share"), s, strict=True)) for s in spans])
            for k, v in zip(out, found, strict=True):
                out[k].append(v)
        import pyarrow as pa

        kind = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        return out | {"spans": pa.array(out["spans"], kind), "first_word": pa.array(out["first_word"], pa.int64()), "last_word": pa.array(out["last_word"], pa.int64())}

    return map_texts(df, id_col, text_col, rows, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,first:long,end:long,covered:long,share:double>>")
