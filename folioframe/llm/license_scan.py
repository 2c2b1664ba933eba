"""License scans with a generalised suffix automaton of licence words.

All templates and phrases go into one automaton over word numbers. A text's words are streamed
through it and give matching statistics: at each place the longest run of words ending there that
some template has. Runs that cannot grow are long matches; matches of one template that follow
each other in text and template are chained, and the chain's share of the template is its coverage.
A label is given from the short notice that names a licence as well as from whole grants.

The automaton has a bounded size (it depends on the templates alone) and travels with the function.
No shuffle. Null text counts as empty; a text without words has zero counts, null places, empty
labels and score 0; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import narrow, parts

#: Label of each base phrase.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices and opening or granting passages of public licences, by label; each is a template of its own.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "bsd": (
        "distributed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "gpl-notice": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "mpl-2.0": (
        "subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "isc": (
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "cc-notice": (
        "licensed under cc by 4 0",
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution",
    ),
    "unlicense": (
        "released into the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
    "reserved-notice": ("copyright all rights reserved",),
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,coverage:double>>"

#: Bytes that are no part of a word become spaces, A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Template (its number) -> places in it (exclusive ends) where the state's runs end.
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    #: Label and words of each template.
    labels: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    #: Per state the phrases that end wherever the state is reached: (words, label).
    phrases: list[list[tuple[int, str]]] = field(default_factory=list)
    pairs: np.ndarray | None = None

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for p's longest run followed by c, cut off its edge's target if that is longer."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def number(self, words: list[bytes]) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]

    @classmethod
    def build(cls, templates: dict[str, tuple[str, ...]], base: dict[str, str]) -> Automaton:
        a = cls()
        a.labels = [label for label, texts in templates.items() for _ in texts]
        runs = [a.number(words_of(t)) for texts in templates.values() for t in texts]
        phrases = {tuple(a.number(words_of(p))): label for p, label in base.items()}
        for run in [*runs, *phrases]:
            last = 0
            for c in run:
                last = a._extend(last, c)
        a.sizes = list(map(len, runs))
        for k, run in enumerate(runs):
            s = 0
            for i, c in enumerate(run):
                s = a.step[s][c]
                a.ends[s].setdefault(k, []).append(i + 1)
        for s in sorted(range(1, len(a.step)), key=lambda s: -a.length[s]):
            for k, places in a.ends[s].items():
                if a.link[s] > 0:
                    up = a.ends[a.link[s]]
                    up[k] = sorted({*up.get(k, ()), *places})
        own = defaultdict(list)
        for p, label in phrases.items():
            s = 0
            for c in p:
                s = a.step[s][c]
            own[s].append((len(p), label))
        a.phrases = [[] for _ in a.step]
        for s in sorted(range(1, len(a.step)), key=lambda s: a.length[s]):
            a.phrases[s] = own[s] + a.phrases[a.link[s]]
        n = len(a.vocabulary) + 1
        a.pairs = np.zeros(n * n, bool)
        for run in [*runs, *phrases]:
            for x, y in zip(run, run[1:], strict=False):
                a.pairs[x * n + y] = True
        return a

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that can hold a match of two words or more: each neighbouring pair is known."""
        if len(ids) < 2:
            return []
        known = self.pairs[ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        return [(int(lo), int(hi) + 1) for lo, hi in edge.reshape(-1, 2)]

    def statistics(self, ids: list[int]):
        """(state, length of the longest match ending there) for each word."""
        s = n = 0
        for c in ids:
            while s and c not in self.step[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.step[s]:
                s, n = self.step[s][c], n + 1
            yield s, n


def chains(matches: list[tuple[int, int, int]], size: int, gap: int) -> tuple[float, int, int]:
    """(coverage, first word, end) of the best chain of one template's matches.

    matches: (start in the text, start in the template, words). In a chain text and template both
    advance, with at most `gap` words left out of either between two matches.
    """
    matches = sorted(set(matches))
    best: list[tuple[int, int]] = []  # covered words, chain's first word
    top = (0, 0, 0)
    for i, (at, t, n) in enumerate(matches):
        covered, start = n, at
        for j in range(i - 1, -1, -1):
            a, u, m = matches[j]
            if at - a > gap + size:
                break
            over = max(0, a + m - at, u + m - t)
            if a < at and u < t and over < n and at - (a + m) <= gap and t - (u + m) <= gap and best[j][0] + n - over > covered:
                covered, start = best[j][0] + n - over, best[j][1]
        best.append((covered, start))
        top = max(top, (covered, -start, at + n))
    return min(1.0, top[0] / size), -top[1], top[2]


def scan(text: str, a: Automaton, shortest: int, gap: int, share: float) -> dict:
    """One text's row of SCHEMA, without its id."""
    words = words_of(text)
    get = a.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    base: list[tuple[int, str]] = []
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for lo, hi in a.stretches(ids):
        stats = [*a.statistics(ids[lo:hi].tolist()), (0, 0)]
        for i, (s, n) in enumerate(stats[:-1]):
            phrases = [(lo + i + 1 - size, label) for size, label in a.phrases[s] if size <= n]
            base += phrases
            if phrases or n >= shortest and stats[i + 1][1] <= n:
                for k, places in a.ends[s].items():
                    found[k] += [(lo + i + 1 - n, e - n, n) for e in places]
    best: dict[str, tuple[float, int, int]] = {}
    for k, matches in found.items():
        coverage, start, end = chains(matches, a.sizes[k], gap)
        best[a.labels[k]] = max(best.get(a.labels[k], (0.0, 0, 0)), (coverage, -start, end))
    spans = [{"label": label, "start": -start, "end": end, "coverage": coverage} for label, (coverage, start, end) in best.items() if coverage >= share]
    places, labels = [b[0] for b in base], {b[1] for b in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {x["label"] for x in spans})),
        "score": max([x[0] for x in best.values()], default=1.0 if base else 0.0),
        "spans": sorted(spans, key=lambda x: (x["start"], x["label"])),
    }


def license_scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, base: dict[str, str] | None = None, shortest: int = 4, gap: int = 12, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Base phrases and covered template spans of every whole text (SCHEMA).

    shortest: words of a match that takes part in a chain; one that ends in a base phrase always does. gap: words
    left out between two matches of a chain, of the text or the template. share: coverage from which a
    template's label is given; spans: the best chain of each such label. score: the best coverage of any
    template (1 for a base phrase that no template has).
    """
    a = Automaton.build(TEMPLATES if templates is None else templates, BASE if base is None else base)

    def run(batches):
        kind = None
        for ids, texts in parts(batches):
            rows = [{"doc_id": i} | scan(t, a, shortest, gap, share) for i, t in zip(ids.to_pylist(), texts, strict=True)]
            kind = kind or pa.schema(
                [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                 ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])))]
            )
            yield pa.RecordBatch.from_pylist(rows, kind)

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)
