"""License scans (6): a positional index of rare licence words.

The templates below are indexed by their rare words, those of highest inverse template frequency: each word has its
postings (template, position). In every file the occurrences of these words are found by hash, and the postings of all
of them are intersected by relative position: a template is a candidate where words with at least LEAST of the weight
of its rare words agree, within SLACK words, on where it begins. A candidate is verified by its mandatory key phrases,
which must stand word by word at their own places relative to that beginning, within SLACK as well. Its label is then
one of the file's. The score is the largest share of a template's weight that agrees on one beginning.

Apart from that, the places of the base phrases are counted and give their labels, wherever they stand.

Defined cases: null or empty text has 0 words, no places, no labels ('' each) and score 0. Repeated documents are
reported each on their own. Only doc_id and text of the input are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textblocks as tb
from tessera.llm.cluster import prepare, tidied

# Phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, notice in lower case without punctuation, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee", "this permission notice appear in all copies"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "except in compliance with the license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["under the terms of the gnu general public license", "either version 3 of the license"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["under the terms of the gnu general public license", "either version 2 of the license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["subject to the terms of the mozilla public license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["under the terms of the eclipse public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("wtfpl", "this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it under the terms of the do what the fuck you want to public license", ["do what the fuck you want to public license"]),
]

#: A word is rare if at most this share of the templates has it.
RARE = 0.125
#: Least share of a candidate's weight, and words by which its words may stand apart from their places.
LEAST, SLACK = 0.5, 3
_FILTER_BITS = 16


class Index:
    """Postings of the templates' rare words, and the anchor of each key phrase."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str, list[str]]]):
        self.base, self.templates = base, templates
        notices = [notice.split() for _, notice, _ in templates]
        df = Counter(word for notice in notices for word in set(notice))
        idf = {word: math.log(1 + len(notices) / n) for word, n in df.items()}
        postings, self.total = [], []
        for t, notice in enumerate(notices):
            # A template of common words alone is indexed by the rarest of them.
            most = max(RARE * len(notices), min(df[w] for w in notice))
            rare = [j for j, w in enumerate(notice) if df[w] <= most]
            postings += [(tb.word_hash(notice[j].encode()), t, j, idf[notice[j]]) for j in rare]
            self.total.append(sum(idf[notice[j]] for j in rare))
        postings.sort()
        keys = np.array([p[0] for p in postings], np.uint64)
        self.words, self.first, self.many = np.unique(keys, return_index=True, return_counts=True)
        self.template, self.place = (np.array([p[i] for p in postings], np.int64) for i in (1, 2))
        self.weight = np.array([p[3] for p in postings])
        self.share = self.weight / np.array(self.total)[self.template] if postings else self.weight
        phrases = dict.fromkeys([*base, *(p for _, _, needed in templates for p in needed)])
        self.phrases = {}
        for phrase in phrases:
            words = phrase.split()
            anchor = max(range(len(words)), key=lambda j: (idf.get(words[j], math.log(1 + len(notices))), -j))
            self.phrases[phrase] = (anchor, np.array([tb.word_hash(w.encode()) for w in words], np.uint64))
        #: Where each mandatory phrase begins in its template.
        self.needed = [[(p, next(j for j in range(len(n)) if n[j : j + len(p.split())] == p.split())) for p in needed] for n, (_, _, needed) in zip(notices, templates, strict=True)]
        self.seeds = np.array(sorted({int(h[a]) for a, h in self.phrases.values()} | {int(x) for x in self.words}), np.uint64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def places(self, w: tb.Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """First words of each phrase's occurrences, and all positions of indexed words."""
        h, n = w.hashes, len(w.hashes)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = at[np.isin(h[at], self.seeds)]
        ends = w.word_bounds[np.searchsorted(w.word_bounds, at, side="right")] if len(at) else at
        begins = w.word_bounds[np.searchsorted(w.word_bounds, at, side="right") - 1] if len(at) else at
        out = {}
        for phrase, (anchor, hashes) in self.phrases.items():
            hit = h[at] == hashes[anchor]
            start = at[hit] - anchor
            fits = (start >= begins[hit]) & (start + len(hashes) <= ends[hit])
            start = start[fits]
            for j, x in enumerate(hashes):
                start = start[h[np.minimum(start + j, n - 1)] == x]
            out[phrase] = start
        return out, at

    def aligned(self, w: tb.Words, at: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """File, template, beginning and share of weight of the candidates: rare words with LEAST of a template's weight
        agree, within SLACK, on its beginning. Raises each file's score to its largest share at any one beginning."""
        slot = np.searchsorted(self.words, w.hashes[at])
        slot[slot == len(self.words)] = 0
        hit = self.words[slot] == w.hashes[at] if len(self.words) else np.zeros(len(at), bool)
        at, slot = at[hit], slot[hit]
        if not len(at):
            return
        which = tb.ragged(self.first[slot], self.many[slot])
        where = np.repeat(at, self.many[slot])
        row = np.searchsorted(w.word_bounds, where, side="right") - 1
        template, begin, share = self.template[which], where - self.place[which], self.share[which]
        order = np.lexsort((begin, template, row))
        row, template, begin, share, place = row[order], template[order], begin[order], share[order], self.place[which][order]
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (template[1:] != template[:-1])))
        edges = np.append(np.flatnonzero(fresh), len(row))
        possible = np.add.reduceat(share, edges[:-1]) >= LEAST
        same = np.flatnonzero(np.concatenate(([True], fresh[1:] | (begin[1:] != begin[:-1]))))
        sums = np.add.reduceat(share, same)
        np.maximum.at(score, row[same], np.minimum(sums, 1.0))
        for k in np.flatnonzero(possible).tolist():
            low, high = int(edges[k]), int(edges[k + 1])
            r, t = int(row[low]), int(template[low])
            a, b = np.searchsorted(same, [low, high])
            for i in same[a:b].tolist():  # beginnings from this one to SLACK words later, each place once
                end = low + int(np.searchsorted(begin[low:high], begin[i] + SLACK, side="right"))
                agreed = dict(zip(place[i:end].tolist(), share[i:end].tolist(), strict=True))
                total = sum(agreed.values())
                if total >= LEAST:
                    yield r, t, int(begin[i]), min(1.0, total)

    def verified(self, template: int, begin: int, found: dict[str, np.ndarray]) -> bool:
        """Whether all key phrases of the template stand where it, or any word up to SLACK later, begins."""
        for phrase, place in self.needed[template]:
            starts = found[phrase]
            i = int(np.searchsorted(starts, begin + place - SLACK))
            if i == len(starts) or starts[i] > begin + place + 2 * SLACK:
                return False
        return True


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs."""
    prepare(docs.sparkSession)
    index = Index(BASE if base is None else base, TEMPLATES if templates is None else templates)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                w = tb.words(block, tb.ALNUM)
                found, at = index.places(w)
                n = len(block)
                count, first, last, score = np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros(n)
                base_of: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in index.base.items():
                    starts = found[phrase]
                    rows = np.searchsorted(w.word_bounds, starts, side="right") - 1
                    for r, s in zip(rows.tolist(), (starts - w.word_bounds[rows]).tolist(), strict=True):
                        count[r] += 1
                        base_of[r].add(label)
                        first[r] = s if first[r] is None else min(first[r], s)
                        last[r] = s if last[r] is None else max(last[r], s)
                labels_of = [set(x) for x in base_of]
                bounds = w.word_bounds.tolist()
                sorted_starts = {p: np.sort(x) for p, x in found.items()}
                for r, t, begin, share in index.aligned(w, at, score):
                    score[r] = max(score[r], share)
                    if index.templates[t][0] not in labels_of[r]:
                        own = {p: x[np.searchsorted(x, bounds[r]) : np.searchsorted(x, bounds[r + 1])] for p, x in ((p, sorted_starts[p]) for p, _ in index.needed[t])}
                        if index.verified(t, begin, own):
                            labels_of[r].add(index.templates[t][0])
                labels = [",".join(sorted(x)) for x in labels_of]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, n), pa.array(np.diff(w.word_bounds)), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base_of]), pa.array(labels), pa.array(score, pa.float64())],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
