"""License scan by an exact set-similarity join of text blocks with license templates.

A text's blocks are all its windows of BLOCK consecutive words (twice a template's words, if that is more), one at each
word; a shorter text is one block. A block meets a template if it holds at least ``threshold`` of the template's distinct
words. Words are ordered by their frequency over all documents, rarest first. By the prefix filter a meeting block holds
one of the template's first |T| - need + 1 words, so only what stands within a block's length of such a word is looked
at; by the length filter that must hold ``need`` of the template's words; by the positional filter the template's words
from the rarest one found on, and those found, must suffice. What passes is counted exactly at every word: an occurrence
of a template word adds one to the blocks that hold it and no earlier occurrence of it. Only words that occur in a
template take part, so a text costs one look-up a word.

Phrases (BASE) are found as consecutive words, apart from the join. Null and empty texts have no words, no labels
and score 0. Rows are judged each on its own, so repeated ids and extra columns make no difference.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.shared import as_bytes, steps, words

#: Phrases and the labels that they give.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Common license notices in short and whole, in words().
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "available under the terms of the cc by 4 0 license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted without prior written permission"),
    # whole texts and headers
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        " in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
        " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
        " you should have received a copy of the gnu general public license along with this program",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means",
    ),
]
THRESHOLD = 0.8
#: Words of a block, unless a template has more than half as many.
BLOCK = 64


def document_frequency(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many of all texts each word of a fixed vocabulary occurs; one row a word and task is shuffled."""
    known = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                seen.update(known.intersection(words(text)))
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(as_bytes(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # at most one row for each word of the templates


class TemplateIndex:
    """Templates as sets of word numbers, rarest word first, and the inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float, base: list[tuple[str, str]], block: int = BLOCK):
        sets = [(label, sorted(set(words(text.encode())))) for label, text in templates]
        everything = {w for _, s in sets for w in s} | {w for phrase, _ in base for w in words(phrase.encode())}
        order = sorted(everything, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: k for k, w in enumerate(order)}
        self.labels = [label for label, _ in sets]
        self.sets = [sorted(self.number[w] for w in s) for _, s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.block = [max(block, 2 * len(words(text.encode()))) for _, text in templates]
        self.prefix = [s[: len(s) - need + 1] for s, need in zip(self.sets, self.need)]
        self.postings: dict[int, list[int]] = {}
        for t, prefix in enumerate(self.prefix):
            for word in prefix:
                self.postings.setdefault(word, []).append(t)
        self.rare = np.zeros(len(order), bool)
        self.rare[list(self.postings)] = True
        self.phrases = [([self.number[w] for w in words(phrase.encode())], label) for phrase, label in base]

    def numbers(self, text: bytes) -> np.ndarray:
        found, number = words(text), self.number
        return np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(word, label) of each place where a phrase stands."""
        out = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
            for j, word in enumerate(phrase[1:], 1):
                at = at[ids[at + j] == word]
            out += [(p, label) for p in at.tolist()]
        return out

    def meet(self, ids: np.ndarray) -> tuple[list[tuple[int, int, int, float]], float]:
        """Runs of blocks that meet a template (first and last block's first word, template, highest containment), and the best containment of a candidate."""
        out, best = [], 0.0
        known = np.flatnonzero(ids >= 0)
        word = ids[known]
        rare = np.unique(word[self.rare[word]]).tolist()
        for t in sorted({t for w in rare for t in self.postings[w]}):
            own, need, size = self.sets[t], self.need[t], self.block[t]
            inside = np.isin(word, own)
            at, w = known[inside], word[inside]
            heads = at[np.isin(w, self.prefix[t])]
            left = np.searchsorted(heads, at)
            near = (at - heads[np.maximum(left - 1, 0)] < size) & (left > 0)
            near |= (heads[np.minimum(left, len(heads) - 1)] - at < size) & (left < len(heads))
            at, w = at[near], w[near]
            found = np.unique(w)
            if min(len(found), len(own) - own.index(int(found[0]))) < need:
                continue
            first, last, share = self.count(at, w, size, max(0, len(ids) - size))
            best = max(best, float(share.max()) / len(own))
            meets = share >= need
            edge = np.flatnonzero(np.diff(np.concatenate([[False], meets, [False]]).astype(np.int8)))
            out += [(int(first[a]), int(last[b - 1]), t, float(share[a:b].max()) / len(own)) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
        return out, best

    @staticmethod
    def count(at: np.ndarray, word: np.ndarray, size: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many distinct words the blocks hold: runs (first and last start, number), one after the other; starts go to ``last``."""
        order = np.lexsort((at, word))
        at, word = at[order], word[order]
        before = np.where(np.diff(word, prepend=-1) == 0, np.roll(at, 1), -1)
        lo, hi = np.maximum(np.maximum(at - size + 1, before + 1), 0), np.minimum(at, last)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        edge = np.concatenate([lo, hi + 1])
        order = np.argsort(edge, kind="stable")
        total = np.cumsum(np.repeat([1, -1], len(lo))[order])
        edge = edge[order]
        keep = np.append(edge[1:] != edge[:-1], True)
        edge, total = edge[keep], total[keep]
        return edge[:-1], edge[1:] - 1, total[:-1]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    base: list[tuple[str, str]] = BASE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """docs' rows with places (base phrases: word, label), blocks (runs of meeting blocks: first words of the first and the last, template, label, containment) and score."""
    vocabulary = sorted({w for _, text in templates for w in words(text.encode())})
    frequency = document_frequency(docs, vocabulary, text_col)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, frequency, threshold, base))
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("word", pa.int64()), ("last", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in steps(batches):
            n, places, blocks, scores = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = known.numbers(text)
                met, best = known.meet(ids)
                found = sorted(known.places(ids))
                n.append(len(ids))
                places.append([{"word": w, "label": x} for w, x in found])
                blocks.append([{"word": a, "last": b, "template": t, "label": known.labels[t], "share": c} for a, b, t, c in met])
                scores.append(1.0 if found else best)
            yield pa.record_batch(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(blocks, block), pa.array(scores, pa.float64())],
                names=["id", "n_words", "places", "blocks", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(
        run,
        "id long, n_words long, places array<struct<word:long,label:string>>,"
        " blocks array<struct<word:long,last:long,template:int,label:string,share:double>>, score double",
    )
