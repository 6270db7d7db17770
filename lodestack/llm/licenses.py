"""Licence scan over a positional index of rare licence words.

Template words are indexed by position. Document frequencies over the whole
corpus choose each template's anchors: the highest-IDF words of each of its
mandatory phrases. A file looks its anchor words up, rarest first; each of their
places names an offset of the template, and only offsets that all anchors of a
template name stay. There the mandatory phrases are verified word by word, and
the score is the matched share of the template's IDF.
"""

from __future__ import annotations

from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

# Phrases and labels of the base.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Label, words of a licence notice, phrases that must stand in it.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted free of charge to any person", "associated documentation files"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ["permission is hereby granted free of charge to any person or organization"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["you may not use this file except in compliance with the license", "apache org licenses license 2 0"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["nor the names of its contributors may be used to endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages arising from the use of this software"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "licensed under cc0 1 0", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
]

#: Lower case A-Z; all ASCII but digits and letters separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n, first = len(phrase), phrase[0]
    out, i = [], -1
    try:
        while True:
            i = words.index(first, i + 1)
            if words[i : i + n] == phrase:
                out.append(i)
    except ValueError:
        return out


def _templates(templates) -> list[tuple[str, list[bytes], list[tuple[int, list[bytes]]]]]:
    out = []
    for label, text, phrases in templates:
        words = text.encode().split()
        parts = [p.encode().split() for p in phrases]
        out.append((label, words, [(places(words, p)[0], p) for p in parts]))
    return out


def frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Rows, and how many of them have each template word. Bounded by the templates' words."""
    vocabulary = frozenset(w for _, words, _ in _templates(templates) for w in words)

    def run(batches):
        n, df = 0, Counter()
        for b in small_batches(batches):
            data, at = text_bytes(b.column(0))
            data = data.tobytes()
            n += b.num_rows
            for i, j in zip(at[:-1], at[1:]):
                df.update(vocabulary.intersection(words_of(data[i:j])))
        yield pa.RecordBatch.from_arrays([pa.array([None, *(w.decode() for w in df)], pa.string()), pa.array([n, *df.values()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return sum(r["n"] for r in rows if r["word"] is None), {r["word"].encode(): r["n"] for r in rows if r["word"] is not None}


def index(n: int, df: dict[bytes, int], templates=TEMPLATES, anchors: int = 2):
    """Each template's anchors (word, place), rarest first; weights of all template words; and the templates.

    anchors: how many different words of each phrase, those of the highest IDF.
    """
    parsed = _templates(templates)
    idf = {w: log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for _, words, _ in parsed for w in words}
    rank = lambda w: (-idf[w], w)
    made = []
    for _, _, phrases in parsed:
        chosen = {(w, at + p.index(w)) for at, p in phrases for w in sorted(set(p), key=rank)[:anchors]}
        made.append(sorted(chosen, key=lambda x: (rank(x[0]), x[1])))
    return made, idf, parsed


def match(words: list[bytes], made) -> dict[str, tuple[float, int]]:
    """Best score and its offset of each label that is found."""
    anchors, idf, templates = made
    found: dict[str, tuple[float, int]] = {}
    there = idf.keys() & set(words)
    postings: dict[bytes, list[int]] = {}
    for (label, template, phrases), own in zip(templates, anchors):
        if not all(w in there for w, _ in own):
            continue
        starts = None
        for w, at in own:
            if w not in postings:
                postings[w] = [i for i, x in enumerate(words) if x == w]
            here = {i - at for i in postings[w]}
            starts = here if starts is None else starts & here
            if not starts:
                break
        for start in starts or ():
            if all(start + at >= 0 and words[start + at : start + at + len(p)] == p for at, p in phrases):
                same = sum(idf[w] for k, w in enumerate(template) if 0 <= start + k < len(words) and words[start + k] == w)
                score = min(1.0, same / sum(idf[w] for w in template))
                if label not in found or (score, -start) > (found[label][0], -found[label][1]):
                    found[label] = (score, start)
    return found


def scan(docs: DataFrame, *, base: dict[str, str] = BASE, templates=TEMPLATES, anchors: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches for every row.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, after lower-casing A-Z. n_base counts all places where the words of a
    base phrase stand consecutively; first_word and last_word are the smallest
    and largest start among them, null if there is none. labels joins base labels
    and those of templates; score is the best template's matched share of IDF (0
    to 1; 0 without a template). matches lists label, score and start word of
    each label of the method. Null text counts as empty; repeated rows each get
    their row; extra columns are ignored; an empty table gives no rows.
    """
    made = index(*frequencies(docs, templates), templates, anchors)
    phrases = [(p.encode().split(), label) for p, label in base.items()]

    def run(batches):
        for b in small_batches(batches):
            data, at = text_bytes(b.column(0))
            data = data.tobytes()
            cols: list[list] = [[] for _ in range(8)]
            for i, j in zip(at[:-1], at[1:]):
                words = words_of(data[i:j])
                starts, own = [], set()
                for phrase, label in phrases:
                    if got := places(words, phrase):
                        starts += got
                        own.add(label)
                more = match(words, made)
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(more))), max((s for s, _ in more.values()), default=0.0), [{"label": k, "score": s, "word": w} for k, (s, w) in sorted(more.items())])
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("word", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, score: double, word: long>>")
