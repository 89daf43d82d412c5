"""License scan: grams of templates, then alignment by longest common subsequence.

Texts are seen as words of ASCII letters and digits in lower case. All grams of all
templates, of two words for templates of up to ten and of three for longer ones, are an
inverted index of bounded size. A document's grams are looked up in it. Where enough of
a template's grams lie close together, template and document are aligned without a band.
Words that aren't matched break a share of the grams that their number bounds; a quarter
of what is then left, or one, is enough for an alignment. A match has its coverage (template
words matched) and its span of bytes: of as many matched words, the first end and the
shortest span. Matches of one template don't overlap.

A null text has no matches. Rows are scanned one by one, and give a row for each match.
An empty table gives no rows. Other columns are left out. ``templates`` is a parameter;
without it, the notices below and the whole texts in ``license_texts`` (``-text``) are meant.
"""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbframe.llm import text as T

TEXTS = Path(__file__).parent / "license_texts"
#: Notices by which public licenses are named or granted.
TEMPLATES = {
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA": "Creative Commons Attribution-ShareAlike",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words of a gram, of one of a template of up to SHORT words, and words by which a place may be longer than its template, besides a quarter of it.
GRAM, SHORT_GRAM, SHORT, SLACK = 3, 2, 10, 16
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = _SEEN[65:91] = np.arange(97, 123)
_SEEN[48:58] = np.arange(48, 58)
_SEEN[128:] = np.arange(128, 256)


def seen(data, at):
    """Hashes of words, their first and last byte, and the rows' first words."""
    data = _SEEN[data]
    starts, ends, first = T.words(data, at)
    return T.word_hashes(data, starts, ends), starts, ends, first


def all_templates() -> dict[str, str]:
    return TEMPLATES | {f"{f.stem}-text": f.read_text() for f in sorted(TEXTS.glob("*.txt"))}


def gram_of(n: int) -> int:
    """Words of a gram of a template of ``n`` words."""
    return min(n, GRAM if n > SHORT else SHORT_GRAM)


def index(templates: dict[str, str]) -> dict:
    """Grams of all templates by size: sorted, with their template."""
    names, words = sorted(templates), []
    for name in names:
        data = np.frombuffer(templates[name].encode(), np.uint8)
        words.append(seen(data, np.array([0, len(data)]))[0])
    grams = {}
    for k in sorted({gram_of(len(w)) for w in words if len(w)}):
        rows = sorted({(int(h), t) for t, w in enumerate(words) if len(w) and gram_of(len(w)) == k for h in T.gram_hashes(w, k)})
        grams[k] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    return {"names": names, "words": words, "grams": grams}


def common(template: list, doc: list):
    """Length of the longest common subsequence, and the first place in ``doc`` by which it is reached."""
    where: dict = {}
    for i, word in enumerate(template):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    row, n, last = full, 0, -1
    for j, word in enumerate(doc):
        same = row & where.get(word, 0)
        if same:
            row = ((row + same) | (row - same)) & full
            now = len(template) - row.bit_count()
            if now > n:
                n, last = now, j
    return n, last


def align(template: list, doc: list):
    """Most words of ``template`` matched in order in ``doc``, and the first and last place in ``doc``.

    Of alignments with as many matches, one with the first end, and of these the shortest.
    """
    n, last = common(template, doc)
    if not n:
        return 0, -1, -1
    return n, last - common(template[::-1], doc[last::-1])[1], last


def needed(n: int, percent: int) -> int:
    """Hits near one another that a match of a template of ``n`` words has at least."""
    k = gram_of(n)
    lost = n - -(-percent * n // 100)
    return max(1, (n - k + 1 - k * lost) // 4)


def matches(data, at, ix: dict, percent: int):
    """``row, template, matched, from_byte, to_byte`` of each place with enough coverage."""
    words, starts, ends, first = seen(data, at)
    found, hits = [], []
    for k, (hashes, owner) in ix["grams"].items():
        grams = T.gram_hashes(words, k)
        lo = np.searchsorted(hashes, grams)
        i = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == grams)
        i = i[np.searchsorted(first, i, "right") == np.searchsorted(first, i + k - 1, "right")]
        lo = lo[i]
        n = np.searchsorted(hashes, grams[i], "right") - lo
        hits.append((owner[np.repeat(lo - np.cumsum(np.r_[0, n[:-1]]), n) + np.arange(n.sum())] if len(n) else lo, np.repeat(i, n)))
    if not hits or not len(words):
        return found
    template, place = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((place, template))
    template, place = template[order], place[order]
    size = np.array([len(w) for w in ix["words"]])
    long = size + size // 4 + SLACK
    least = np.array([needed(n, percent) if n else 1 for n in size.tolist()])
    # hits of the same template and row within a place's length
    row = np.searchsorted(first, place, "right") - 1
    base = template * (len(words) + 1)
    upto = np.minimum(place + long[template], first[row + 1])
    near = np.searchsorted(base + place, base + upto) - np.arange(len(place))
    done = [-1] * len(size)
    for x in np.flatnonzero(near >= least[template]).tolist():
        t, i, r = int(template[x]), int(place[x]), int(row[x])
        if i < done[t]:
            continue
        known, stride = ix["words"][t].tolist(), max(1, size[t] // 8)
        lo, hi = max(int(first[r]), int(i - size[t] // 5 - SLACK // 2), done[t]), min(int(first[r + 1]), int(upto[x]) + stride)
        some, stop = [], hi
        while stop - lo > 0:
            n, a, b = align(known, words[lo:stop].tolist())
            if not n or 100 * n < percent * len(known):
                break
            some.append((r, t, n, int(starts[lo + a] - at[r]), int(ends[lo + b] - at[r])))
            done[t] = max(done[t], lo + b + 1)
            stop = lo + a  # another one may end before it
        found += some[::-1]
        if not some:
            done[t] = max(done[t], i + stride)
    return sorted(found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """``doc_id, license, matched, words, from_byte, to_byte``: matches that cover ``percent`` of a template's words."""
    ix = docs.sparkSession.sparkContext.broadcast(index(all_templates() if templates is None else templates))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, _, data, at in T.chunks(batch.column(1)):
                rows = matches(data, at, ix.value, percent)
                names, words = ix.value["names"], ix.value["words"]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([first + r[0] for r in rows], pa.int64())), pa.array([names[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([len(words[r[1]]) for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                    ],
                    ["doc_id", "license", "matched", "words", "from_byte", "to_byte"],
                )

    docs = T.plain(docs)
    return docs.mapInArrow(run, "doc_id long, license string, matched int, words int, from_byte long, to_byte long")
