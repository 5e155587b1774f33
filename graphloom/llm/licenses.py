"""License scans by conditional compression.

A template may differ from a text by at most a share DIFFERING of its words. So a text that has it has also most of the
template's pairs of neighbouring words, close together: how many is known, and places that have fewer can be left out
without losing any. What is left are candidate blocks of words, across line ends. A block is compressed alone and with
each template as a raw zstandard dictionary; templates are ranked by the bytes that they save, and in that order
confirmed by exact wording: the stretch of the block that takes the fewest words changed, added or missing. Names and
versions of licenses (IDENTITY, _VERSION) must match: a template's own may not be missing, others may not be added.

Defined results: null and empty texts have no blocks; texts are scanned whole; a license is listed once for a
document, where it takes the fewest changes, then saves the most bytes, then comes first; findings are in order of
name; versions 2 and 2.0 are the same; repeated rows are scanned alike. Rows without doc_id pass. Empty tables give
empty results; other columns are not touched.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, raw_text, row_blocks

# Public short notices and headers of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-LGPL-3.0": "SPDX-License-Identifier: LGPL-3.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause-conditions": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Usual short wordings, listed under the license's name.
WORDINGS = (
    ("AGPL-3.0", "GNU AGPL v3"),
    ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache-2.0 OR MIT"),
    ("Apache-2.0", "MIT OR Apache-2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-2.0", "GNU GPL v2"),
    ("GPL-2.0", "GNU GPL version 2"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GNU GPL v3"),
    ("GPL-3.0", "GNU GPL version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("LGPL-3.0", "GNU LGPL v3"),
    ("MIT", "MIT License"),
    ("MIT", "Apache-2.0 OR MIT"),
    ("MIT", "MIT OR Apache-2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
)
#: Share of a template's words that may be changed, added or missing.
DIFFERING = 0.2
#: Words that tell licenses apart, besides versions.
IDENTITY = frozenset("apache bsd cc by nc nd sa cc0 gnu gpl lgpl agpl isc mpl lesser library affero mit mozilla noncommercial noderivatives sharealike".split())
_WORD = re.compile(r"[^\W_]++(?:\.++[^\W_]++)*+")
_VERSION = re.compile(r"v?\d{1,2}(?:\.\d+)*")
#: Separators of the words that candidates are sought by: every byte that is no ASCII letter or digit.
_PIECES = np.array([not (b < 128 and chr(b).isalnum()) for b in range(256)])


def _plain(word: str) -> str:
    return word.removesuffix(".0") if word[-2:] == ".0" and _VERSION.fullmatch(word) else word


def words(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text.lower())]


def strict(word: str) -> bool:
    """Whether the word must match."""
    return word in IDENTITY or _VERSION.fullmatch(word) is not None


@functools.lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, list[str], zstandard.ZstdCompressor]]]:
    """Without a dictionary, and with each template as one."""
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
    out = []
    for name, text in [*TEMPLATES.items(), *WORDINGS]:
        own = words(text)
        # a raw dictionary has 8 bytes at least
        held = zstandard.ZstdCompressionDict(" ".join(own).encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, own, zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return plain, out


def _pieces(texts: list[str]) -> Words:
    return Words(*raw_text(pa.array(texts, pa.string())), _PIECES, lower=True)


@functools.lru_cache(maxsize=1)
def _pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all templates' pairs of pieces; which template has which; how many pairs a text must share with
    a template to have it; how far apart in words the first and the last of them can be, whatever pieces added words have.

    A word changed, added or missing undoes the pairs that touch its pieces; so does the end of a version, which may
    be written or not.
    """
    sets, need, reach = [], [], []
    for _, own, _ in _compressors()[1]:
        w = _pieces([" ".join(own)])
        pairs = np.unique(w.grams(2)[: len(w.hashes) - 1])
        sizes = sorted((len(_pieces([x]).hashes) for x in own), reverse=True)
        edits = int(DIFFERING * len(own))
        undone = sum(n + 1 for n in sizes[:edits]) + sum(_VERSION.fullmatch(x) is not None for x in own)
        sets.append(pairs)
        need.append(max(1, len(pairs) - undone))
        reach.append(len(own) + edits)
    every = np.unique(np.concatenate(sets))
    has = np.zeros((len(sets), len(every)), bool)
    for i, pairs in enumerate(sets):
        has[i, np.searchsorted(every, pairs)] = True
    return every, has, np.array(need), np.array(reach)


def wording(template: list[str], block: list[str]) -> tuple[int, int]:
    """Words of the template that the block lacks, and words that it adds between those it has."""
    found = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return len(template), 0
    same = sum(m.size for m in found)
    return len(template) - same, found[-1].b + found[-1].size - found[0].b - same


def nearest(template: list[str], block: list[str]) -> tuple[int, int, int, int] | None:
    """(words changed, words lacking, words added, first word) of the block's stretch nearest to the template; None beyond the share allowed."""
    limit = int(DIFFERING * len(template))
    held = set(block)
    fixed = [strict(w) for w in template]
    if len(set(template) - held) > limit or any(f and w not in held for w, f in zip(template, fixed)):
        return None
    # only the surroundings of the rarest word that must match
    must = [w for w, f in zip(template, fixed) if f]
    rarest = min(must, key=block.count) if must else None
    reach = len(template) + limit
    spans: list[list[int]] = []
    for at in (i for i, w in enumerate(block) if w == rarest) if must else range(0, len(block), reach):
        if spans and at - reach <= spans[-1][1]:
            spans[-1][1] = at + reach
        else:
            spans.append([max(0, at - reach), at + reach])
    beyond = (limit + 1, 0, 0, 0)
    best = beyond
    for first, end in spans:
        # column[i]: the first i words of the template against a stretch that ends here
        column = [(0, 0, 0, first)]
        for w, f in zip(template, fixed):
            e, lacking, added, start = column[-1]
            column.append(beyond if f or e >= limit else (e + 1, lacking + 1, added, start))
        for j, word in enumerate(block[first:end], first):
            free = not strict(word)
            new = [(0, 0, 0, j + 1)]
            for i, (w, f) in enumerate(zip(template, fixed)):
                if w == word:
                    got = column[i]
                else:
                    got = beyond
                    e, lacking, added, start = column[i]
                    if free and not f and e < limit:
                        got = (e + 1, lacking + 1, added + 1, start)
                    e, lacking, added, start = column[i + 1]
                    if free and e < limit:
                        got = min(got, (e + 1, lacking, added + 1, start))
                    e, lacking, added, start = new[i]
                    if not f and e < limit:
                        got = min(got, (e + 1, lacking + 1, added, start))
                new.append(got)
            column = new
            best = min(best, column[-1])
    return best if best[0] <= limit else None


def _candidates(hits: np.ndarray, at: np.ndarray) -> list[int]:
    """Templates enough of whose pairs ``at`` are among ``hits`` within their reach. ``hits`` are numbers of words."""
    _, has, need, reach = _pairs()
    out = []
    for i in np.flatnonzero(has[:, np.unique(at)].sum(1) >= need).tolist():
        own = has[i, at]
        places, pairs = hits[own], at[own]
        if places[-1] - places[0] <= reach[i]:
            out.append(i)
            continue
        # a window of the template's reach from each place on
        ends = np.searchsorted(places, places + reach[i], "right")
        if any(len(np.unique(pairs[a:b])) >= need[i] for a, b in enumerate(ends.tolist()) if b - a >= need[i]):
            out.append(i)
    return out


def candidate_blocks(text: str) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """(character offsets, words, possible templates) of the blocks of a text."""
    every, has, need, reach = _pairs()
    pieces = _pieces([text])
    grams = pieces.grams(2)[: max(0, len(pieces.hashes) - 1)]
    place = np.minimum(np.searchsorted(every, grams), len(every) - 1)
    hits = np.flatnonzero(every[place] == grams)
    if not len(hits):
        return
    if not (has[:, np.unique(place[hits])].sum(1) >= need).any():
        return
    found = list(_WORD.finditer(text))
    # where the words of the text begin, in bytes
    characters = [m.start() for m in found]
    widths = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.array([len(c.encode()) for c in text], np.int64) if not text.isascii() else np.ones(len(text), np.int64), out=widths[1:])
    at = np.searchsorted(widths[characters], pieces.starts[hits], "right") - 1  # the word of a pair's first piece
    most = int(reach.max())
    for part in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(at) > most) + 1):
        if possible := _candidates(at[part], place[hits[part]]):
            far = max(int(reach[i]) for i in possible) + 1
            first, end = max(0, int(at[part[0]]) - far), int(at[part[-1]]) + 2 + far
            yield characters[first:end], [_plain(m.group().lower()) for m in found[first:end]], possible


def ranked(block: list[str], possible: list[int]) -> list[tuple[int, str, list[str]]]:
    """(bytes saved, name, words) of the templates, those that save the most first."""
    plain, templates = _compressors()
    raw = " ".join(block).encode()
    alone = len(plain.compress(raw))
    return sorted(((alone - len(templates[i][2].compress(raw)), *templates[i][:2]) for i in possible), key=lambda x: (-x[0], x[1]))


def scan(text: str) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """Number of blocks, and (license, offset, bytes saved, words lacking, words added) of those confirmed."""
    found: dict[str, tuple[tuple[int, int, int], tuple[str, int, int, int, int]]] = {}
    n = 0
    for starts, block, possible in candidate_blocks(text):
        n += 1
        for gain, name, own in ranked(block, possible):
            if near := nearest(own, block):
                edits, lacking, added, first = near
                this = (edits, -gain, starts[first]), (name, starts[first], gain, lacking, added)
                found[name] = min(found.get(name, this), this)
    return n, sorted(f for _, f in found.values())


def _possible(column: pa.Array) -> np.ndarray:
    """Rows that have enough pairs of some template, wherever; the others have no candidate block."""
    every, has, need, _ = _pairs()
    data, offsets = raw_text(column)
    out = np.zeros(len(column), bool)
    for a, b in row_blocks(offsets):
        pieces = Words(data, offsets[a : b + 1], _PIECES, lower=True)
        grams = pieces.grams(2)
        place = np.minimum(np.searchsorted(every, grams), len(every) - 1)
        hit = every[place] == grams
        hits = np.flatnonzero(hit)
        row = np.searchsorted(pieces.rows, hits, "right") - 1
        rows, first = np.unique(row, return_index=True)
        for i, own in zip(rows.tolist(), np.split(place[hits], first[1:])):
            out[a + i] = bool((has[:, np.unique(own)].sum(1) >= need).any())
    return out


def license_findings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_blocks, licenses, and findings with offset, bytes saved and wording differences."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("license", pa.string()), *((k, pa.int64()) for k in ("at", "bytes_saved", "lacking", "added"))])
        for batch in batches:
            some = _possible(batch.column(1)).tolist()
            got = [scan(text.as_py()) if here else (0, []) for here, text in zip(some, batch.column(1))]
            findings = [[dict(zip(("license", "at", "bytes_saved", "lacking", "added"), f)) for f in found] for _, found in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(findings, pa.list_(item))], ["doc_id", "n_blocks", "findings"])

    out = docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_blocks long, findings array<struct<license string, at long, bytes_saved long, lacking long, added long>>")
    return out.select("doc_id", "n_blocks", F.col("findings.license").alias("licenses"), "findings")
