"""License scans by conditional compression (operator 6)."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wayfare.llm.common import small_batches

#: Template wordings (fixed values): the short notices and the operative texts of public licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": ("All rights reserved.",),
}
#: What a place must say, word for word, to be the license of its template: the names of short notices and of the
#: operative texts that hold one (fixed values).  A place that lacks it is an unknown variant.
NAMES: dict[str, tuple[tuple[str, ...], ...]] = {
    "Apache-2.0": (("apache license version 2.0",), ("apache license version 2.0",)),
    "MIT": (("mit license",), ()),
    "GPL-3.0": (("gnu general public license version 3",), ("gnu general public license", "version 3 of the license")),
    "BSD-3-Clause": (("bsd 3-clause license",), ()),
    "ISC": (("isc license",), ()),
    "CC-BY-4.0": (("cc by 4.0",), ("creative commons attribution 4.0",)),
    "CC-BY-NC-4.0": (("cc by-nc 4.0",), ("creative commons attribution-noncommercial 4.0",)),
    "proprietary": (("all rights reserved",),),
}
UNKNOWN = "unknown variant"
TRIGGER = re.compile(r"licen[cs]e|all rights reserved|permission (?:is hereby granted|to use)|redistribut|creative commons", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Code points of context around a trigger in a block; least share of a template's words.
REACH = 1200
SHARE = 0.8
#: Savings at places that differ by less than this share are alike.
NEAR = 0.1
#: Widths of a template in a range of words that is searched at once.
TILE = 8
FOUND = "doc_id long, start int, end int, license string, nearest string, template int, plain_bytes int, given_bytes int, reduction double, words int, missing int, added int, exact boolean"


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, int, list[str], zstandard.ZstdCompressor]]]:
    def packer(**given) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, write_checksum=False, **given)

    out = []
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, i, [w.lower() for w in WORD.findall(text)], packer(dict_data=raw)))
    return packer(), out


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks: what lies around triggers, ``REACH`` code points to either side at most; overlaps merge."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def named(name: str, number: int, words: list[str]) -> bool:
    """Whether ``words`` say what the license ``name`` must say."""
    said = " " + " ".join(words) + " "
    return all(f" {x} " in said for x in NAMES[name][number])


def _dense(template: list[str], words: list[str], width: int) -> list[tuple[int, int]]:
    """Ranges of ``words`` out of which no place of ``template``, of ``width`` words at most, can lie.

    Long ranges are cut into some of ``TILE`` widths that overlap by one, so that every place lies whole in one.
    """
    held, least = set(template), SHARE * len(template)
    upto = [0, *accumulate(w in held for w in words)]
    out: list[list[int]] = []
    for start in range(max(1, len(words) - width + 1)):
        stop = min(len(words), start + width)
        if upto[stop] - upto[start] >= least:
            if out and start <= out[-1][1]:
                out[-1][1] = stop
            else:
                out.append([start, stop])
    step = (TILE - 1) * width
    return [(at, min(b, at + TILE * width)) for a, b in out for at in range(a, max(a + 1, b - width), step)]


def _local(template: list[str], words: list[str], lo: int, hi: int, most: float) -> tuple[int, int, int, int] | None:
    """The place within a range whose words agree best with ``template``; scattered words at its ends are left out."""
    blocks = difflib.SequenceMatcher(None, template, words[lo:hi], autojunk=False).get_matching_blocks()[:-1]
    best, found = None, None
    for i, head in enumerate(blocks):
        kept = 0
        for tail in blocks[i:]:
            kept += tail.size
            first, last = lo + head.b, lo + tail.b + tail.size
            added = last - first - kept
            if kept >= SHARE * len(template) and added <= most and (best is None or kept - added > best):
                best, found = kept - added, (first, last, len(template) - kept, added)
    return found


def wording(template: list[str], words: list[str]) -> list[tuple[int, int, int, int]]:
    """Where ``template`` is worded in ``words``: (first, last, missing, added) of each place, those of a range disjoint.

    Missing counts template words that the place lacks, added those that it has besides.  A place is sought
    around the longest run of each range: where the run puts the template first, then within its length to both sides.
    """
    if sum((Counter(template) & Counter(words)).values()) < SHARE * len(template):
        return []
    most = (1 - SHARE) * len(template) + 1
    size, slack = len(template), int(most)
    out, ranges = [], _dense(template, words, len(template) + slack)
    while ranges:
        lo, hi = ranges.pop()
        if hi - lo < SHARE * size:
            continue
        run = difflib.SequenceMatcher(None, template, words[lo:hi], autojunk=False).find_longest_match()
        if not run.size:
            continue
        at = lo + run.b
        near = max(lo, at - run.a - slack), min(hi, at - run.a + size + slack)
        far = max(lo, at - size - slack), min(hi, at + run.size + size + slack)
        place = _local(template, words, *near, most) or _local(template, words, *far, most)
        if place:
            out.append(place)
        first, last = place[:2] if place else (at, at + run.size)
        ranges += [(lo, first), (last, hi)]
    # what lies in two tiles is found in both
    return sorted(set(out))


def licenses_in(text: str) -> list[tuple]:
    """(start, end, license, nearest, template, plain, given, reduction, words, missing, added, exact) of each license found."""
    plain, templates = _compressors()
    out = []
    for a, b in blocks(text):
        block = text[a:b]
        found = list(WORD.finditer(block))
        words = [m[0].lower() for m in found]
        places = [(i, *place) for i, t in enumerate(templates) for place in wording(t[2], words)]
        if not places:
            continue
        sizes = []
        for i, first, last, *_ in places:
            data = block[found[first].start() : found[last - 1].end()].encode("utf-8", "surrogatepass")
            sizes.append((len(plain.compress(data)), len(templates[i][3].compress(data))))
        taken: list[tuple[int, int]] = []
        for at in ranked(places, [x - y for x, y in sizes], [len(t[2]) for t in templates]):
            i, first, last, missing, added = places[at]
            if any(first < y and x < last for x, y in taken):
                continue
            taken.append((first, last))
            name, number, template, _ = templates[i]
            start, end = a + found[first].start(), a + found[last - 1].end()
            known = name if named(name, number, words[first:last]) else UNKNOWN
            size, given = sizes[at]
            out.append((start, end, known, name, number, size, given, (size - given) / size, len(template), missing, added, missing + added == 0))
    return sorted(out)


def ranked(places: list[tuple], gains: list[int], sizes: list[int]) -> list[int]:
    """Which of ``places`` come first: those at which the template saves most bytes.

    Savings within NEAR of the most that is left are alike to the compressor, which sees no order of words; of such
    places that with most words in common, less those added, is the first.
    """
    left, out = sorted(range(len(places)), key=lambda x: -gains[x]), []
    while left:
        bar = gains[left[0]] - NEAR * abs(gains[left[0]])
        group = [x for x in left if gains[x] >= bar]
        out += sorted(group, key=lambda x: (2 * places[x][3] + places[x][4] - sizes[places[x][0]], -gains[x], places[x]))
        left = left[len(group) :]
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in FOUND.split(", ")]
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if text and TRIGGER.search(text):
                out += [(doc, *x) for x in licenses_in(text)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses in each whole text: a row for each place.

    Places where a template may be worded are candidates.  Each is compressed alone and with its template as a raw Zstandard
    dictionary, and the bytes that this saves rank the candidates; they are confirmed by a word-for-word comparison: at least
    ``SHARE`` of the template's words in order, with the counts of words missing and added.  Of candidates that overlap
    that which saves more stands, or, where savings are alike, that with most words in common; those apart stand beside it, so no
    license is lost.  ``license`` is the template's if the place says what that license must say (``NAMES``), and else ``UNKNOWN``,
    with the nearest one beside it.  A map without a shuffle.  Null and empty texts hold none; rows that repeat are each scanned;
    ids may be null.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_scanned, FOUND)
