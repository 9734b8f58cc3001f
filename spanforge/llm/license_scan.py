"""License scans by conditional compression.

Candidate blocks are the words around each license sign, as many on either side as
the longest notice may have, line breaks or not; blocks that touch are one.  In a
block a template is confirmed by exact wording on one contiguous stretch: all of
its fixed words (names and version numbers) stand there in the template's order,
nothing between two that are neighbours, and at most ``tolerance`` of its number of words are missing, changed or inserted.
Each stretch is compressed with zstandard on its own and with the template as a
raw-content dictionary, under equal fixed parameters.  Where stretches overlap, the
one whose dictionary takes most off its size is the notice; a saving only ranks and
never rules out a wording.  A block gives all its notices.  SPDX tags are read as
expressions; they save nothing and differ in nothing.

Every word of every text near a sign is looked at.

Defined results: null and empty texts have no license; a null doc_id is kept;
repeated rows get equal results; an empty table gives an empty result; other
columns are ignored.  Of templates that tie, the one with most words matched wins,
then the one with fewest differences, then the first by name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Short license notices by identifier, in their usual wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Words that say which license a notice names.
FIXED = {
    "Apache-2.0": ("apache", "2.0"),
    "BSD-2-Clause": ("bsd", "2-clause"),
    "BSD-3-Clause": ("bsd", "3-clause"),
    "CC-BY-4.0": ("cc", "by", "4.0"),
    "CC-BY-NC-4.0": ("cc", "by-nc", "4.0"),
    "CC-BY-SA-4.0": ("cc", "by-sa", "4.0"),
    "CC0-1.0": ("cc0", "1.0"),
    "GPL-2.0": ("gnu", "general", "public", "2"),
    "GPL-3.0": ("gnu", "general", "public", "3"),
    "LGPL-3.0": ("gnu", "lesser", "general", "public", "3"),
    "MIT": ("mit",),
    "MPL-2.0": ("mozilla", "public", "2.0"),
}
_MAY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License version {} as published by the Free Software Foundation."
# Grants, standard headers and titles of full texts, each with its
# fixed words; a title has no others and counts only as the head of a line.
FURTHER = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ("apache", "2.0")),
    ("BSD-2-Clause", _MAY, ("redistribution", "source", "binary", "permitted", "redistributions", "retain", "reproduce")),
    ("BSD-3-Clause", _MAY + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("redistribution", "source", "binary", "permitted", "redistributions", "retain", "reproduce", "endorse", "promote")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0")),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "attribution-noncommercial", "4.0")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution-sharealike", "4.0")),
    ("GPL-2.0", _GNU.format("", 2), ("gnu", "general", "public", "2")),
    ("GPL-2.0", _GNU_ONLY.format("", 2), ("gnu", "general", "public", "2")),
    ("GPL-3.0", _GNU.format("", 3), ("gnu", "general", "public", "3")),
    ("GPL-3.0", _GNU_ONLY.format("", 3), ("gnu", "general", "public", "3")),
    ("LGPL-3.0", _GNU.format("Lesser ", 3), ("gnu", "lesser", "general", "public", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission", "granted", "charge", "sublicense", "furnished")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla", "public", "2.0")),
] + [
    (name, title, tuple(title.lower().split()))
    for name, title in [
        ("Apache-2.0", "Apache License Version 2.0"),
        ("BSD-2-Clause", "BSD 2-Clause License"),
        ("BSD-3-Clause", "BSD 3-Clause License"),
        ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
        ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
        ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
        ("CC0-1.0", "CC0 1.0 Universal"),
        ("GPL-2.0", "GNU General Public License version 2"),
        ("GPL-3.0", "GNU General Public License version 3"),
        ("LGPL-3.0", "GNU Lesser General Public License version 3"),
        ("MIT", "MIT License"),
        ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ]
]
_SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\n]*)")
_SPDX_ID = re.compile(r"[\w.+-]+")
_SIGN = re.compile(r"(?i)licen[cs]e|permission\s+is\s+hereby\s+granted|creative\s+commons|copyright|spdx|all\s+rights\s+reserved|public\s+domain|redistribution|\bcc0\b|\bcc\s+by\b")
_SIGN_BYTES = re.compile(_SIGN.pattern.encode())
_WORDS = re.compile(r"\w+(?:[.-]\w+)*")


def blocks(text: str, reach: int) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (word, start, end) at most ``reach`` words from a license sign."""
    words = [(m[0], m.start(), m.end()) for m in _WORDS.finditer(text)]
    ends, begin, end = [w[2] for w in words], 0, -1
    for found in _SIGN.finditer(text):
        at = bisect_right(ends, found.start())
        if end >= 0 and at - reach > end:
            yield words[begin:end]
            begin = at - reach
        elif end < 0:
            begin = max(at - reach, 0)
        end = min(at + reach + 1, len(words))
    if end >= 0:
        yield words[begin:end]


def _extended(want: list[str], have: list[str], held: list[bool], most: int) -> tuple[int, int] | None:
    """(edits, length) of the prefix of ``have`` closest to all of ``want``, shortest
    first; None if it takes more than ``most`` edits, one of a held word or a word
    between two held neighbours; a neighbour before ``want`` counts as held."""
    if have[: len(want)] == want:
        return 0, len(want)
    far = most + 1
    width = min(len(have), len(want) + most)
    row = [0, *(far if held[0] else min(j, far) for j in range(1, width + 1))]
    for i, word in enumerate(want, 1):
        low, high = max(i - most, 0), min(i + most, width)
        new = [far] * (width + 1)
        for j in range(low, high + 1):
            best = far if held[i - 1] else row[j] + 1
            if j:
                if have[j - 1] == word:
                    best = min(best, row[j - 1])
                elif not held[i - 1]:
                    best = min(best, row[j - 1] + 1)
                if not all(held[i - 1 : i + 1]):  # names stand whole
                    best = min(best, new[j - 1] + 1)
            new[j] = best
        row = new
        if min(row[low : high + 1], default=far) > most:
            return None
    edits = min(row)
    return (edits, row.index(edits)) if edits <= most else None


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, fixed: dict[str, tuple[str, ...]] = FIXED, tolerance: float = 0.25, further: list[tuple[str, str, tuple[str, ...]]] = FURTHER):
        wording = sorted([*((n, templates[n], fixed.get(n, ())) for n in templates), *further])
        self.names, self.tolerance = [n for n, _, _ in wording], tolerance
        # equal parameters with and without a dictionary, or sizes cannot be compared
        equal = zstandard.ZstdCompressionParameters.from_level(19, source_size=1 << 14, dict_size=1 << 14, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=equal)
        self.with_template = [zstandard.ZstdCompressor(compression_params=equal, dict_data=zstandard.ZstdCompressionDict(x.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, x, _ in wording]
        self.words = [_WORDS.findall(x.lower()) for _, x, _ in wording]
        self.held = [[w in sure for w in words] for (_, _, sure), words in zip(wording, self.words, strict=True)]
        self.reach = max(len(w) + int(tolerance * len(w)) for w in self.words)
        self.tags = {n.lower(): n for n in self.names}

    def tagged(self, text: str) -> list[tuple[str, int, int]]:
        """A notice for each known license of each SPDX tag's expression."""
        found = []
        for tag in _SPDX.finditer(text):
            for m in _SPDX_ID.finditer(tag[1]):
                name = self.tags.get(re.sub(r"(-only|-or-later|\+)$", "", m[0].lower()))
                if name is None:
                    if m[0] in ("OR", "AND"):
                        continue
                    break  # prose after the expression, or a license without a template
                found.append((name, 0, 0))
        return found

    def stretches(self, words: list[str], places: dict[str, list[int]], template: int) -> Iterator[tuple[int, int, int]]:
        """(first word, end, differing words) of each stretch with the template's wording."""
        want, held = self.words[template], self.held[template]
        most = int(self.tolerance * len(want))
        firm = [k for k, h in enumerate(held) if h]
        if any(want[k] not in places for k in firm):
            return
        # a stretch holds every fixed word, or else one of any most + 1 words
        roots = [min(firm, key=lambda k: len(places[want[k]]))] if firm else range(min(most + 1, len(want)))
        for k in roots:
            for at in places.get(want[k], ()):
                before = _extended(want[:k][::-1], words[max(at - k - most, 0) : at][::-1], held[:k][::-1], most)
                if before is None:
                    continue
                after = _extended(want[k + 1 :], words[at + 1 : at + len(want) - k + most], held[k + 1 :], most - before[0])
                if after is not None:
                    yield at - before[1], at + 1 + after[1], before[0] + after[0]

    def title(self, text: str, block: list[tuple[str, int, int]], begin: int, end: int) -> bool:
        """Whether a stretch heads a line (but for "The") and its last line ends, or
        a mark stands, after it."""
        line = text[text.rfind("\n", 0, block[begin][1]) + 1 : block[begin][1]]
        after = re.match(r"[^\w\n]*", text[block[end - 1][2] : block[end - 1][2] + 80])[0]
        rest = text[block[end - 1][2] + len(after) : block[end - 1][2] + len(after) + 1]
        inner = text[block[begin][1] : block[end - 1][2]]
        return _WORDS.findall(line.lower()) in ([], ["the"]) and (rest in ("", "\n") or bool(after.strip())) and not re.search(r"[.!?]\s", inner)

    def block(self, text: str, block: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """(license, bytes saved, differing words) of each notice in a block."""
        words = [w[0].lower() for w in block]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        ranked = []
        for t, name in enumerate(self.names):
            for begin, end, wrong in self.stretches(words, places, t):
                if all(self.held[t]) and not self.title(text, block, begin, end):
                    continue
                raw = text[block[begin][1] : block[end - 1][2]].encode()
                saved = len(self.plain.compress(raw)) - len(self.with_template[t].compress(raw))
                ranked.append((-saved, wrong - len(self.words[t]), wrong, name, begin, end))
        taken, found = bytearray(len(words)), []
        for saved, _, wrong, name, begin, end in sorted(ranked):
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                found.append((begin, name, -saved, wrong))
        return [x[1:] for x in sorted(found)]

    def text(self, raw: bytes) -> tuple[list[tuple[str, int, int]], int]:
        """The notices of a text and its number of candidate blocks."""
        if not _SIGN_BYTES.search(raw):
            return [], 0
        text = raw.decode("utf-8", "replace")
        per_block = [self.block(text, b) for b in blocks(text, self.reach)]
        return [x for b in per_block for x in b] + self.tagged(text), len(per_block)


def _scanned(tolerance: float):
    schema = pa.schema([("did", pa.int64()), ("licenses", pa.string()), ("n_notices", pa.int64()), ("n_blocks", pa.int64()), ("n_saved", pa.int64()), ("n_differences", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tolerance=tolerance)
        rows = common.Rows(schema, 1 << 20)
        for batch in batches:
            for did, text in zip(batch.column("did").to_pylist(), common.octets(batch.column("text")), strict=True):
                found, n_blocks = scanner.text(text)
                rows.add(did, ",".join(sorted({x[0] for x in found})), len(found), n_blocks, sum(x[1] for x in found), sum(x[2] for x in found))
            yield from rows.take()
        yield from rows.take(0)

    return run


def license_scan(docs: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(doc_id, licenses, n_notices, n_blocks, n_saved, n_differences) per row:
    identifiers found (sorted, by comma), their notices, candidate blocks, bytes
    saved by the winning templates and words that differ from them."""
    scanned = common.identified(docs).mapInArrow(_scanned(tolerance), "did long, licenses string, n_notices long, n_blocks long, n_saved long, n_differences long")
    return scanned.select(common.doc_id_back().alias("doc_id"), *scanned.columns[1:])


def documents_with(docs: DataFrame, identifier: str) -> DataFrame:
    """Documents in which a license was found."""
    return license_scan(docs).where(F.array_contains(F.split("licenses", ","), identifier))
