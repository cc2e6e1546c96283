"""License scans by conditional compression against templates."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import read

# The wording of public licences and of their usual notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD": "Licensed under the BSD License.",
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    # usual short forms
    "MIT name": "Licensed under the MIT License.",
    "MIT project": "This project is licensed under the MIT License.",
    "MIT plain": "The MIT License (MIT)",
    "Apache-2.0 name": "Licensed under the Apache License 2.0.",
    "Apache-2.0 project": "This project is licensed under the Apache License 2.0.",
    "BSD-3-Clause name": "BSD 3-Clause License",
    "BSD-2-Clause name": "BSD 2-Clause License",
    "GPL-2.0 name": "Licensed under the GNU GPL v2.",
    "GPL-3.0 name": "Licensed under the GNU GPL v3.",
    "GPL-2.0 short": "Licensed under GPLv2.",
    "GPL-3.0 short": "Licensed under GPLv3.",
    "GPL-2.0 label": "License: GPLv2",
    "GPL-3.0 label": "License: GPLv3",
    "CC-BY-4.0 name": "Licensed under Creative Commons Attribution 4.0.",
    "CC-BY-SA-4.0 name": "Licensed under Creative Commons Attribution-ShareAlike 4.0.",
    "CC-BY-NC-4.0 name": "Licensed under Creative Commons Attribution-NonCommercial 4.0.",
    "CC-BY-4.0 full name": "Creative Commons Attribution 4.0 International License",
}
# Identifiers of the same licences as one line of a source file names them.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES |= {f"{name} SPDX": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: One of these, in lower case, is in every candidate block; between two words may be a line's end and comment marks.
TRIGGERS = ("licens", "licenc", "copyright", "redistribut", "hereby granted", "public domain", "creative commons", "cc by", "spdx", "gplv")
#: A block has as many words on both sides of a trigger as the longest template, so many times: stray words and marks fit in.
REACH = 2
#: The most of a template's words that may be missing.
MOST_MISSING = 0.1
#: In an alignment, a missing word costs as much as so many added ones: a stray word further off is not drawn in.
STRAY = 20
#: Templates are looked for in windows that fit the longest of their class; the classes' numbers of words.
CLASSES = (12, 60)
#: A candidate saves at least this share of the bytes that the template saves of its own text. A template that saves fewer
#: bytes of itself than LEAST_TELLING is a candidate wherever its words are.
LEAST_SAVED, LEAST_TELLING = 0.25, 12

# After a hyphen a line may end, and the next one may begin with comment marks.
_WORD = re.compile(r"[^\W_]+(?:(?:[.]|-(?:\r?\n\W{0,20})?)[^\W_]+)*")
_TRIGGERS = [(t.split()[0], re.compile(t.replace(" ", r"\W+"))) for t in TRIGGERS]
_CLOSING = re.compile(r"[.,;:!?)\"'”’»]*")


# Words that tell one licence from another.
_TELLING = frozenset("by-nc by-sa by-nd by by-nc-sa by-nc-nd lesser affero mit apache bsd gnu gpl cc0 attribution-sharealike attribution-noncommercial not".split())


def _never_missing(word: str) -> bool:
    return word in _TELLING or any(c.isdigit() for c in word)


def words(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text.lower())]


def _plain(word: str) -> str:
    return re.sub(r"\r?\n\W*", "", word) if "\n" in word else word


@dataclass(frozen=True)
class _Template:
    name: str
    words: tuple[str, ...]
    #: With the template's text and with its words as a raw dictionary.
    text: zstandard.ZstdCompressor
    plain: zstandard.ZstdCompressor
    #: Words without which it is never confirmed, all of them, and the bytes that it saves of its own words.
    needed: frozenset[str]
    all: frozenset[str]
    saves: int


def _compressor(dictionary: str | None, level: int) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    raw = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)


@lru_cache(maxsize=4)
def _compressors(templates: tuple[tuple[str, str], ...], level: int = 6) -> tuple[zstandard.ZstdCompressor, list[_Template]]:
    plain, out = _compressor(None, level), []
    for name, text in templates:
        w = tuple(words(text))
        own = " ".join(w)
        c = _compressor(own, level)
        needed = frozenset(w) if int(MOST_MISSING * len(w)) == 0 else frozenset(filter(_never_missing, w))
        saves = len(plain.compress(own.encode())) - len(c.compress(own.encode()))
        out.append(_Template(name, w, _compressor(text.lower(), level), c, needed, frozenset(w), saves))
    return plain, out


@lru_cache(maxsize=4)
def reach(templates: tuple[tuple[str, str], ...]) -> int:
    """Words that a block has on both sides of a trigger."""
    return REACH * max((len(words(t)) for _, t in templates), default=1)


def blocks(text: str, templates: Mapping[str, str] = TEMPLATES) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks: what is around triggers, as far as the longest template could go.

    No template is that long, with all the stray words that an alignment may have about it, so nothing of a notice is
    cut off; blank lines don't end a block, as notices have paragraphs. Blocks that overlap are one.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: only ASCII letters matter here
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    hits = sorted(m.start() for first, t in _TRIGGERS if first in low for m in t.finditer(low))
    if not hits:
        return []
    at, most = [m.span() for m in _WORD.finditer(text)], reach(tuple(templates.items()))
    starts, out = [x for x, _ in at], []
    for hit in hits:
        k = max(0, bisect(starts, hit) - 1)
        a, b = at[max(0, k - most)][0], at[min(len(at) - 1, k + most)][1]
        b = _CLOSING.match(text, b).end()
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def placements(block: list[str], template: list[str]) -> list[tuple[int, int, list[str], list[str]]]:
    """(start, end, missing words, added words) of the template's non-overlapping alignments in the block, closest first.

    Words are matched in order; the cost is STRAY for each missing word and 1 for each added one between those matched.
    """
    m, n = len(template), len(block)
    same = {w: np.array([x == w for x in block]) for w in set(template)}
    cost, places = np.zeros((m + 1, n + 1), np.int32), np.arange(n + 1, dtype=np.int32)
    for i, w in enumerate(template, 1):
        cost[i] = cost[i - 1] + STRAY
        np.minimum(cost[i, 1:], cost[i - 1, :-1], out=cost[i, 1:], where=same[w])
        cost[i] = np.minimum.accumulate(cost[i] - places) + places
    used, out = np.zeros(n, bool), []
    ends = 1 + np.flatnonzero(np.logical_or.reduce(list(same.values())) & (cost[m, 1:] < STRAY * m))
    for end in ends[np.argsort(cost[m, ends], kind="stable")].tolist():
        if used[end - 1]:
            continue
        i, j, at, lost, added = m, end, [], [], []
        while i:
            if j and same[template[i - 1]][j - 1] and cost[i, j] == cost[i - 1, j - 1]:
                i, j = i - 1, j - 1
                at.append(j)
            elif cost[i, j] == cost[i - 1, j] + STRAY:
                i -= 1
                lost.append(template[i])
            else:
                j -= 1
                added.append(block[j])
        if at[:1] == [end - 1] and not used[at[-1] : end].any():
            used[at[-1] : end] = True
            out.append((at[-1], end, lost[::-1], added[::-1]))
    if out:  # what lies between alignments that were found may hold others that overlapped them
        edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= (1 - MOST_MISSING) * m:
                out += [(a + x, a + y, lost, added) for x, y, lost, added in placements(block[a:b], template)]
    return out


def differences(block: list[str], template: list[str]) -> tuple[int, int, list[str]]:
    """(missing, added, missing words): the template's words not in the block, and the block's between those that are."""
    best = placements(block, template)[:1]
    return (len(best[0][2]), len(best[0][3]), best[0][2]) if best else (len(template), 0, template)


def rank(block: str, templates: Mapping[str, str] = TEMPLATES) -> list[tuple[float, str]]:
    """(reduction, template), best first: the share of the block's compressed bytes that the template saves."""
    plain, each = _compressors(tuple(templates.items()))
    data = block.lower().encode()
    size = len(plain.compress(data))
    return sorted(((1 - len(t.text.compress(data)) / size, t.name) for t in each), key=lambda x: (-x[0], x[1]))


def _windows(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of n words such that any stretch of REACH * size words lies in one."""
    start = 0
    while True:
        yield start, min(n, start + (REACH + 1) * size)
        start += size
        if start >= n or start + REACH * size >= n:
            return


def winners(have: list[str], templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_SAVED) -> list[tuple[int, float, str, tuple[int, int]]]:
    """(bytes saved, share of the most it can save, template, window of words) of the candidates, best first.

    Each window's words are compressed without and with each template as a raw dictionary; templates rank by the bytes
    they save, then by what share of their own that is. Templates with a needed word that the window doesn't have, or too
    few of its words, could never be confirmed and are passed over.
    """
    plain, each = _compressors(tuple(templates.items()))
    present, out = frozenset(have), []
    each = [t for t in each if t.needed <= present and len(t.all - present) <= MOST_MISSING * len(t.words)]
    classes = sorted({*CLASSES, max((len(t.words) for t in each), default=1)})
    for low, size in zip([0, *classes], classes, strict=False):
        mine = [t for t in each if low < len(t.words) <= size]
        for a, b in _windows(len(have), size) if mine else ():
            near = frozenset(have[a:b])
            fit = [t for t in mine if t.needed <= near and len(t.all - near) <= MOST_MISSING * len(t.words)]
            if not fit:
                continue
            data = " ".join(have[a:b]).encode(errors="replace")
            whole = len(plain.compress(data))
            for t in fit:
                saved = whole - len(t.plain.compress(data))
                share = saved / t.saves if t.saves >= LEAST_TELLING else 1.0
                if share >= least:
                    out.append((saved, share, t.name, (a, b)))
    return sorted(out, key=lambda x: (-x[0], -x[1], x[2], x[3]))


def notices(text: str, a: int = 0, b: int | None = None, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_SAVED) -> list[tuple[int, int, str, float, int, int]]:
    """(start, end, template, reduction, words missing, words added) of every confirmed notice in text[a:b], in order.

    Templates are ranked by what they save of the compressed words, see winners(), and confirmed in that order by their
    exact wording differences; what is confirmed takes its words. A missing number, and a missing or added word that tells
    it from another template (a version, NC, Lesser), is never forgiven. reduction is the share of the notice's own bytes saved.
    """
    b = len(text) if b is None else b
    plain, each = _compressors(tuple(templates.items()))
    by_name = {t.name: t for t in each}
    at = [x.span() for x in _WORD.finditer(text, a, b)]
    # words that the block's bounds cut in two are none
    at = at[bool(at and 0 < at[0][0] == a and text[a - 1].isalnum()) :]
    at = at[: len(at) - bool(at and at[-1][1] == b < len(text) and text[b].isalnum())]
    have = [_plain(text[x:y].lower()) for x, y in at]
    out, starts = [], []
    for _, _, name, (low, high) in winners(have, templates, least):
        t = by_name[name]
        for x, y, lost, added in placements(have[low:high], list(t.words)):
            if len(lost) > MOST_MISSING * len(t.words) or any(map(_never_missing, lost)) or _TELLING & set(added) - t.all:
                continue
            k = bisect(starts, low + x)
            if (k and out[k - 1][1] > low + x) or (k < len(out) and out[k][0] < low + y):
                continue
            starts.insert(k, low + x)
            out.insert(k, (low + x, low + y, name, len(lost), len(added)))
    rows = []
    for x, y, name, missing, added in out:
        start, end = at[x][0], _CLOSING.match(text, at[y - 1][1], b).end()
        data = text[start:end].lower().encode(errors="replace")
        rows.append((start, end, name, 1 - len(by_name[name].text.compress(data)) / len(plain.compress(data)), missing, added))
    return rows


def identify(block: str, templates: Mapping[str, str] = TEMPLATES) -> tuple[str | None, float, int, int]:
    """(template or None, reduction, words missing, words added) of the block's notice with the fewest differences."""
    found = notices(block, templates=templates)
    if not found:
        return None, max((r for r, _ in rank(block, templates)[:1]), default=0.0), 0, 0
    return min(found, key=lambda x: (x[4] + x[5], x[0] - x[1]))[2:]


FOUND = "start long, end long, license string, reduction double, missing int, added int, confirmed boolean"


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for a, b in blocks(text, templates):
                    found = notices(text, a, b, templates) or [(a, b, *identify(text[a:b], templates))]
                    rows += [k] * len(found)
                    out += [(*x, x[2] is not None) for x in found]
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["id", "start", "end", "license", "reduction", "missing", "added", "confirmed"],
            )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """A row for each notice in the candidate blocks of every whole text: id_col, start, end, license, reduction, missing,
    added, confirmed.

    A block is the text around trigger words, on both sides as many words as twice the longest template has. Every
    template is a raw Zstandard dictionary: windows of a block's words are compressed with each, the templates rank by the
    bytes they save, and in that order each notice is confirmed by its exact wording differences (words missing and
    added); start and end are the notice's own. reduction is the share of the notice's compressed bytes that is saved. A block without a confirmed notice has one row with the block's bounds, the
    best reduction of any template and a null license. Offsets are code points.
    Null and empty texts have no block; repeated rows are scanned each; other columns are not read. An empty table
    gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(_scan(dict(templates)), f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
