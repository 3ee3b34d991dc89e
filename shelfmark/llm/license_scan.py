"""License scanning by conditional compression.

A text's words, without punctuation, comment marks and line ends, are looked at around each
licensing word or license name, as far as the longest wording reaches; such runs are the
candidate blocks.  Each block is compressed alone and with every template as a raw zstandard
dictionary, and templates are ranked by the bytes that they save; one that saves nothing is
out.  In rank order the others are confirmed by exact wording differences: every wording is
aligned word by word at whatever place fits it best, where few of its words may be missing,
few other words may stand between, and its decisive words (names and versions) must all be
there.  The place is then compressed by itself; it stands only with enough reduction.  Every
place is a finding that overlaps no better one: one with fewer differences, then of a longer
wording, then with a greater reduction.  Names that follow in a list ("the MIT License or
the ISC License") are findings too.

Wordings are sentences, headings and SPDX tags with a license's full and short names, the
notices put into files, and the whole texts of the short licenses.  Every wording holds a
licensing word or a name that starts a block, so the blocks lose none that is whole.

Defined cases: a null or empty text has no block and no finding; a text of any length is
read whole; a text may hold several licenses and the same one several times; ties in
reduction go to the template that stands first; repeated rows get equal results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, strings

#: Least reduction of a place by a template, least share of a wording found.
LEAST_REDUCTION, LEAST_WORDING = 0.2, 0.8

# Names under which licenses are cited, the words that decide between them, and opening wordings.
LICENSES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str], ...] = (
    ("MIT", ("MIT License", "the MIT license"), ("mit",),
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache 2.0 license"), ("apache", "2.0"),
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU GPL v3"), ("general", "public", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU GPL v2"), ("general", "public", "2"),
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1",), ("lesser", "2.1"),
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",), ("lesser", "3"),
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3",), ("affero", "3"),
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", ("Mozilla Public License, version 2.0",), ("mozilla", "2.0"),
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-clause BSD license"), ("bsd", "3"),
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-clause BSD license"), ("bsd", "2"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", ("ISC License",), ("isc",),
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", ("The Unlicense",), ("unlicense",),
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), ("by", "4.0"), ""),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("sa", "4.0"), ""),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("nc", "4.0"), ""),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), ("nd", "4.0"), ""),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0"), ("cc0",), ""),
)
# Short names of licenses, and the whole texts of the short ones.
SHORT_NAMES = {
    "MIT": ("MIT", "The MIT License (MIT)"), "Apache-2.0": ("Apache-2.0", "Apache License 2.0"), "GPL-3.0": ("GPL-3.0", "GPLv3", "GPL v3", "GPL version 3"), "GPL-2.0": ("GPL-2.0", "GPLv2", "GPL v2", "GPL version 2"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "LGPL v2.1", "LGPL version 2.1"), "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "LGPL v3", "LGPL version 3"), "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "AGPL v3", "AGPL version 3"), "MPL-2.0": ("MPL-2.0", "MPLv2", "Mozilla Public License 2.0"),
    "BSD-3-Clause": ("BSD-3-Clause", "3-Clause BSD"), "BSD-2-Clause": ("BSD-2-Clause", "2-Clause BSD"), "ISC": ("ISC",), "Unlicense": ("Unlicense",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0",), "CC0-1.0": ("CC0-1.0", "CC0"),
}
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "BSD-2-Clause": _TWO_CLAUSES + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: Sentences and tags in which a name is cited; a full name is a heading by itself too.
CITATIONS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}")
#: Words that join a further name to a citation.
JOINERS = {"or", "and", "the", "either", "both", "also", "under", "alternatively", "optionally"}
#: Words of full names that stand for the short decisive words.
SYNONYMS = {"attribution": "by", "sharealike": "sa", "noncommercial": "nc", "noderivatives": "nd"}
CUE = re.compile(r"licen[cs]|unlicense|copyright|permission|warrant|redistribut|released under|under the terms|public domain|creative commons|(?<![^\W_])(?:cc0?|gnu|mpl(?:v\d)?|[al]?gpl(?:v[\d.]+)?|bsd|spdx)(?![^\W_])|free software|source code form".replace(" ", r"[\W_]+"), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Comment marks that are words; the others are punctuation.
_MARK = re.compile(r"^[ \t]*(?:dnl|rem)(?=[ \t])", re.IGNORECASE | re.MULTILINE)


#: Put after what is compressed, as the last bytes of an input start no match; nothing resembles it.
_TAIL = bytes(range(1, 9)) + bytes(range(14, 22))


def _size(compressor: zstandard.ZstdCompressor, have: list[str]) -> int:
    """Compressed bytes of these words."""
    return len(compressor.compress(" ".join(have).encode("utf-8", "replace") + _TAIL)) - len(_TAIL)


@dataclass(frozen=True)
class Finding:
    block: int
    license: str
    reduction: float
    missing: int
    extra: int

    @property
    def exact(self) -> bool:
        return self.missing == 0 and self.extra == 0


def words(text: str) -> list[str]:
    return [SYNONYMS.get(w, w) for w in _WORD.findall(_MARK.sub(" ", text).lower())]


def wordings(license: tuple) -> list[tuple[list[str], list[str]]]:
    """(words, decisive words) of everything that states a license."""
    name, cited, decisive, opening = license
    out = []
    for full in (True, False):
        for n in cited if full else SHORT_NAMES.get(name, ()):
            # a short name is decisive as a whole
            own = [d for d in decisive if d in words(n)] if full else list(dict.fromkeys(words(n)))
            heads = [n] if full or len(words(n)) > 2 else []
            out += [(words(w), own) for w in [c.format(n) for c in CITATIONS] + heads]
    for text in (opening, TEXTS.get(name, "")):
        if text:
            out.append((words(text), [d for d in decisive if d in words(text)]))
    return out


#: Words that the longest wording may take, with the other words it may hold.
REACH = max(int(len(w) * (2 - LEAST_WORDING)) for x in LICENSES for w, _ in wordings(x))


def blocks(text: str, reach: int | None = None) -> list[tuple[int, list[str]]]:
    """The candidate blocks as (place of the first word, words): all within ``reach`` words of a licensing word.

    Line ends and sentence ends do not count.  Words near several licensing words form one
    run, looked at in windows that overlap by more than ``reach`` words.
    """
    reach = REACH if reach is None else reach
    if not CUE.search(text):
        return []
    have = words(text)
    joined = " ".join(have)
    out: list[tuple[int, list[str]]] = []
    starts = np.cumsum([0] + [len(w) + 1 for w in have])
    cues = np.searchsorted(starts, [m.start() for m in CUE.finditer(joined)], "right") - 1
    runs: list[list[int]] = []
    for at in cues.tolist():
        first, last = max(at - reach, 0), min(at + reach + 1, len(have))
        if runs and first <= runs[-1][1]:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    for first, last in runs:
        for at in range(first, max(last - reach - 1, first + 1), reach):
            out.append((at, have[at : min(at + 2 * reach + 1, last)]))
    return out


def places(wording: list[str], have: list[str], decisive: list[str]) -> list[tuple[int, int, int, int]]:
    """(missing, extra, start, end) of the places of ``have`` that state ``wording``, the nearest that ends at each word.

    They come from one pass over the wording, with start and end free; a decisive word that
    the wording holds once cannot be missing.
    """
    m, n = len(wording), len(have)
    once = {w for w in decisive if wording.count(w) == 1}
    # one number holds differences, missing words and, as the later start is nearer, the start from the end
    differs, lacks = 1 << 40, 1 << 24
    at = np.arange(n + 1, dtype=np.int64)
    words_at = {w: np.array([x == w for x in have]) for w in set(wording)}
    best = n - at
    for w in wording:
        skipped = np.full(n + 1, 1 << 61, np.int64) if w in once else best + differs + lacks
        skipped[1:] = np.minimum(skipped[1:], np.where(words_at[w], best[:-1], 1 << 61))
        best = np.minimum.accumulate(skipped - at * differs) + at * differs
    most = round(m * (1 - LEAST_WORDING), 9)
    out: list[tuple[int, int, int, int]] = []
    for end in np.flatnonzero(best < (2 * most + 1) * differs).tolist():
        value = int(best[end])
        missing, start = value % differs // lacks, n - value % lacks
        extra = value // differs - missing
        if missing <= most and extra <= most and all(w in have[start:end] for w in decisive):
            out.append((missing, extra, start, end))
    return out


class Template(NamedTuple):
    name: str
    with_dict: zstandard.ZstdCompressor
    #: Decisive words, and the wordings that hold them, each with its words' counts.
    wordings: dict[tuple[str, ...], list[tuple[list[str], dict[str, int]]]]

    def stated(self, have: Counter) -> list[tuple[list[str], list[str]]]:
        """The wordings (with decisive words) of which these words could state enough, in whatever order."""
        out = []
        for decisive, known in self.wordings.items():
            if all(w in have for w in decisive):
                out += [(w, list(decisive)) for w, counts in known if sum(min(c, have[x]) for x, c in counts.items() if x in have) >= LEAST_WORDING * len(w)]
        return out


class Scanner:
    """The templates as compression dictionaries and as wordings."""

    def __init__(self, licenses=LICENSES):
        params = zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.templates: list[Template] = []
        self.names: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        self.memory: dict[tuple[int, tuple[str, ...]], float] = {}
        for license in licenses:
            known = wordings(license)
            raw = zstandard.ZstdCompressionDict("\n".join(" ".join(w) for w, _ in known).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            for n in {tuple(words(x.lower().removeprefix("the "))) for x in (*license[1], *SHORT_NAMES.get(license[0], ()))}:
                self.names.setdefault(n[0], []).append((n, len(self.templates)))
            grouped: dict[tuple[str, ...], list[tuple[list[str], dict[str, int]]]] = {}
            for w, decisive in known:
                grouped.setdefault(tuple(decisive), []).append((w, dict(Counter(w))))
            self.templates.append(Template(license[0], zstandard.ZstdCompressor(dict_data=raw, compression_params=params), grouped))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(reduction, template) by falling reduction."""
        have = words(block)
        alone = _size(self.alone, have)
        cuts = [(1 - _size(t.with_dict, have) / alone, at) for at, t in enumerate(self.templates)]
        return sorted(cuts, key=lambda x: (-x[0], x[1]))

    def reduction(self, have: list[str], at: int) -> float:
        """The reduction of these words by a template."""
        key = (at, tuple(have))
        if (out := self.memory.get(key)) is None:
            out = 1 - _size(self.templates[at].with_dict, have) / _size(self.alone, have)
            if len(self.memory) < 10_000:
                self.memory[key] = out
        return out

    def saving(self, have: list[str]) -> list[int]:
        """The templates that save bytes of these words, those that save most first."""
        alone = _size(self.alone, have)
        saved = [(alone - _size(t.with_dict, have), -at) for at, t in enumerate(self.templates)]
        return [-at for n, at in sorted(saved, reverse=True) if n > 0]

    def stated(self, have: list[str]) -> list[tuple[int, int, float, int, int, int, int]]:
        """(differences, -words, -reduction, template, missing, start, end) of every place that states a wording.

        The reduction is that of the place alone, so what the words around it say does not count.
        """
        held, out = Counter(have), []
        for at in self.saving(have):
            for wording, decisive in self.templates[at].stated(held):
                for missing, extra, start, end in places(wording, have, decisive):
                    if (reduction := self.reduction(have[start:end], at)) >= LEAST_REDUCTION:
                        out.append((missing + extra, -len(wording), -reduction, at, missing, start, end))
        return out

    def joined(self, have: list[str], at: int) -> list[tuple[int, int, int]]:
        """(start, end, template) of the names that follow the place ending at ``at`` in an "or" or "and" list."""
        out, whole = [], 0
        while True:
            start = at
            while start < len(have) and have[start] in JOINERS:
                start += 1
            here = [(len(n), t) for n, t in self.names.get(have[start], ()) if tuple(have[start : start + len(n)]) == n] if start < len(have) else []
            if not here:
                return out[:whole]
            size, template = max(here)
            out.append((start, start + size, template))
            if {"or", "and"} & set(have[at:start]):
                whole = len(out)
            at = start + size

    def scan(self, text: str) -> tuple[int, list[Finding]]:
        """(blocks looked at, findings): every place that overlaps no nearer one, then the names joined to it, in the text's order."""
        candidates = blocks(text)
        if not candidates:
            return 0, []
        have = words(text)
        stated = {}
        for n, (first, block) in enumerate(candidates):
            for *nearness, start, end in self.stated(block):
                # blocks overlap, so a place may be seen twice
                stated.setdefault((*nearness, first + start, first + end), n)
        taken = bytearray(len(have))
        found = []
        for (differ, _, reduction, at, missing, start, end), n in sorted(stated.items()):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                found.append((start, end, Finding(n, self.templates[at].name, -reduction, missing, differ - missing)))
        for _, end, first in list(found):
            for start, stop, at in self.joined(have, end):
                if any(taken[start:stop]):
                    break
                taken[start:stop] = b"\1" * (stop - start)
                found.append((start, stop, Finding(first.block, self.templates[at].name, self.reduction(have[start:stop], at), 0, 0)))
        return len(candidates), [f for _, _, f in sorted(found, key=lambda x: x[0])]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, n_findings, n_exact, licenses, best_reduction) of every row.

    ``licenses`` lists the licenses found, sorted and joined by commas; empty if none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            for text in strings(batch.column(1)):
                n, found = scanner.scan(text)
                out.append((n, len(found), sum(f.exact for f in found), ",".join(sorted({f.license for f in found})), max((f.reduction for f in found), default=None)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string(), pa.float64()], strict=True)]], ["doc_id", "n_blocks", "n_findings", "n_exact", "licenses", "best_reduction"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows, run, "doc_id long, n_blocks long, n_findings long, n_exact long, licenses string, best_reduction double")
