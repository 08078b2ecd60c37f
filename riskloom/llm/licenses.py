"""License scans: min-hash bands over overlapping windows, then exact shingle containment.

Text and templates are words (runs of digits, letters and non-ASCII characters, A-Z lower-cased) in shingles of five,
a template of fewer words being one shingle of its own length. Windows of ``w`` shingles at every ``w / 2`` shingles
cover every text whole; a template of at least ``1.5 w`` shingles holds one of them in any verbatim place. Each template
uses the largest ``w`` of 8, 4, 2, 1 that fits, and all its windows at all offsets are indexed by ``BANDS`` keys of
``ROWS`` minima. A window that shares 0.7 of its shingles with a template window is missed with probability
(1 - 0.7**2)**16 = 2e-5, an equal one never; a window of one shingle is looked up by the shingle itself.

What the bands retrieve is verified: the share of the template's distinct shingles in the words around the window must
reach ``CONTAINMENT``. Templates are a parameter of fixed size (``MAX_TEMPLATE_WORDS`` in all), so their broadcast is
bounded. Documents stream past them without a shuffle.

Defined cases: null or empty text has no license; a template without words is refused; repeated documents are each
answered; several places of one template in a text are all reported, overlapping ones merged; an input column ``licenses``
is kept as ``in_licenses``; ids are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as tk
from .storage import make_room, table

SHINGLE = 5
CONTAINMENT = 0.8
ROWS, BANDS = 2, 16
WIDTHS = (8, 4, 2, 1)
MAX_TEMPLATE_WORDS = 200_000

#: The disclaimers that end several licenses (fixed values).
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Common notices and whole short licenses, by the identifier of the license (fixed values). A caller gives longer ones,
#: such as a folder of license texts, as a mapping of the same kind.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-full": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_END
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-full": _BSD_START + _BSD_END,
    "BSD-3-Clause-full": (
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _BSD_END
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
}

_RNG = np.random.default_rng(3)
_MULTIPLY = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:  # widths are powers of two
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x


def _band_keys(grams: np.ndarray, width: int, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each band the keys of the windows of ``width`` shingles that start at ``at``."""
    if width == 1:
        yield grams[at]
        return
    for band in range(BANDS):
        key = np.full(len(at), band, np.uint64)
        for r in range(band * ROWS, (band + 1) * ROWS):
            key = tk.mix(key ^ _sliding_min(grams * _MULTIPLY[r] + _ADD[r], width)[at])
        yield key


class TemplateIndex:
    """Band keys of all template windows, grouped by shingle length and window width."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.shingle: list[int] = []
        keys: dict[tuple[int, int], list[list[tuple[np.ndarray, int, np.ndarray]]]] = {}
        total = 0
        for number, name in enumerate(self.names):
            (_, _, data, offsets), *_ = tk.slices(pa.array([templates[name]]))
            words = tk.Words(data, offsets, tk.ALPHANUMERIC, lower=True)
            if not len(words):
                raise ValueError(f"template {name} has no words")
            total += len(words)
            size = min(SHINGLE, len(words))
            grams = tk.grams(words.hashes, size)
            width = next((w for w in WIDTHS if len(grams) >= w + w // 2), 1)
            starts = np.arange(len(grams) - width + 1)
            slot = keys.setdefault((size, width), [[] for _ in range(BANDS if width > 1 else 1)])
            for band, own in enumerate(_band_keys(grams, width, starts)):
                slot[band].append((own, number, starts))
            self.sets.append(np.unique(grams))
            self.lengths.append(len(words))
            self.shingle.append(size)
        if total > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of {total} words; at most {MAX_TEMPLATE_WORDS} are broadcast")
        self.keys = {}
        for kind, bands in keys.items():
            self.keys[kind] = []
            for rows in bands:
                key = np.concatenate([k for k, _, _ in rows])
                number = np.concatenate([np.full(len(k), n) for k, n, _ in rows])
                start = np.concatenate([s for _, _, s in rows])
                order = np.argsort(key, kind="stable")
                self.keys[kind].append((key[order], number[order], start[order]))

    def candidates(self, words: tk.Words) -> Iterator[tuple[int, int, int]]:
        """(template, first word at which it may start, row) of every retrieved pair, each once."""
        for (size, width), bands in self.keys.items():
            grams = tk.grams(words.hashes, size)
            starts = tk.starts_within(words.rows, size + width - 1)
            if not len(starts):
                continue
            owner = words.row_of()
            if width > 1:
                step = width // 2
                inside = starts - words.rows[owner[starts]]
                lengths = (words.rows[1:] - words.rows[:-1])[owner[starts]]
                starts = starts[(inside % step == 0) | (inside == lengths - (size + width - 1))]
            found = set()
            for (key, number, offset), own in zip(bands, _band_keys(grams, width, starts), strict=True):
                low, high = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
                for k in np.flatnonzero(high > low):
                    for j in range(low[k], high[k]):
                        found.add((int(number[j]), int(starts[k] - offset[j]), int(owner[starts[k]])))
            yield from found

    def places(self, words: tk.Words) -> dict[int, list[tuple[int, int, int, float]]]:
        """row -> (template, first word, end word, containment) of verified places, words counted from the row's start."""
        best: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for number, start, row in self.candidates(words):
            size, length = self.shingle[number], self.lengths[number]
            slack = length // 4
            low, high = max(int(words.rows[row]), start - slack), min(int(words.rows[row + 1]), start + length + slack)
            at = np.arange(low, high - size + 1)
            grams = tk.gram_hashes(words.hashes, at, size)
            mine = self.sets[number]
            hit = mine[np.minimum(np.searchsorted(mine, grams), len(mine) - 1)] == grams
            share = len(np.unique(grams[hit])) / len(mine)
            if share >= CONTAINMENT:
                at = at[hit] - words.rows[row]
                best.setdefault((row, number), []).append((int(at[0]), int(at[-1]) + size, share))
        out: dict[int, list[tuple[int, int, int, float]]] = {}
        for (row, number), spans in sorted(best.items()):
            merged: list[list] = []
            for a, b, share in sorted(spans):
                if merged and a < merged[-1][1]:
                    merged[-1][1:] = [max(b, merged[-1][1]), max(share, merged[-1][2])]
                else:
                    merged.append([a, b, share])
            out.setdefault(row, []).extend((number, a, b, share) for a, b, share in merged)
        return out


_PLACES = "array<struct<license:string,start:int,end:int,containment:double>>"


def read_templates(spark: SparkSession, folder: str, most_bytes: int = 16 << 20) -> dict[str, str]:
    """Templates from a folder of text files, whole licenses as a rule: the file's name without its ending names the
    template. Read by Spark, so the folder may be in any store; files of more than ``most_bytes`` in all raise, empty ones
    are left out, and of two files of one name (in different folders) the first in order counts."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    size = files.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"templates of {size} bytes; at most {most_bytes} are read")
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.[A-Za-z]+$", "")
    rows = files.select(name.alias("name"), "path", "text").where(F.col("text").rlike("\\S")).orderBy(F.desc("path")).collect()
    return {r["name"]: r["text"] for r in rows}


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` with ``licenses`` added: places (license, start, end in words, containment)."""
    docs = make_room(docs, "licenses")
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, _, data, offsets in tk.slices(batch.column(at)):
                for k, places in index.places(tk.Words(data, offsets, tk.ALPHANUMERIC, lower=True)).items():
                    found[row + k] = [{"license": index.names[n], "start": a, "end": b, "containment": share} for n, a, b, share in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "licenses"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, licenses {_PLACES}")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_places"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), " ").alias("places"),
    )
