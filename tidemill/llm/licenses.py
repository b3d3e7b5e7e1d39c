"""Operator 9: license scans by diagonal voting.

All rolling word 2-grams (for base phrases) and NOTICE_K-grams (for notices) of every
text are hashed and joined by Spark to the positions of the same grams in the templates
(a fixed list, so its broadcast is bounded). A hit votes for the diagonal ``position in
text - position in template``. Votes are summed by document, template and diagonal;
neighbouring diagonals, which missing or added words set apart, are merged; spans with
enough votes are then read again and compared with the template word by word.

A base phrase must stand there exactly: all its 2-grams on one diagonal, and the same
words. A longer notice may differ: diagonals up to SHIFT of its length apart are
neighbours, so a holder's name or a clause may stand within it. Of the span, the best
window of WINDOW times the notice's length counts; their longest common subsequence
must cover LEAST of the notice. A span names one such window, the best.

Edge cases: a null or empty text has no word and no label; a text of fewer words than a
gram has none; repeated rows get a row each, and rows of one id, or without one, are
told apart by a digest of the text wherever they are looked up; an empty table gives no
row. Only doc_id and text are read. A row holds the hashes of one text at most, and as
many spans as its text has room for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import hash_words, rolling_hashes, scan, stored, text_key

# The base phrases and their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
# Well-known license notices and whole license texts; marks and case don't count.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
K = 2  # words of a base phrase's gram
NOTICE_K = 4  # and of a notice's
SHIFT = 0.25  # of a notice's length: diagonals no further apart are neighbours
LEAST_SHIFT = 8  # words, a name in a short notice
WINDOW = 1.5  # of a notice's length
VOTES = 0.3  # of a notice's grams, for a span to be read again
LEAST = 0.75  # of a notice's words, in order
ROWS_OUT = 1 << 20  # hashes that a task hands over at once
SPANS = 100_000  # that are broadcast, at most

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def k(self) -> int:
        return K if self.exact else NOTICE_K

    @property
    def shift(self) -> int:
        return 0 if self.exact else max(LEAST_SHIFT, int(SHIFT * len(self.words)))

    @property
    def needed(self) -> float:
        grams = len(self.words) - self.k + 1
        return grams if self.exact else max(2, VOTES * grams)


TEMPLATES = tuple(Template(label, tuple(words(text)), exact) for kinds, exact in ((PHRASES, True), (NOTICES, False)) for label, text in kinds)


def _of_template(values: Iterable) -> Column:
    """A value for each template, by the column template."""
    return F.array(*map(F.lit, values))[F.col("template")]


def template_table(docs: DataFrame) -> DataFrame:
    """gram -> all (template, position) that have it."""
    places: dict[int, list[tuple[int, int]]] = {}
    for t, template in enumerate(TEMPLATES):
        for at, gram in enumerate(rolling_hashes(hash_words(list(template.words)), template.k).view(np.int64).tolist()):
            places.setdefault(gram, []).append((t, at))
    return docs.sparkSession.createDataFrame(list(places.items()), "gram long, places array<struct<template: int, at: int>>")


def diagonal_votes(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, n_words and, for each diagonal with hits, template, diagonal, votes, low, high.

    A row without hits has nulls there; low and high are the hits' ends in the text.
    """

    def make(texts: list[str | None]) -> Iterator[tuple[list[int], list]]:
        at, rows, held = [], [], 0
        for i, text in enumerate(texts):
            found = words(text)
            hashed = hash_words(found)
            at.append(i)
            rows.append((len(found), np.concatenate([rolling_hashes(hashed, k) for k in (K, NOTICE_K)]).view(np.int64)))
            held += 2 * len(found)
            if held > ROWS_OUT:
                yield at, list(zip(*rows, strict=True))
                at, rows, held = [], [], 0
        if rows:
            yield at, list(zip(*rows, strict=True))

    own = ["row", "doc_id", "text_key", "n_words"]
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    read = scan(keyed, ["doc_id", "text_key"], ["text"], lambda: make, [("n_words", "long", pa.int64()), ("grams", "array<long>", pa.list_(pa.int64()))])
    read = read.withColumn("row", F.monotonically_increasing_id())
    hits = read.select(*own, F.posexplode_outer("grams").alias("place", "gram")).join(F.broadcast(template_table(docs)), "gram", "left")
    # The longer grams stand behind the shorter ones.
    short = F.greatest(F.col("n_words") - K + 1, F.lit(0))
    at = F.when(F.col("place") < short, F.col("place")).otherwise(F.col("place") - short)
    hits = hits.where("places IS NOT NULL OR place IS NULL OR place = 0").select(*own, at.cast("int").alias("at"), F.explode_outer("places").alias("hit"))
    votes = hits.groupBy(*own, F.col("hit.template").alias("template"), (F.col("at") - F.col("hit.at")).alias("diagonal"))
    return votes.agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))


def merged_diagonals(votes: DataFrame) -> DataFrame:
    """Spans of neighbouring diagonals with enough votes: row, doc_id, text_key, template, diagonal, low, high."""
    order = W.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    starts = F.when(gap.isNull() | (gap > _of_template(t.shift for t in TEMPLATES)), 1).otherwise(0)
    spans = votes.where("template IS NOT NULL").withColumn("part", F.sum(starts).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "doc_id", "text_key", "template", "part").agg(F.min("diagonal").alias("diagonal"), F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.where(F.col("votes") >= _of_template(float(t.needed) for t in TEMPLATES)).select("row", "doc_id", "text_key", "template", "diagonal", "low", "high")


def common_length(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """The length of the longest common subsequence, a word of b at a time over all of a as bits."""
    places: dict[bytes, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        held = free & places.get(y, 0)
        free = (free + held | free - held) & full
    return len(a) - free.bit_count()


def span_score(found: list[bytes], template: int, diagonal: int, low: int, high: int) -> float:
    """The share of a template that a span has; base phrases have all or nothing."""
    _, wanted, exact = TEMPLATES[template]
    if exact:
        return float(diagonal >= 0 and tuple(found[diagonal : diagonal + len(wanted)]) == wanted)
    slack = TEMPLATES[template].shift
    size, step = int(WINDOW * len(wanted)) + slack, max(1, len(wanted) // 4)
    end = high + NOTICE_K + slack
    share = max(common_length(wanted, found[max(0, at) : min(at + size, end)]) for at in range(low - slack, max(low - slack, end - size) + step, step)) / len(wanted)
    return share if share >= LEAST else 0.0


def verified_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that stand in the text: found_doc, found_text, template, diagonal, low, high, score."""
    one = F.struct("template", "diagonal", "low", "high")
    wanted = spans.groupBy(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_text")).agg(F.collect_set(one).alias("spans"))
    wanted = stored(wanted, "license-spans")
    few = wanted.agg(F.sum(F.size("spans"))).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("text_key") == F.col("span_text"))
    read = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).join(F.broadcast(wanted) if few <= SPANS else wanted, same)

    def make(texts: list[str | None], keys: list[bytes], each: list[list[dict]]) -> Iterator[tuple[list[int], list]]:
        at, rows, seen = [], [], {}
        for i, (text, key, wanted) in enumerate(zip(texts, keys, each, strict=True)):
            if key not in seen:  # copies side by side are read once
                found = words(text)
                spots = [tuple(s[c] for c in ("template", "diagonal", "low", "high")) for s in wanted]
                seen = {key: [(*s, score) for s in spots if (score := span_score(found, *s))]}
            at += [i] * len(seen[key])
            rows += seen[key]
        if rows:
            yield at, list(zip(*rows, strict=True))

    fields = [*((c, "int", pa.int32()) for c in ("template", "diagonal", "low", "high")), ("score", "double", pa.float64())]
    return scan(read, ["doc_id", "text_key"], ["text", "text_key", "spans"], lambda: make, fields).withColumnsRenamed({"doc_id": "found_doc", "text_key": "found_text"}).distinct()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists what was found: label, first word, score.
    """
    votes = stored(diagonal_votes(docs), "license-votes")
    spans = merged_diagonals(votes)
    good = verified_spans(docs, spans)
    places = ["template", "diagonal", "low", "high"]
    same = [spans["doc_id"].eqNullSafe(good["found_doc"]), spans["text_key"] == good["found_text"], *(spans[c] == good[c] for c in places)]
    found = spans.join(good, same).select("row", *(spans[c] for c in places), good["score"])
    exact, label = _of_template(t.exact for t in TEMPLATES), _of_template(t.label for t in TEMPLATES)
    start = F.when(exact, F.col("diagonal")).otherwise(F.col("low")).cast("long")
    per_row = found.groupBy(F.col("row").alias("found_row")).agg(
        F.sum(exact.cast("long")).alias("n_base"),
        F.min(F.when(exact, start)).alias("first_word"),
        F.max(F.when(exact, start)).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(exact, label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct(start.alias("word"), label.alias("label"), "score"))).alias("spans"),
    )
    rows = votes.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    whole = rows.join(per_row, F.col("row") == F.col("found_row"), "left")
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
