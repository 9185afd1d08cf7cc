"""License scan by diagonal voting [native: DataFrame functions only].

Every rolling word k-gram of a text is hashed and joined to the positions of equal k-grams in license templates. A hit
votes for the diagonal (text position - template position); votes are summed by diagonal, neighbouring diagonals (small
insertions or deletions) are merged, and the merged span is verified by the share of the template that it covers. Templates
are short notices, file headers and full license texts, by grams of K words. The fixed phrases of the contract are
templates too, by pairs of words: there a full diagonal is an exact place.

The join runs in two steps: inside the row, hashes that no template has are dropped against the bounded set of template
hashes; what is left (a few places a text at most, whatever the corpus) is joined to the template positions.

Defined results: null or empty text has 0 words, no labels and score 0; labels are distinct and sorted; every row of
documents gives one row, repeated rows included; texts of any length are scanned whole, in their row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, text_of

#: Words of a gram: of the short phrases that are counted exactly, and of notices and full texts.
PHRASE_K, K = 2, 5
#: Diagonals at most so far apart are one span, if no more than DRIFT * k words lie between their grams.
DRIFT = 3
#: A method label needs this share of its template's k-grams in one span; a changed word costs K of them.
COVER = 0.6

# Phrases whose exact places are counted, with their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Short public license notices, with the labels that the method adds.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

# Public license texts and file headers in full.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
    ("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""),
    ("lgpl-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details."""),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]

ORACLE_SQL = None  # spans and score are the method's own; tests hold all columns against a plain twin


def words(text: Column) -> Column:
    return F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(templates: list[tuple[str, str]], k: int, first: int) -> list[tuple[int, str, int, int, str]]:
    """(template, label, k, position, words) of every k-gram, templates numbered from `first`; bounded by their own length."""
    out = []
    for t, (label, text) in enumerate(templates, first):
        own = WORD.findall(text.lower())
        out += [(t, label, k, i, " ".join(own[i : i + k])) for i in range(len(own) - k + 1)]
    return out


def votes(docs: DataFrame, table: list[tuple[int, str, int, int, str]]) -> tuple[DataFrame, DataFrame]:
    """(docs without text, with n_words and the array of its hits; the templates' positions). No text travels."""
    positions = docs.sparkSession.createDataFrame(table, "template int, label string, k int, at int, words string")
    rolling = lambda ws, i, k: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])
    sizes = sorted({row[2] for row in table})
    parts = positions.select("k", F.split("words", " ").alias("ws"))
    # Bounded by the templates.
    known = {k: [r[0] for r in parts.where(F.col("k") == k).select(rolling(F.col("ws"), F.lit(0), k)).distinct().collect()] for k in sizes}

    def of_size(ws: Column, first: Column, k: int) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), lambda i: rolling(ws, i, k).isin(known[k]))
        return F.transform(at, lambda i: F.struct((i - first).alias("pos"), F.array_join(F.slice(ws, i + 1, F.lit(k)), " ").alias("words")))

    def of(ws: Column) -> Column:
        first = F.when(F.get(ws, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)
        hits = [of_size(ws, first, k) for k in sizes]
        return F.struct((F.size(ws) - first - last).cast("long").alias("n_words"), F.concat(*hits).alias("hits"))

    # The words are bound once as a lambda's argument, and inline() keeps the optimizer from repeating the split.
    return docs.select(*[c for c in docs.columns if c != "text"], F.inline(F.transform(F.array(words(F.col("text"))), of))), positions


def spans(hits: DataFrame, positions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(votes by diagonal; neighbouring diagonals merged, with the template's covered k-grams)."""
    one = hits.select(*key, F.inline("hits"))
    # The templates are a fixed table of some thousand rows.
    vote = one.join(F.broadcast(positions), "words").select(*key, "template", "label", "k", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    lines = vote.groupBy(*key, "template", "label", "k", "diagonal").agg(
        F.countDistinct("at").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("ats")
    )
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    far = F.col("lo") - F.lag("hi").over(order)
    marked = lines.withColumn("new", F.when((gap <= DRIFT) & (far <= DRIFT * F.col("k")), 0).otherwise(1))
    merged = marked.withColumn("island", F.sum("new").over(order)).groupBy(*key, "template", "label", "k", "island").agg(
        F.min("lo").alias("start"), (F.max("hi") + F.first("k")).alias("stop"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered")
    )
    return lines, merged


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] | None = None, cover: float = COVER) -> DataFrame:
    """One row per row of docs (doc_id, text): word count, exact places of the base phrases, labels and score.

    Of templates whose spans begin at one word, and then of those whose spans end at one (a license and its longer sister, two
    versions of a notice, a first sentence and the full text), only the one with the most covered k-grams counts; of equal
    ones the last label."""
    every = base + (TEMPLATES + TEXTS if templates is None else templates)
    table = grams(base, PHRASE_K, 0) + grams(every[len(base) :], K, len(base))
    length = {t: sum(row[0] == t for row in table) for t in range(len(every))}
    # Rows are told apart by id and a 256-bit digest of the text; equal rows have equal hits, so they share one set of
    # spans. Only rows with hits travel by it, dealt out by the digest, so a hot id is spread.
    keyed = text_of(docs).select("doc_id", "text", F.struct(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest")).alias("key"))
    hits, positions = votes(keyed, table)
    need = F.element_at(F.lit([length[t] for t in range(len(every))]), F.col("template") + 1)
    distinct = hits.where(F.size("hits") > 0).select("key", "hits").dropDuplicates(["key"])
    lines, merged = spans(distinct, positions, ["key"])
    exact = (
        lines.where((F.col("template") < len(base)) & (F.col("n") == need))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set"))
    )
    rated = merged.withColumn("share", F.least(F.col("covered") / need, F.lit(1.0)))
    labelled = F.when((F.col("share") >= cover) & (F.col("template") >= len(base)), F.struct("covered", "label", "start", "stop"))
    at_start = rated.withColumn("own", labelled).groupBy("key", "start").agg(F.max("share").alias("share"), F.max("own").alias("own"))
    at_stop = at_start.groupBy("key", "own.stop").agg(F.max("share").alias("share"), F.max("own").alias("own"))
    fuzzy = at_stop.groupBy("key").agg(F.max("share").alias("score"), F.collect_set("own.label").alias("more"), F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own.label", "own.start", "own.stop"))).alias("found"))
    none = F.array().cast("array<string>")
    out = hits.select("doc_id", "key", "n_words").join(exact, "key", "left").join(fuzzy, "key", "left")
    base_set = F.coalesce("base_set", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.transform(F.array_sort(F.coalesce("found", F.array().cast("array<struct<label:string,start:int,stop:int>>"))), lambda x: F.concat_ws(":", x["label"], x["start"], x["stop"])).alias("license_spans"),
    )


def op5_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
