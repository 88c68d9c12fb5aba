"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is judged by its blocks: the whole of it (licence files), its header (the comment that it begins with), each
paragraph and each line. Block and template are sparse TF-IDF vectors: (1 + ln tf) (1 + ln((N + 1) / (df + 1))) for each
word, df being the number of the corpus's documents that hold it. Document frequencies of all words are counted first, with
words combined before the shuffle; those of the templates' words go to all tasks. A word that no template holds weighs 1 at
least, which bounds the cosine of a block from above; only blocks whose bound reaches the threshold leave their task, as a
128-bit key with their other words, so no text is moved and a block that a third of all documents share is one row a task.
Their exact norms come from a join with the document frequencies.

A block's licence is that of its best template, if that reaches the threshold; a document's own licences are those of its
blocks, and the best of all is its licence. A document that is a licence file (its name says so, or that block holds most of its words) licenses its directory;
documents without a licence of their own inherit from the nearest ancestor directory that has one, found by joining each
directory's ancestors by path.

Defined results: a null text has no block; a null path is the root directory; repeated rows each get a row, and count as
documents; an empty table gives an empty result; other columns are ignored. Of equal scores the greater name counts; so
does, in a directory, the greater name of licences with equally many files. Texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from .common import column_or_null, join_split, materialize

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_HEAD = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
DISTRIBUTION 1. Definitions."""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free
Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0}
for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/"""
GNU_TITLE = """{0} Version {1}, {2} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of
this license document, but changing it is not allowed."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means."""
GNU = {"GPL-2.0": ("GNU General Public License", 2, "June 1991"), "GPL-3.0": ("GNU General Public License", 3, "29 June 2007"), "LGPL-3.0": ("GNU Lesser General Public License", 3, "29 June 2007"), "AGPL-3.0": ("GNU Affero General Public License", 3, "19 November 2007")}

#: Texts of well-known licences, their parts, and notices that refer to them; a parameter of scan_licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"MIT License {MIT_GRANT} {MIT_REST}"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_REST}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_THIRD} {BSD_REST}"),
    ("BSD-3-Clause", BSD_THIRD),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_REST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", APACHE_HEAD),
    *((name, f"This work is licensed under the {title}, version {version}.") for name, (title, version, _) in GNU.items()),
    *((name, GNU_NOTICE.format(title, version)) for name, (title, version, _) in GNU.items()),
    *((name, GNU_TITLE.format(*found)) for name, found in GNU.items()),
    ("MPL-2.0", MPL_NOTICE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", UNLICENSE),
)
FILE_NAME = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
COMMENT = re.compile(r"\s*(?://|/\*|\*|#|--|;|%|<!--|!|\"\"\"|'''|$)")
#: Words that a task counts before it emits them.
HELD = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def header_lines(lines: list[str]) -> int:
    """How many lines the comment has that a text begins with."""
    inside = False
    for n, line in enumerate(lines):
        if not inside and not COMMENT.match(line):
            return n
        inside = (inside or "/*" in line or "<!--" in line) and "*/" not in line and "-->" not in line
    return len(lines)


def blocks_of(text: str) -> Iterator[Counter]:
    """Word counts of the whole text, its header, its paragraphs and its lines; equal spans once. A line without a word ends
    a paragraph."""
    lines = text.splitlines()
    words = [words_of(line) for line in lines]
    spans, at = {(0, len(lines)), (0, header_lines(lines))}, 0
    for end in range(len(lines) + 1):
        if end == len(lines) or not words[end]:
            spans.add((at, end))
            at = end + 1
        else:
            spans.add((end, end + 1))
    for a, b in sorted(spans):
        if found := words[a] if b - a == 1 else list(chain.from_iterable(words[a:b])):
            yield Counter(found)


def weight(tf: int, idf: float) -> float:
    return (1 + math.log(tf)) * idf


def document_frequencies(rows: DataFrame) -> DataFrame:
    """Rows ``(word, df)`` of all words of ``rows(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(set(words_of(text.as_py() or "")))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))


class Templates:
    """Unit vectors of the templates, as a column of weights for each of their words."""

    def __init__(self, templates, idf: dict[str, float]):
        self.names = [name for name, _ in templates]
        self.idf = idf
        self.columns = {w: np.zeros(len(templates)) for w in idf}
        for i, (_, text) in enumerate(templates):
            for w, tf in Counter(words_of(text)).items():
                self.columns[w][i] = weight(tf, idf[w])
        norms = np.sqrt(sum(c * c for c in self.columns.values()))
        for c in self.columns.values():
            c /= norms

    def score(self, block: Counter, threshold: float) -> tuple[float, np.ndarray] | None:
        """The square of the norm over the templates' words, and the products with all templates, if the cosine may reach the
        threshold: words that no template holds weigh 1 at least."""
        known = [(w, weight(block[w], self.idf[w])) for w in sorted(block.keys() & self.idf.keys())]
        inner = sum(x * x for _, x in known)
        if inner <= 0 or inner < threshold * threshold * (inner + len(block) - len(known)):
            return None
        dots = np.zeros(len(self.names))
        for w, x in known:
            dots += self.columns[w] * x
        return (inner, dots) if dots.max() >= threshold * math.sqrt(inner + len(block) - len(known)) else None


BLOCKS = "array<struct<key:string,share:double,inner:double,dots:array<double>,others:array<struct<word:string,tf:int>>>>"


def candidates(rows: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """``rows(doc_id, path, text)`` without the text, with the blocks that may reach the threshold."""
    shared = rows.sparkSession.sparkContext.broadcast(templates)
    kind = pa.list_(pa.struct([("key", pa.string()), ("share", pa.float64()), ("inner", pa.float64()), ("dots", pa.list_(pa.float64())), ("others", pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int32())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for text in batch.column(2):
                text = text.as_py() or ""
                out: dict[str, dict] = {}
                n_words = len(words_of(text))
                for block in blocks_of(text):
                    if scored := known.score(block, threshold):
                        others = [{"word": w, "tf": tf} for w, tf in sorted(block.items()) if w not in known.idf]
                        key = xxh3_128_hexdigest(repr(sorted(block.items())).encode())
                        out[key] = {"key": key, "share": block.total() / n_words, "inner": scored[0], "dots": scored[1].tolist(), "others": others}
                found.append(list(out.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["doc_id", "path", "blocks"])

    return rows.mapInArrow(run, f"doc_id long, path string, blocks {BLOCKS}")


def scan_licenses(docs: DataFrame, path: str = "path", templates=TEMPLATES, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, path)``: doc_id, path, own_license, own_score, own_licenses (array of score and
    license, best first), license, origin (own, inherited or none), license_dir (of an inherited licence), depth
    (directories between)."""
    spark = docs.sparkSession
    rows = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column_or_null(docs, path, "string"), F.lit("")).alias("path"), column_or_null(docs, "text", "string").alias("text"))
    n = rows.count()
    df = materialize(document_frequencies(rows), "license-words")
    # As many rows as the templates have words.
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    counted = dict(df.join(F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string")), "word").collect())
    known = Templates(templates, {w: 1 + math.log((n + 1) / (counted.get(w, 0) + 1)) for w in vocabulary})
    held = materialize(candidates(rows, known, threshold).withColumn("row", F.monotonically_increasing_id()), "license-rows")
    blocks = held.filter(F.size("blocks") > 0).select("row", F.inline("blocks"))
    # Each distinct block is measured once; its words that no template holds meet their document frequencies.
    distinct = materialize(blocks.groupBy("key").agg(F.first("inner").alias("inner"), F.first("dots").alias("dots"), F.first("others").alias("others")), "license-blocks")
    others = materialize(distinct.select("key", F.inline("others")), "license-others")
    wanted = others.groupBy("word").agg(F.count(F.lit(1)).alias("copies")).join(df, "word")
    square = F.pow((1 + F.log("tf")) * (1 + F.log(F.lit(n + 1.0) / (F.col("df") + 1))), 2)
    outer = join_split(others, wanted, ["word"], others.count()).groupBy("key").agg(F.sum(square).alias("outer"))
    names = F.array(*map(F.lit, known.names))
    norm = F.sqrt(F.col("inner") + F.coalesce("outer", F.lit(0.0)))
    scored = distinct.join(outer, "key", "left").select("key", F.array_max(F.transform("dots", lambda d, i: F.struct(F.round(d / norm, 9).alias("score"), F.get(names, i).alias("license")))).alias("best"))
    scored = materialize(scored.select("key", "best.score", "best.license").filter(F.col("score") >= threshold), "license-scores")
    uses = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    hits = join_split(blocks.select("row", "key", "share"), scored.join(uses, "key"), ["key"], blocks.count())
    each = hits.groupBy("row", "license").agg(F.max(F.struct("score", "share")).alias("m"))
    own = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("m.score").alias("score"), "license", F.col("m.share").alias("share"))), False).alias("all"))
    first = F.get("all", F.lit(0))
    own = own.select("row", first["license"].alias("own_license"), first["score"].alias("own_score"), F.transform("all", lambda x: F.struct(x["score"].alias("score"), x["license"].alias("license"))).alias("own_licenses"), (first["share"] >= file_share).alias("whole"))
    rows = held.select("row", "doc_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).join(own, "row", "left")
    rows = materialize(rows, "license-own")
    # One licence a directory: that of most of its licence files.
    files = rows.filter(F.col("own_license").isNotNull() & (F.col("whole") | F.col("path").rlike(FILE_NAME)))
    licensed = files.groupBy("dir", "own_license").agg(F.count(F.lit(1)).alias("files")).groupBy("dir").agg(F.max_by("own_license", F.struct("files", "own_license")).alias("dir_license"))
    dirs = materialize(rows.groupBy("dir").agg(F.count(F.lit(1)).alias("copies")), "license-dirs")
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ancestors = materialize(dirs.select("dir", F.posexplode(F.concat(F.array(F.lit("")), above)).alias("level", "above")), "license-above")
    below = ancestors.groupBy("above").agg(F.count(F.lit(1)).alias("copies"))
    reached = join_split(ancestors, licensed.withColumnRenamed("dir", "above").join(below, "above"), ["above"], ancestors.count())
    nearest = reached.groupBy("dir").agg(F.max(F.struct("level", "above", "dir_license")).alias("near"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts)) - F.col("near.level")
    nearest = dirs.join(nearest, "dir", "left").select("dir", "copies", F.col("near.above").alias("above"), F.col("near.dir_license").alias("dir_license"), depth.cast("int").alias("levels"))
    inherits = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    none = F.expr("cast(array() as array<struct<score:double,license:string>>)")
    return join_split(rows, nearest, ["dir"], n).select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_licenses", none).alias("own_licenses"), F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("above")).alias("license_dir"), F.when(inherits, F.col("levels")).alias("depth"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language and a folder of a thousand documents are the directories."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    found = scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))
    return found.withColumn("own_licenses", F.array_join(F.transform("own_licenses", lambda x: x["license"]), ","))
