"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Each line of a file (a header) is a TF-IDF vector over words; a licence file's whole text is
one more. Document frequencies of all words count over all files. Only the templates' words are
multiplied (templates are few and fixed); a line's length takes all its words. A line whose
cosine over the templates' words alone, which bounds the true one from above, is below the
threshold is done; the other words of the rest are joined with their frequencies.

Cosine alone mixes up versions and families, whose notices differ in one word. So a template is
compared only with passages that name its version and its family: all telling words of a
template (version numbers, and words such as lesser, affero or by-sa) must be in the passage, and
no other telling family word may be. Templates are notices, SPDX lines, and whole short licences.

A file without a licence of its own takes that of the licence file in its nearest ancestor directory, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

THRESHOLD = 0.6
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Identifiers with the notices that their licences ask for, or their whole text; fixed values.
_NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", _BSD + _BSD_THREE + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Identifiers that an SPDX line may name without a notice here; fixed values.
_NAMES = "0BSD Artistic-2.0 BSL-1.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later WTFPL Zlib".split()
TEMPLATES = _NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in [*dict.fromkeys(n for n, _ in _NOTICES), *_NAMES]]
#: Words that tell families of licences apart; fixed values.
_FAMILIES = frozenset("lesser library affero by-sa by-nc by-nd by-nc-sa by-nc-nd sa nc nd sharealike noncommercial noderivatives".split())
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*)")


def telling(found: Counter | dict[str, int]) -> tuple[frozenset[str], frozenset[str]]:
    """(families, versions) among words; a version without v and without zeros at its end."""
    versions = {re.sub(r"(\.0+)+$", "", m[1]) for w in found if (m := _VERSION.fullmatch(w))}
    return _FAMILIES & found.keys(), frozenset(versions)


#: Distinct words that a task holds while it counts.
HELD_WORDS = 300_000
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


_PASSAGES = pa.list_(pa.struct([("k", pa.int32()), ("name", pa.string()), ("dot", pa.float64()), ("square", pa.float64()), ("others", pa.map_(pa.string(), pa.int32()))]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, df: dict[str, int], n: int):
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for _, t in TEMPLATES for w in words(t)}
        self.vectors, opening = [], set()
        for name, text in TEMPLATES:
            counts = Counter(words(text))
            v = {w: c * self.idf[w] for w, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            families, versions = telling(counts)
            self.vectors.append((name, {w: x / norm for w, x in v.items()}, families, versions if len(text) < 200 else frozenset()))  # numbered paragraphs are no versions
            held = 0.0
            for w, x in sorted(self.vectors[-1][1].items(), key=lambda i: i[1]):
                held += x * x
                if held >= (THRESHOLD - 1e-6) ** 2:
                    opening.add(w)
        #: By Cauchy-Schwarz a text without any of these words is below the threshold for every template.
        self.telling = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, sorted(opening)))})(?![a-z0-9])") if opening else None

    def passage(self, text: str) -> tuple[str, float, float, dict[str, int]] | None:
        """The best template of a text with the dot product, the square of the length over template words, and the
        counts of other words; None if no cosine can reach the threshold."""
        counts = Counter(words(text))
        v = {w: c * self.idf[w] for w, c in counts.items() if w in self.idf}
        square = sum(x * x for x in v.values())
        if not square:
            return None
        families, versions = telling(counts)
        # of equally good templates the first in the list
        fit = ((name, sum(v.get(w, 0.0) * x for w, x in t.items())) for name, t, f, u in self.vectors if f == families and u <= versions)
        name, dot = max(fit, key=lambda x: x[1], default=("", 0.0))
        return (name, dot, square, {w: c for w, c in counts.items() if w not in self.idf}) if dot > 0 and dot >= (THRESHOLD - 1e-6) * math.sqrt(square) else None

    def passages(self, text: str | None, whole: bool) -> list[tuple[str, float, float, dict[str, int]]]:
        """What may reach the threshold of a file's lines, and of its whole text if it is a licence file; equal lines once."""
        if not text or self.telling is None or not self.telling.search(text.lower()):
            return []
        lines = dict.fromkeys([x for x in text.splitlines() if self.telling.search(x.lower())] + [text] * whole)
        return [p for x in lines if (p := self.passage(x))]


def _frequencies(files: DataFrame) -> DataFrame:
    """(word, n): in how many files each word occurs, and the number of files as that of the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter({"": 0})

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(np.array(list(total.values())), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(set(words(text or "")))
                total[""] += 1
                if len(total) > HELD_WORDS:
                    yield out()
                    total.clear()
        yield out()

    return common.materialize(files.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def scan(files: DataFrame) -> DataFrame:
    """files (file_id, path, text) to (file_id, path, own, score, licence, inherited_from), one row per row.

    own: the licence of the file's text with its cosine; licence: own, else that of the nearest
    ancestor directory (its own directory first) with a licence file whose licence is known;
    inherited_from: that directory. A licence file is named LICENSE, LICENCE or COPYING, with any ending; of
    several in a directory the one with the best score counts, ties by path; of equally good templates the first in the list, and of equally
    good passages the first. A null path inherits nothing; rows with a null or repeated file_id stay apart; null or empty texts have no licence of their own. Other columns are ignored.
    """
    common.small_batches(files.sparkSession)
    files = files.select("file_id", "path", "text")
    is_licence = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[sc]e|copying)(\.[^/]*)?$"), F.lit(False))
    frequencies = _frequencies(files)
    vocabulary = sorted({w for _, t in TEMPLATES for w in words(t)})
    df = {r.word: r.n for r in frequencies.where(F.col("word").isin(["", *vocabulary])).collect()}
    n_files = df.pop("", 0)
    scanner = Scanner(df, n_files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [scanner.passages(t, w) for t, w in zip(batch.column("text").to_pylist(), batch.column("is_licence").to_pylist())]
            shown = [[{"k": k, "name": p[0], "dot": p[1], "square": p[2], "others": list(p[3].items())} for k, p in enumerate(f)] for f in found]
            cols = [pa.array(range(at, at + len(found)), pa.int64()), batch.column("file_id"), batch.column("path"), batch.column("is_licence"), pa.array(shown, _PASSAGES)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "file_id", "path", "is_licence", "passages"])
            at += len(found)

    kind = dict(files.dtypes)["file_id"]
    passages = "array<struct<k:int,name:string,dot:double,square:double,others:map<string,int>>>"
    seen = common.materialize(files.withColumn("is_licence", is_licence).mapInArrow(run, f"row long, file_id {kind}, path string, is_licence boolean, passages {passages}"))
    every = seen.select("row", F.explode("passages").alias("p")).select("row", "p.*")
    others = every.select("row", "k", F.explode("others").alias("word", "c"))
    idf = F.log((F.lit(1.0) + n_files) / (F.lit(1.0) + F.col("n")))
    lengths = others.join(frequencies, "word").groupBy("row", "k").agg(F.sum((F.col("c") * idf) ** 2).alias("rest"))
    cosine = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0)))
    scored = every.join(lengths, ["row", "k"], "left").withColumn("cosine", cosine).where(F.col("cosine") >= THRESHOLD)
    best = scored.groupBy("row").agg(F.max_by("name", F.struct("cosine", -F.col("k"))).alias("own"), F.round(F.least(F.max("cosine"), F.lit(1.0)), 9).alias("score"))
    own = seen.drop("passages").join(best, "row", "left").drop("row").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = common.materialize(own.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    given = own.where("is_licence and own is not null").groupBy("dir").agg(F.max_by("own", F.struct("score", "path")).alias("given"))
    parts = F.split("dir", "/")
    above = own.select("dir").where("dir is not null").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
    above = above.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("given", "up"), "depth").alias("g"))
    return own.join(nearest, "dir", "left").select(
        "file_id", "path", "own", "score",
        F.coalesce("own", "g.given").alias("licence"),
        F.when(F.col("own").isNull(), F.col("g.up")).alias("inherited_from"),
    )
