"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory with a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import save
from quillpanel.llm.decontam import words_of

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_SPDX = "AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-or-later GPL-3.0-or-later ISC LGPL-2.1-or-later LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
#: The texts, file headers and short notices of public licences, by their short names.
TEMPLATES = {
    "AGPL-3.0": [_GNU.format("This program", "Affero", "3"), "This program is free software under the terms of the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Distributed under the simplified BSD 2-Clause License.", _CLAUSES + _DISCLAIMER],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _CLAUSES + _THIRD + _DISCLAIMER, _THIRD],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format("This program", "", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("This program", "", "3")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [_GNU.format("This library", "Lesser", "2.1")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("This library", "Lesser", "3")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License. See LICENSE in the project root for license information.", _MIT + _AS_IS, _MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a"
        " compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to"
        " anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must"
        " not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original"
        " software. 3. This notice may not be removed or altered from any source distribution."
    ],
}
_CC = (
    "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution{0} 4.0 International Public License (\"Public License\"). "
    "To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such "
    "rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."
)
#: Opening paragraphs of long licence texts, by which a file that holds one whole is known.
BODIES = {
    "AGPL-3.0": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "Apache-2.0": [
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"
        " copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "CC-BY-4.0": [_CC.format("")],
    "CC-BY-NC-4.0": [_CC.format("-NonCommercial")],
    "CC-BY-SA-4.0": [_CC.format("-ShareAlike")],
    "CC0-1.0": [
        'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an'
        ' original work of authorship and/or a database (each, a "Work").',
    ],
    "GPL-2.0": [
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free"
        " software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to"
        " using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.",
    ],
    "GPL-3.0": [
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your"
        " freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our"
        " software; it applies also to any other work released this way by its authors. You can apply it to your programs, too.",
    ],
    "LGPL-2.1": [
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You"
        " can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on the explanations below.",
    ],
    "LGPL-3.0": [
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "MPL-2.0": [
        'means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
        'means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.',
    ],
}
for _name, _texts in BODIES.items():
    TEMPLATES[_name] += _texts
for _name in _SPDX.split():
    TEMPLATES[_name.removesuffix("-or-later")].append(f"SPDX-License-Identifier: {_name}")
_FILE = re.compile(r"(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$", re.I)
#: What opens or closes a comment line in source files.
_COMMENT = re.compile(r"^\s*(?:/\*+|\*+/|\*|//+|#+|--+|;+|%+|<!--|REM\b)\s?|\s*(?:\*/|-->)\s*$")


def passages(text: str) -> list[str]:
    """What is compared with the templates: each line, each run of lines between blank ones (comment marks taken off; a run ends where comments end), and the whole text."""
    lines = text.split("\n")
    bare = [_COMMENT.sub("", x).strip() for x in lines]
    runs: list[list[str]] = []
    before = None
    for line, plain in zip(lines, bare, strict=True):
        kind = (plain != line.strip()) if plain else None
        if kind is None or kind != before or not runs:
            runs.append([])
        if plain:
            runs[-1].append(plain)
        before = kind
    return [*(x for x in bare if x), *(" ".join(r) for r in runs if len(r) > 1), *([" ".join(bare)] if len(bare) > 1 else [])]


@dataclass
class Scanner:
    """Template vectors over the templates' own words; any other word weighs as one that no document has."""

    vectors: list[tuple[str, dict[bytes, float], float]]
    weight: dict[bytes, float]
    unknown: float
    least: float
    signal: frozenset[bytes]  # no line without one of these can reach `least`

    def best(self, text: str) -> tuple[float, str | None]:
        tf = Counter(words_of(text))
        if not tf:
            return 0.0, None
        line = {w: n * self.weight.get(w, self.unknown) for w, n in tf.items()}
        total = sum(x * x for x in line.values())
        if sum(x * x for w, x in line.items() if w in self.weight) < (self.least - 1e-6) ** 2 * total:
            return 0.0, None  # words that no template has keep every cosine below
        norm = math.sqrt(total)
        found = [(sum(x * v.get(w, 0.0) for w, x in line.items()) / (norm * size), name) for name, v, size in self.vectors]
        score, name = max(found, key=lambda s: (s[0], s[1]))
        return (round(score, 9), name) if score >= self.least else (0.0, None)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """The likeliest licence of a text's passages, its cosine, and the share of the text's words that the longest passage of any licence has."""
        words = words_of(text)
        if not words or self.signal.isdisjoint(words):
            return None, 0.0, 0.0
        score, name, covered = 0.0, None, 0
        for passage in dict.fromkeys(passages(text or "")):
            s, n = self.best(passage)
            if n:
                covered = max(covered, len(words_of(passage)))
                score, name = max((score, name), (s, n), key=lambda x: (x[0], x[1] or ""))
        return name, score, min(1.0, covered / len(words))


def build(docs: DataFrame, templates: dict[str, list[str]], least: float) -> Scanner:
    """Inverse document frequencies of the templates' words over all the documents; one row for each word and task is all that is gathered."""
    bags = [(name, Counter(words_of(t))) for name, texts in sorted(templates.items()) for t in texts]
    vocabulary = frozenset(w for _, bag in bags for w in bag)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(vocabulary.intersection(words_of(text.as_py())))
                found[b""] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(found.values(), pa.int64())})

    df = {r[0].encode(): r[1] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    total = df.get(b"", 0)
    idf = lambda n: math.log((total + 1) / (n + 1)) + 1
    weight = {w: idf(df.get(w, 0)) for w in vocabulary}
    vectors = []
    for name, bag in bags:
        v = {w: n * weight[w] for w, n in bag.items()}
        vectors.append((name, v, math.sqrt(sum(x * x for x in v.values()))))
    signal = set()
    for _, v, size in vectors:
        rest = size * size
        for w in sorted(v, key=lambda w: (-v[w], w)):
            if math.sqrt(max(rest, 0)) < (least - 1e-6) * size:
                break
            signal.add(w)
            rest -= v[w] * v[w]
    return Scanner(vectors, weight, idf(0), least, frozenset(signal))


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.75, salts: int = 8) -> DataFrame:
    """path, license, cosine, basis and from_path of each file; other columns but `key`, which is kept if there, are dropped.

    basis: `file` where the file is a licence file (by its name, or because nearly all its words are one passage with a licence), `header` where a passage of it has a
    licence, `inherited` where the nearest directory above with a licence file gives it (of several files the likeliest, then the first by path), else `none`. Passages
    are lines, paragraphs without their comment marks, and the whole text. Null and empty texts can only inherit; a null path inherits nothing. Ties go to the last
    name. Repeated rows each give a row.
    """
    files = files.select(*[c for c in ("key", "path", "text") if c in files.columns])
    extra = [c for c in files.columns if c not in ("path", "text")]
    at = files.columns.index("text")
    shared = files.sparkSession.sparkContext.broadcast(build(files, templates or TEMPLATES, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(at)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(n for n in batch.schema.names if n != "text"), "license", "cosine", "covered"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([f for f in files.schema.fields if f.name != "text"]).add("license", StringType()).add("cosine", DoubleType()).add("covered", DoubleType())
    own = save(files.mapInArrow(run, schema), "licences")
    is_file = F.col("license").isNotNull() & (F.coalesce(F.col("path").rlike("(?i)" + _FILE.pattern), F.lit(False)) | (F.col("covered") >= 0.95))
    own = own.withColumn("basis", F.when(is_file, "file").when(F.col("license").isNotNull(), "header").otherwise("none"))
    own = own.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    given = own.where((F.col("basis") == "file") & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license")).alias("g"))
    given = given.select(F.col("dir").alias("above"), F.col("g.path").alias("source_path"), F.col("g.license").alias("given"), (-F.col("g.less")).alias("given_cosine"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    dirs = own.where((F.col("basis") == "none") & F.col("dir").isNotNull()).select("dir").distinct().withColumn("above", F.explode(above))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("source_path", "given", "given_cosine"), F.length("above")).alias("h"))
    nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # a directory may hold a third of all files
    salted = own.withColumn("salt", (F.pmod(F.xxhash64(*extra, "path"), F.lit(salts))).cast("int"))
    joined = salted.join(nearest.withColumn("basis", F.lit("none")), ["dir", "basis", "salt"], "left")
    return joined.select(
        *extra, "path", F.coalesce("license", "h.given").alias("license"), F.when(F.col("license").isNotNull(), F.col("cosine")).otherwise(F.coalesce("h.given_cosine", F.lit(0.0))).alias("cosine"),
        F.when(F.col("h").isNotNull(), "inherited").otherwise(F.col("basis")).alias("basis"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("h.source_path")).alias("from_path"),
    )
