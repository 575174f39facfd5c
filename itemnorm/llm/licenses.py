"""License notices in documents by conditional compression.

Sentences with a licence word are candidate blocks, and so are one or several whole lines of a sentence, as notices are
wrapped and lines around them need not end in a full stop; comment marks at line starts do not count. A block is compressed with zstandard alone and with each licence
template as raw dictionary, in lower case; what the template saves is its size reduction. Templates are ranked by it, and the
first one that the exact differences of wording confirm wins: the block's words are aligned with the template's passage that
fits best, and the licence is accepted if few words differ and none of the telling ones (numbers, licence names) does. A
block that no template makes a fifth smaller is not compared with any.
Of accepted blocks that overlap, the one with the smallest share of differing words counts, and the longest of those.

Null and empty texts have no notices. Sentences have any length; every text is read whole.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_rows

#: Public wordings of licence notices, one passage per line.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
This project is licensed under the Apache License 2.0 - see the LICENSE file for details.
SPDX-License-Identifier: Apache-2.0""",
    "MIT": """Released under the MIT License.
Licensed under the MIT License.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
This project is licensed under the MIT License - see the LICENSE file for details.
SPDX-License-Identifier: MIT""",
    "BSD-3-Clause": """Licensed under the BSD 3-Clause License.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
This project is licensed under the BSD 3-Clause License - see the LICENSE file for details.
SPDX-License-Identifier: BSD-3-Clause""",
    "BSD-2-Clause": """Licensed under the BSD 2-Clause License.
This project is licensed under the BSD 2-Clause License - see the LICENSE file for details.
SPDX-License-Identifier: BSD-2-Clause""",
    "ISC": """Licensed under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
SPDX-License-Identifier: ISC""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
You should have received a copy of the GNU Lesser General Public License along with this library.
SPDX-License-Identifier: LGPL-2.1-or-later
SPDX-License-Identifier: LGPL-2.1-only""",
    "GPL-3.0": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
You should have received a copy of the GNU General Public License along with this program.
SPDX-License-Identifier: GPL-3.0-or-later
SPDX-License-Identifier: GPL-3.0-only""",
    "GPL-2.0": """This work is licensed under the GNU General Public License, version 2.
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
SPDX-License-Identifier: GPL-2.0-or-later
SPDX-License-Identifier: GPL-2.0-only""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
SPDX-License-Identifier: MPL-2.0""",
    "CC-BY-4.0": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
SPDX-License-Identifier: CC-BY-4.0""",
    "CC-BY-SA-4.0": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
SPDX-License-Identifier: CC-BY-SA-4.0""",
    "CC-BY-NC-4.0": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
SPDX-License-Identifier: CC-BY-NC-4.0""",
    "All-rights-reserved": """All rights reserved.
Copyright. All rights reserved.""",
}
#: Between two words: also a line break, with a comment mark on the next line.
GAP = r"\W+(?:(?:rem|dnl)\W+)?"
#: Words without which a sentence is no candidate; the first form is for Java's expressions as well.
CUES = (
    r"(?i)licen[cs]e|copyright|rights reserved|permission is hereby|redistribut|public license|creative commons"
    r"|\bcc by\b|without warrant|no event shall|free software"
).replace(" ", GAP)
#: Ends of sentences, and other line breaks as a group: a notice may go on behind these.
SENTENCE = re.compile(r"(?<=[.!?:])(?<!-Identifier:)\s+(?=[^\s\d])|(\n+)")
MARK = re.compile(r"\s*(?:(?:<!--|[/*#;%>|!\"']+|--+|(?:rem|dnl)\b)\s*)*", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: A word that changes which licence it is.
TELLING = re.compile(r"\d|^(?:by|nc|sa|nd|by-.*|mit|bsd|apache|gnu|lesser|affero|mozilla|attribution.*|noncommercial|sharealike|not|isc|lgpl.*|gpl.*|mpl.*|cc-.*)$")
REDUCTION = 0.2
DIFFERENT = 0.2
LEVEL = 9


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.names = list(templates)
        self.passages = {n: [WORD.findall(p.lower()) for p in t.splitlines()] for n, t in templates.items()}
        self.primed = {}
        for n, t in templates.items():
            raw = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.primed[n] = zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_dict_id=False)
        self.cue = re.compile(f"(?i)(?=({CUES.removeprefix('(?i)')}))")
        self.longest = max((len(p) for t in self.passages.values() for p in t), default=0) / (1 - DIFFERENT)
        self.known: dict[str, tuple | None] = {}

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """(size reduction, licence), largest first; ties by the order of the templates."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        found = [(1 - len(self.primed[n].compress(raw)) / alone, n) for n in self.names]
        return sorted(found, key=lambda x: -x[0])

    def differences(self, words: list[str], name: str) -> tuple[int, list[str]]:
        """Number and list of the word differences to the template's passage with the fewest."""
        best: tuple[int, list[str]] | None = None
        for passage in self.passages[name]:
            edits, n = [], 0
            for op, a, b, c, d in difflib.SequenceMatcher(None, passage, words, autojunk=False).get_opcodes():
                if op != "equal":
                    n += max(b - a, d - c)
                    edits += [f"-{w}" for w in passage[a:b]] + [f"+{w}" for w in words[c:d]]
            if best is None or n < best[0]:
                best = n, edits
        return best or (len(words), [f"+{w}" for w in words])

    def judge(self, block: str) -> tuple[str, float, int, list[str]] | None:
        """(licence, reduction, number of differences, differences) of a block: the first of the ranking that its
        wording confirms, whatever its place; None if there is none. Templates that save too little are not compared."""
        words = WORD.findall(block.lower())
        for reduction, name in self.ranked(block):
            if reduction < REDUCTION:
                break
            n, edits = self.differences(words, name)
            if n <= DIFFERENT * max(len(words), 1) and not any(TELLING.search(e[1:]) for e in edits):
                return name, reduction, n, edits
        return None

    def verdict(self, block: str) -> tuple[str, float, int, list[str]] | None:
        if block not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[block] = self.judge(block)
        return self.known[block]

    def sentences(self, text: str) -> Iterator[list[tuple[int, str]]]:
        """The lines with words of each sentence, without comment marks: (place, line)."""
        lines, at, i = [], 0, 0
        for end in [*SENTENCE.finditer(text), None]:
            line = text[at : end.start() if end else len(text)]
            line = line[MARK.match(line).end() :].strip()
            if WORD.search(line):
                lines.append((i, line))
            if end is None or end[1] is None:
                yield lines
                lines = []
            at, i = end.end() if end else at, i + 1

    def scan(self, text: str | None) -> list[dict]:
        """Notices in a text, in order: place of the first line among all lines and sentences, licence, reduction,
        differences."""
        found = []
        for lines in self.sentences(text or ""):
            whole = " ".join(line for _, line in lines)
            cues = [m.span(1) for m in self.cue.finditer(whole)]
            if not cues:
                continue
            firsts, fitting, at = [a for a, _ in cues], [], 0
            sizes = [len(WORD.findall(line)) for _, line in lines]
            for a, (_, line) in enumerate(lines):
                n, end = 0, at - 1
                c = bisect_left(firsts, at)
                for b in range(a, len(lines)):
                    n, end = n + sizes[b], end + 1 + len(lines[b][1])
                    if c == len(cues) or n > self.longest:
                        break
                    if cues[c][1] <= end and (v := self.verdict(whole[at:end])):
                        fitting.append((v[2] / n, -n, a, b, v))
                at += len(line) + 1
            taken: set[int] = set()
            for _, _, a, b, v in sorted(fitting, key=lambda x: x[:4]):
                if taken.isdisjoint(range(a, b + 1)):
                    taken.update(range(a, b + 1))
                    name, reduction, n, edits = v
                    found.append({"sentence": lines[a][0], "license": name, "reduction": reduction, "n_different": n, "different": edits})
        return sorted(found, key=lambda x: x["sentence"])


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` plus ``notices``, an array of (sentence, license, reduction, n_different, different), in
    place of a column of that name. Texts without a
    licence word are not sent to Python."""
    kind = "array<struct<sentence:bigint,license:string,reduction:double,n_different:bigint,different:array<string>>>"
    texts = templates or TEMPLATES

    def make():
        scanner = Scanner(texts)
        shape = pa.list_(pa.struct([("sentence", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()),
                                    ("n_different", pa.int64()), ("different", pa.list_(pa.string()))]))
        return lambda values: [pa.array([scanner.scan(v) for v in values], shape)]

    docs = docs.drop("notices")
    cued = F.when(F.col(text).rlike(CUES), F.col(text))
    adds = T.StructType([T.StructField("notices", T.DataType.fromDDL(kind))])
    name = fresh(docs, "_cued")
    found = map_rows(docs.withColumn(name, cued), [name], docs.columns, adds, make)
    return found


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its notices, the distinct licences in the order of their names, and the differing words."""
    found = scan(docs.select(key, text), text).withColumn("licenses", F.array_sort(F.array_distinct("notices.license")))
    return found.select(
        key,
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join("licenses", ",").alias("licenses"),
        F.aggregate("notices.n_different", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_different"),
        F.round(F.array_max("notices.reduction"), 6).alias("best_reduction"),
    )
