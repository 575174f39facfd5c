"""License notices: every template is found, other wordings are not."""

import pytest

from itemnorm.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def test_every_passage_names_its_license(scanner):
    for name, text in licenses.TEMPLATES.items():
        found = scanner.scan("Some words before.\n" + text + "\nand after")
        assert found and {f["license"] for f in found} <= {name} | ({"GPL-3.0"} if name == "GPL-2.0" else set()), name


def test_small_differences_and_other_versions(scanner):
    one = scanner.scan("This work is now licensed under the GNU General Public License, version 3.")
    assert one[0]["license"] == "GPL-3.0" and one[0]["different"] == ["+now"]
    assert scanner.scan("Licensed under the Apache License, Version 1.1.") == []
    assert scanner.scan("Licensed under CC BY-ND 4.0.") == []
    assert scanner.scan("His license to drive was lost in the mail.") == []


def test_plain_search_on_the_table(spark):
    plain = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "All-rights-reserved"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.licenses for r in licenses.report(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == ",".join(sorted({n for line, n in plain.items() if line in r.text.split("\n")}))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "w " * 50_000 + "\nReleased under the MIT License.", "z"), (2, "license " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string")
    got = [(r.doc_id, [n.license for n in r.notices]) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (1, []), (None, ["MIT"]), (2, [])], key=str)
    assert licenses.report(df.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "REM ", "dnl "])
@pytest.mark.parametrize("name, text, n", [("Apache-2.0", APACHE, 4), ("MIT", MIT, 2), ("BSD-3-Clause", BSD, 3), ("GPL-3.0", GPL, 2)])
def test_wrapped_notices(scanner, name, text, n, mark):
    marked = "\n".join(mark + line for line in text.split("\n"))
    for before, after in (("", ""), ("Copyright 2020 The Authors\n\n", "\n\nimport os\n"), ("prose without an end\n", "\nand more")):
        found = scanner.scan(before + marked + after)
        assert [f["license"] for f in found] == [name] * n
        # a sentence ends at the colon in "This program is free software:"
        assert {e for f in found for e in f["different"]} <= {"-this", "-program", "-is", "-free", "-software"}


def test_cue_over_a_line_break(spark):
    rows = [(1, "x\nAll rights\nreserved."), (2, "// All rights\n// reserved."), (3, "REM All rights\nREM reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.report(df).collect()} == dict.fromkeys((1, 2, 3), "All-rights-reserved")


@pytest.mark.parametrize("text, name", [
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
    ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("x\nSPDX-License-Identifier: BSD-2-Clause\ny", "BSD-2-Clause"),
    ("the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the\n"
     "warranties of merchantability, fitness for a particular purpose and noninfringement.", "MIT"),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, "
     "provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
])
def test_short_and_other_notices(scanner, text, name):
    assert [f["license"] for f in scanner.scan(text)] == [name]


def test_other_identifiers_are_not_taken_for_known_ones(scanner):
    for text in ("SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: GPL-1.0-only", "SPDX-License-Identifier: MIT-0"):
        assert scanner.scan(text) == []


def test_compression_decides_who_is_compared(scanner, monkeypatch):
    """What no dictionary makes smaller is not confirmed, and of two that fit the one that saves more is taken."""
    line = "Released under the MIT License."
    assert scanner.ranked(line)[0][1] == "MIT" and scanner.judge(line)[0] == "MIT"
    order = scanner.ranked(line)
    monkeypatch.setattr(scanner, "ranked", lambda block: [(licenses.REDUCTION / 2, n) for _, n in order])
    assert scanner.judge(line) is None
    short = "Same words for both of these made-up licences."
    two = licenses.Scanner({"A": "Other words here.\n" + short.replace("made-up", "invented"), "B": short})
    assert two.judge(short)[0] == "B"


def test_no_place_in_the_ranking_is_too_low():
    """Every template that saves enough is compared until one is confirmed."""
    line = "This licence text is granted to all readers of the eighth edition, number 8."
    near = {f"L{i}": line.replace("number 8", f"number {i}") for i in range(8)}
    assert licenses.Scanner({**near, "right": line}).judge(line)[0] == "right"
    low = licenses.Scanner({**{f"L{i}": line.replace("number 8", f"number {i}") for i in (1, 2, 3, 4)}, "right": "Intro words.\n" + line.replace("readers", "users")})
    assert low.judge(line)[0] == "right"
