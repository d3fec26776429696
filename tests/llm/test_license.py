from __future__ import annotations

import math
import random
import re
from collections import Counter

from tickloom.llm import license as lc

FILES = [
    (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/x", "code only"), (3, "a/b/c/y", None), (4, "a/b/c/z", "long text " * 40 + "\nLicensed under the Apache License, Version 2.0."),
    (5, "a/d", "text"), (6, "a/LICENSE", "All rights reserved."), (7, "e/f", "a license of sorts, nothing more to see here"), (8, "top", ""), (9, None, "All rights reserved."),
    (10, "g/1", "Licensed under CC BY-NC 4.0."), (11, "g/2", "Released under the MIT License."), (12, "g/3", "Released under the MIT License."), (13, "g/q", "x"), (13, "g/q", "x"),
    (14, "h/i", "word " * 3000 + "licensed " * 50 + "word " * 3000),
]


def frame(spark, rows=FILES):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, path string, text string, license string, score int")


def test_scan(spark):
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"]) for r in lc.scan(frame(spark)).collect()}
    assert got[1] == ("MIT", "file", None)
    assert got[2] == ("MIT", "inherited", "a/b") and got[3] == ("MIT", "inherited", "a/b")
    assert got[4] == ("Apache-2.0", "own", None)
    assert got[5] == ("Proprietary", "inherited", "a")
    assert got[7] == (None, "none", None) and got[8] == (None, "none", None) and got[14] == (None, "none", None)
    assert got[9][0] == "Proprietary" and got[10][0] == "CC-BY-NC-4.0"
    assert got[13] == ("MIT", "inherited", "g")  # two files against one
    assert lc.scan(frame(spark)).count() == len(FILES)
    assert lc.scan(frame(spark, [])).count() == 0


TEXTS = {
    "MIT": """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "BSD-3-Clause": """Copyright 2019 The Example Authors. All rights are theirs.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.""",
    "Apache-2.0": """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
print(os.name)""",
    "GPL-3.0": """/* This program is free software: you can redistribute it and/or modify
   it under the terms of the GNU General Public License as published by
   the Free Software Foundation, either version 3 of the License, or
   (at your option) any later version. */

int main(void) { return 0; }""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
}


def test_bodies_and_headers(spark, small_texts):
    """Whole texts and headers without the name of the licence, among plain documents."""
    rows = [(10**6 + i, f"x{i}/LICENSE", t) for i, t in enumerate(TEXTS.values())]
    plain = [(d, f"plain/{d}", t) for d, t in sorted(small_texts.items())[:60]] + [(3 * 10**6, "y/long", "word of the text " * 30_000)]
    got = {r["doc_id"]: r for r in lc.scan(frame(spark, rows + plain)).collect()}
    assert [got[10**6 + i]["license"] for i in range(len(TEXTS))] == list(TEXTS)
    assert got[10**6]["how"] == "file" and got[10**6 + 1]["how"] == "file"
    assert got[3 * 10**6]["how"] == "none"


def brute(files):
    """Every unit against every template, with dictionaries."""
    terms = lambda x: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower())
    texts = {n: [*lc.TEMPLATES[n], *lc.WHOLE.get(n, [])] for n in sorted(lc.TEMPLATES)}
    vocabulary = {t for x in texts.values() for s in x for t in terms(s)}
    df = Counter(t for _, _, x in files for t in set(terms(x or "")) & vocabulary)
    idf = lambda t: math.log((len(files) + 1) / (min(df[t] if t in vocabulary else 1, len(files)) + 1)) + 1
    vector = lambda x: {t: (1 + math.log(k)) * idf(t) for t, k in Counter(terms(x)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for d, _, text in files:
        statement = r"\n|(?<=[.;!?])[ \t]"
        paragraphs = re.split(r"\n[ \t]*(?:\n[ \t]*)+", text or "")
        for u in [*re.split(statement, text or ""), *(p for p in paragraphs if re.search(statement, p)), text or ""]:
            a = vector(u)
            for place, name in enumerate(texts):
                for x in texts[name]:
                    b = vector(x)
                    score = round(sum(w * b.get(t, 0) for t, w in a.items()) / (length(a) * length(b)), 9) if a else 0
                    if score >= 0.75 and (score, -place) > out.get(d, (0, 0))[:2]:
                        out[d] = (score, -place, name)
    return {d: (name, round(s, 6)) for d, (s, _, name) in out.items()}


def test_scores_equal_brute_force(spark):
    files = FILES + [(100 + i, f"t/{i}", t) for i, t in enumerate(TEXTS.values())] + [(200, "u/1", "the software is provided as is\n\nto any person. free of charge"), (201, "u/2", "CC BY 4.0 license. 2.0.1 v.2 .5 a.b")]
    got = {r["doc_id"]: (r["license"], r["score"]) for r in lc.scan(frame(spark, files)).where("how in ('own', 'file')").collect()}
    want = brute(files)
    assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()}
    assert all(abs(got[d][1] - s) < 2e-6 for d, (_, s) in want.items())


def test_units_that_are_passed_over_could_not_match():
    """A unit without any needed term stays under the threshold, whatever else it holds."""
    rng = random.Random(4)
    idf = {t: 1 + rng.random() * 6 for _, terms in lc.templates() for t in terms}
    vectors = lc.weighted(idf)
    gate = lc.needed(vectors, idf)
    for v in vectors:
        rest = {t: x for t, x in v.items() if t not in gate}
        assert math.sqrt(sum(x * x for x in rest.values())) < lc.THRESHOLD  # the best cosine that rest can reach


def test_equal_scores(spark):
    """The same statement in two templates' words: the first of the alphabet; votes of a directory likewise."""
    rows = [(1, "a/1", "All rights reserved."), (2, "a/2", "Released under the MIT License."), (3, "a/b/3", "plain")]
    got = {r["doc_id"]: (r["license"], r["how"]) for r in lc.scan(frame(spark, rows)).collect()}
    assert got[3] == ("MIT", "inherited")  # one file each


def test_query_finds_every_licence_line(spark, small, small_texts):
    got = {r["doc_id"]: r for r in lc.op7_license_scan(spark, small).collect()}
    marks = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC-4.0", "GNU General": "GPL-3.0", "All rights reserved": "Proprietary"}
    for d, t in small_texts.items():
        want = {v for k, v in marks.items() if k in t}
        assert (got[d]["how"] in ("own", "file")) == bool(want)
        if want:
            assert got[d]["license"] in want
