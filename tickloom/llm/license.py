"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame
functions only.

Units of every whole text are compared with every template: its statements (lines, and sentences within them), its
paragraphs with line breaks joined (so the header of a file is one unit), and the whole text (a licence file). A term
weighs (1 + ln tf) * idf, tf within the unit, idf from the number of documents that hold the term, counted over all of
them; a term that no template has weighs as one that one document holds. The best template from THRESHOLD on is the
document's licence.

No text is left out by a list of words. A unit can only reach the threshold if it shares terms that make up THRESHOLD^2
of a template's squared norm (Cauchy-Schwarz), so it must hold at least one of the template's rarest terms that make up
the rest: units without any of these are passed over, which changes no result.

A document whose whole text matches, or of which matching statements make up FILE_SHARE of the words, is a licence file
and licenses its directory. A document without a licence of its own takes the one of its nearest ancestor directory that
has one: directories, not documents, are joined with their ancestors.

Defined results: null text counts as empty and null path parts are left out of a path; repeated rows give repeated
results; null ids stay null; among equal scores (to nine places) the template that comes first in the alphabet wins, and
in a directory the licence of most licence files, then of the alphabet; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

# Short licence statements by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["licensed under the apache license, version 2.0", "spdx-license-identifier: apache-2.0"],
    "BSD-2-Clause": ["licensed under the bsd 2-clause license", "spdx-license-identifier: bsd-2-clause"],
    "BSD-3-Clause": ["licensed under the bsd 3-clause license", "spdx-license-identifier: bsd-3-clause"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC0-1.0": ["released under cc0 1.0", "this work is dedicated to the public domain under cc0 1.0 universal"],
    "GPL-2.0": ["this work is licensed under the gnu general public license, version 2", "spdx-license-identifier: gpl-2.0"],
    "GPL-3.0": ["this work is licensed under the gnu general public license, version 3", "spdx-license-identifier: gpl-3.0"],
    "ISC": ["released under the isc license", "spdx-license-identifier: isc"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license, version 3", "spdx-license-identifier: lgpl-3.0"],
    "MIT": ["released under the mit license", "licensed under the mit license", "spdx-license-identifier: mit"],
    "MPL-2.0": ["licensed under the mozilla public license, version 2.0", "spdx-license-identifier: mpl-2.0"],
    "Proprietary": ["all rights reserved"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}
# Notices and whole texts, by SPDX name.
_WARRANTY = (
    'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the '
    "author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence "
    "or other tortious action, arising out of or in connection with the use or performance of this software."
)
_BSD = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and '
    "fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential "
    "damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_MIT = (
    'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished "
    "to do so, subject to the following conditions: "
)
_MIT_REST = (
    'the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided "as is", without warranty of any kind, '
    "express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be "
    "liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in "
    "the software."
)
_ISC = "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_APACHE = (
    'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at '
    "http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without "
    "warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."
)
_APACHE_TOP = (
    "apache license version 2.0, january 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution 1. definitions. \"license\" shall mean the terms and "
    "conditions for use, reproduction, and distribution as defined by sections 1 through 9 of this document."
)
_GNU = (
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu {0}general public license as published by the free software foundation, either version {1} of "
    "the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability "
    "or fitness for a particular purpose. see the gnu {0}general public license for more details. you should have received a copy of the gnu {0}general public license along with this program."
)
_GNU_TOP = (
    "gnu {0}general public license version {1}, {2} copyright (c) free software foundation, inc. everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
)
_GNU_PREAMBLE = (
    "the gnu general public license is a free, copyleft license for software and other kinds of works. the licenses for most software and other practical works are designed to take away your freedom "
    "to share and change the works. by contrast, the gnu general public license is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free "
    "software for all its users."
)
_MPL = "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/."
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
    "a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_CC0 = (
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related "
    "and neighboring rights, to the extent allowed by law."
)
WHOLE = {
    "Apache-2.0": [_APACHE, _APACHE_TOP],
    "BSD-2-Clause": [_BSD, _BSD + _BSD_WARRANTY],
    "BSD-3-Clause": [_BSD + _BSD_THIRD, _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_WARRANTY],
    "CC0-1.0": [_CC0],
    "GPL-2.0": [_GNU.format("", "2"), _GNU_TOP.format("", "2", "june 1991")],
    "GPL-3.0": [_GNU.format("", "3"), _GNU_TOP.format("", "3", "29 june 2007"), _GNU_PREAMBLE],
    "ISC": [_ISC, _ISC + _WARRANTY],
    "LGPL-3.0": [_GNU.format("lesser ", "3"), _GNU_TOP.format("lesser ", "3", "29 june 2007")],
    "MIT": [_MIT, _MIT_REST, _MIT + _MIT_REST],
    "MPL-2.0": [_MPL],
    "Unlicense": [_UNLICENSE],
}
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.75
FILE_SHARE = 0.1


def templates() -> list[tuple[str, dict[str, int]]]:
    """Names, in order of the alphabet, with the terms of their texts and how often each occurs."""
    return [(name, dict(Counter(re.findall(TERM, x)))) for name in sorted(TEMPLATES) for x in [*TEMPLATES[name], *WHOLE.get(name, [])]]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def rarity(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequency of every template term over all documents, and that of any other term."""
    vocabulary = sorted({t for _, terms in templates() for t in terms})
    mine = F.array_intersect(_terms(_text()), F.array(*map(F.lit, vocabulary)))
    count = {r["t"]: r["n"] for r in files.select(F.explode(mine).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    n = files.count()

    def idf(df: int) -> float:
        return math.log((n + 1) / (min(df, n) + 1)) + 1

    return {t: idf(count.get(t, 0)) for t in vocabulary}, idf(1)


def weighted(idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template as a vector of length one."""
    out = []
    for _, terms in templates():
        w = {t: (1 + math.log(k)) * idf[t] for t, k in terms.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def needed(vectors: list[dict[str, float]], idf: dict[str, float], threshold: float = THRESHOLD) -> set[str]:
    """Terms of which a unit must hold one to reach the threshold with any template: of each template its rarest terms,
    so many that what is left of its squared norm is under threshold^2."""
    out: set[str] = set()
    for vector in vectors:
        left = 1.0
        for t in sorted(vector, key=lambda t: (-idf[t], "." in t, t.isdigit(), t)):  # the gate sees terms with a dot by halves
            if left < threshold**2 - 1e-9:
                break
            out.add(t)
            left -= vector[t] ** 2
    return out


def _units(text: Column, holds) -> Column:
    """Array of (kind, words, terms): 0 for statements, 1 for paragraphs of several statements, 2 for the whole text."""

    def shaped(units: Column, kind: int) -> Column:
        return F.transform(
            F.filter(units, holds),
            lambda u: F.struct(F.lit(kind).alias("kind"), F.size(F.array_remove(F.split(u, r"[\x20\x09-\x0D]+"), "")).alias("words"), _terms(u).alias("terms")),
        )

    statement = r"\n|(?<=[.;!?])[\x20\x09]"
    paragraphs = F.split(text, r"\n[\x20\x09]*+(?:\n[\x20\x09]*+)++")
    several = F.filter(paragraphs, lambda p: p.rlike(statement))
    return F.concat(shaped(F.split(text, statement), 0), shaped(several, 1), shaped(F.array(text), 2))


def matches(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, kind, words, all_words, score, place, license): units of files and the best template of each, from THRESHOLD
    on; all_words: those of the whole file."""
    idf, other = rarity(files)
    vectors = weighted(idf)
    names = [name for name, _ in templates()]
    gate = F.array(*map(F.lit, sorted({re.split(r"\.", t)[0] for t in needed(vectors, idf)})))

    def holds(u: Column) -> Column:  # of terms with a dot, the part before it
        return F.arrays_overlap(F.split(F.lower(u), "[^a-z0-9]+"), gate)

    spark = files.sparkSession
    few = files.select(row_key().alias("key"), _text().alias("text")).where(holds(F.col("text"))).dropDuplicates(["key"])
    units = few.select("key", F.posexplode(_units(F.col("text"), holds)).alias("unit", "u")).select("key", "unit", "u.*")
    units = scratch.keep(units)
    tf = units.select("key", "unit", F.explode("terms").alias("t")).groupBy("key", "unit", "t").agg((1 + F.log(F.count("*"))).alias("w"))
    # both tables have as many rows as the templates have terms, some two thousand
    weights = spark.createDataFrame([(t, x) for t, x in idf.items()], "t string, idf double")
    table = spark.createDataFrame([(t, i, x) for i, v in enumerate(vectors) for t, x in v.items()], "t string, i int, x double")
    tf = scratch.keep(tf.join(F.broadcast(weights), "t", "left").select("key", "unit", "t", (F.col("w") * F.coalesce("idf", F.lit(other))).alias("w")))
    norms = tf.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(table), "t").groupBy("key", "unit", "i").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    rated = dots.join(norms, ["key", "unit"]).select("key", "unit", "i", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= THRESHOLD)
    best = rated.groupBy("key", "unit").agg(F.max(F.struct("score", (-F.col("i")).alias("place"))).alias("b"))
    name = F.get(F.array(*map(F.lit, names)), -F.col("b.place"))
    whole = units.where("kind = 2").select("key", F.col("words").alias("all_words"))
    both = best.join(units.select("key", "unit", "kind", "words"), ["key", "unit"]).join(whole, "key")
    return scratch.keep(both.select("key", "kind", "words", "all_words", "b.score", F.col("b.place").alias("place"), name.alias("license")))


def scan(files: DataFrame, path: str = "path") -> DataFrame:
    """files(doc_id, path, text) -> (doc_id, path, license, score, how, from_dir). how: own, file, inherited or none."""
    scratch = Scratch(files.sparkSession, "license")
    files = files.select("doc_id", F.col(path).alias("path"), "text")
    found = matches(files, scratch)
    statements = F.sum(F.when(F.col("kind") == 0, F.col("words")).otherwise(0))
    is_file = (F.max("kind") == 2) | (statements >= FILE_SHARE * F.greatest(F.max("all_words"), F.lit(1)))
    each = scratch.keep(found.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("score", "place", "license")).alias("best"), is_file.alias("is_file")))
    rows = files.select("doc_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), row_key().alias("key"))
    own = rows.join(each, F.col("key") == F.col("k"), "left").select("doc_id", "path", "dir", "best.license", "best.score", F.coalesce("is_file", F.lit(False)).alias("is_file"))
    own = scratch.keep(own)
    votes = own.where("is_file").groupBy("dir", "license").agg(F.count("*").alias("n"))
    licensed = scratch.keep(votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("x")).select(F.col("dir").alias("up"), F.col("x.license").alias("given")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = own.where("license is null").select("dir").where("dir <> ''").distinct().select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = dirs.join(licensed, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("x"))
    nearest = scratch.keep(nearest.select("dir", F.col("x.up").alias("up"), F.col("x.given").alias("given")))
    joined = own.join(nearest, "dir", "left")
    none = F.col("license").isNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "given").alias("license"),
        F.round(F.col("score"), 6).alias("score"),
        F.when(F.col("is_file"), "file").when(~none, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(none, F.col("up")).alias("from_dir"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents as a tree of files: source / language / thousands / hundreds / id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
