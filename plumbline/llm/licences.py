"""Licence scans by sparse TF-IDF cosine and directory inheritance (operator 5), in DataFrame functions only.

Templates are whole licence texts and usual notices, SPDX lines among them. A word's inverse document frequency is that
among the templates, so a score does not depend on the table; words of no template weigh most. Files that hold one of MARKS
are cut into candidates for a header, marked paragraphs, lines and sentences, which are held against the notices; as a
whole they are held against the licence texts. Equal candidates are scored once. The cosine is a join of
candidates' words with the templates' and two sums. A file's licence is that of its best header, or that of the text it
is. A file that is, as a whole, like a licence text, or has a licence and is named as licence files are, is a licence file
of its directory; files without a licence of their own inherit from the nearest ancestor directory with one, found by joining
directories, not files, to the ancestors of directories.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import joined, staged

# Usual notices of licences. Whole licence texts are in the folder licence_texts, one file each.
NOTICES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "ISC": ["Licensed under the ISC License"],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3",
    ],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Licensed under the zlib License"],
}
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
#: What holds one of these may be a header; a text of at most SHORT words is also known by its first such paragraph.
MARKS = r"(?i)licen[cs]e|copyright|spdx|public domain|permission (is hereby|is|to use,) |redistribution and use"
SHORT = 400
#: Between paragraphs, and between sentences of a line.
BLANK, STOP = r"\n[^\p{L}\p{N}\n]*\n", r"[.;!?][ \t]+"
#: How licence files are named.
NAMED = r"(?i)^(un)?licen[cs]e|^copying|^notice"
#: Cosine from which a header has a notice's licence, and from which a file is a licence text.
HEADER, FILE = 0.6, 0.8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def templates() -> list[tuple[bool, str, Counter]]:
    """``(whole, licence, words)``: whole texts, and what headers are held against."""
    found = [(True, name, text) for name, text in TEXTS.items()]
    for name in sorted({*NOTICES, *TEXTS}):
        found += [(False, name, x) for x in [f"SPDX-License-Identifier: {name}", *NOTICES.get(name, ())]]
        if name in TEXTS and len(plain_words(TEXTS[name])) <= SHORT:
            grant = [p for p in re.split(r"\n[\W_]*?\n", TEXTS[name]) if re.search(MARKS, p) and len(plain_words(p)) >= 8]
            found += [(False, name, p) for p in grant[:1]]
    return [(whole, name, Counter(plain_words(text))) for whole, name, text in found]


def weights() -> tuple[dict[str, float], float, list[tuple[bool, int, str, str, float]]]:
    """Inverse document frequency of the templates' words and of all others, and ``(whole, number, licence, word, weight)``, each template's weights of length one."""
    found = templates()
    having = Counter(w for _, _, ws in found for w in ws)
    idf = {w: log((1 + len(found)) / (1 + n)) + 1 for w, n in having.items()}
    rows = []
    for number, (whole, name, ws) in enumerate(found):
        length = sqrt(sum((n * idf[w]) ** 2 for w, n in ws.items()))
        rows += [(whole, number, name, w, n * idf[w] / length) for w, n in sorted(ws.items())]
    return idf, log(1 + len(found)) + 1, rows


def _units(marked: DataFrame) -> DataFrame:
    """``(key, whole, unit)``: each marked file's candidates for a header, and the file as a whole."""
    kept = lambda xs: F.filter(xs, lambda x: x.rlike(MARKS))
    lines = kept(F.split("text", "\n"))
    sentences = kept(F.flatten(F.transform(lines, lambda x: F.split(x, STOP))))
    parts = F.array_distinct(F.concat(kept(F.split("text", BLANK)), lines, sentences))
    one = lambda x, whole: F.struct(F.lit(whole).alias("whole"), x.alias("unit"))
    return marked.select("key", F.inline(F.concat(F.transform(parts, lambda x: one(x, False)), F.array(one(F.col("text"), True)))))


def _scored(spark: SparkSession, units: DataFrame) -> DataFrame:
    """``(whole, digest, score, licence)``: the template most like each distinct unit; ties to the smaller name. Units without a word of a template have none."""
    idf, other, rows = weights()
    of_word = F.broadcast(spark.createDataFrame(sorted(idf.items()), "w string, idf double"))  # as many rows as templates have words
    vectors = F.broadcast(spark.createDataFrame(rows, "whole boolean, number int, licence string, w string, weight double"))
    counted = units.select("whole", F.md5("unit").alias("digest"), F.explode(words(F.col("unit"))).alias("w")).groupBy("whole", "digest", "w").agg(F.count("*").cast("double").alias("tf"))
    weighed = staged(counted.join(of_word, "w", "left").select("whole", "digest", "w", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x")), "weighed")
    norms = weighed.groupBy("whole", "digest").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(vectors, ["whole", "w"]).groupBy("whole", "digest", "number", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["whole", "digest"]).select("whole", "digest", "licence", (F.col("dot") / F.col("norm")).alias("score"))
    best = F.min(F.struct((-F.round("score", 12)).alias("minus"), "licence")).alias("best")
    return scores.groupBy("whole", "digest").agg(best).select("whole", "digest", (-F.col("best.minus")).alias("score"), "best.licence")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, licence, score, found, origin)`` of every row of ``files``.

    ``found`` is ``header``, ``text`` (the file is a licence text), ``inherited`` or null, in which case licence, score and
    origin are null too. A licence text goes before headers; else the best candidate of a file counts, ties to the smaller name.
    ``origin`` is the directory inherited from. A directory with several licence files has the licence of the best score; ties go
    to the smaller name. Null and empty texts have no licence and may inherit; texts of any length are looked at as a whole; a null
    path has no directory, so it inherits nothing. Rows that repeat a path are judged by themselves. An empty table gives an
    empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = files.select(F.col(path_col).cast("string").alias("path"), F.when(text.rlike(MARKS), text).alias("text"))
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", ""))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(NAMED), F.lit(False))
    key = F.when(F.col("text").isNotNull(), F.xxhash64("path", "text"))
    narrow = staged(cut.select("path", directory.alias("directory"), named.alias("named"), key.alias("key"), "text"), "files")
    marked = narrow.where("key is not null")
    units = _units(marked)
    scores = _scored(files.sparkSession, units.distinct().drop("key").distinct())
    good = scores.where(F.col("score") >= F.when(F.col("whole"), FILE).otherwise(HEADER))
    struct = F.struct((-F.col("score")).alias("minus"), "licence", "whole")
    best = F.coalesce(F.min(F.when(F.col("whole"), struct)), F.min(struct)).alias("own")
    of_key = units.select("key", "whole", F.md5("unit").alias("digest")).join(good, ["whole", "digest"]).groupBy("key").agg(best)
    rest = marked.select("path", "directory", "named", "key")
    is_file = F.col("own.whole") | (F.col("named") & F.col("own").isNotNull())
    with_own = staged(rest.join(of_key, "key", "left").select("path", "directory", "own", F.when(is_file, F.col("own")).alias("file")), "own")
    nothing = F.lit(None).cast(with_own.schema["own"].dataType).alias("own")
    rows = narrow.where("key is null").select("path", "directory", nothing).unionByName(with_own.select("path", "directory", "own"))
    return _inherited(rows, with_own.where("file is not null and directory is not null"))


def _inherited(rows: DataFrame, licensed: DataFrame) -> DataFrame:
    licensed = licensed.groupBy("directory").agg(F.min("file").alias("file")).select(F.col("directory").alias("ancestor"), "file")
    names = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    sizes = staged(rows.where("directory is not null").groupBy("directory").agg(F.count("*").alias("n")), "directories")
    ancestors = sizes.select("directory", F.explode(F.array_distinct(above)).alias("ancestor")).join(licensed, "ancestor", "left")
    near = F.max(F.when(F.col("file").isNotNull(), F.struct(F.length("ancestor").alias("n"), "ancestor", "file"))).alias("near")
    nearest = ancestors.groupBy("directory").agg(near)
    placed = joined(rows.where("directory is not null"), nearest, "directory", sizes)
    lost = rows.where("directory is null").withColumn("near", F.lit(None).cast(nearest.schema["near"].dataType))
    found = F.when(F.col("own.whole"), "text").when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited")
    return placed.unionByName(lost).select(
        "path",
        F.coalesce("own.licence", "near.file.licence").alias("licence"),
        (-F.coalesce("own.minus", "near.file.minus")).alias("score"),
        found.alias("found"),
        F.when(found == "inherited", F.col("near.ancestor")).alias("origin"),
    )
