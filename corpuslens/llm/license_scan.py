"""Licence notices in texts, with DataFrame functions only: MinHash bands over overlapping text windows retrieve templates,
exact containment of their shingles verifies them.

A text is a row of shingles (five words, lower case, without ASCII signs), each hashed once. Windows of WINDOW shingles
begin at every STEP-th one, so each overlaps the next by half; a window's MinHash under a permutation is the least of its
shingles' hashes under that permutation (an exclusive or with a fixed number), and a band is ROWS of them. Templates are
cut into windows at every shingle, so whatever place a passage begins at, some window of it has its like in the template:
with the Jaccard similarity J of the two, one band at least meets with a probability of 1 - (1 - J ** ROWS) ** BANDS: 1 for
an unchanged window, 0.999 at 0.75 and 0.97 at 0.6; and a notice has several windows. Templates of less than LEAST
shingles have no window of this size and are retrieved by any shingle (windows of one, whose MinHash is the shingle).

Retrieved pairs of a text and a template are verified on the whole text: the share of the template's shingles that a passage
of twice its length holds. The bands of all templates are a small table (some rows a template word) that is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of a shingle; share of a template's shingles that a passage must hold.
SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of a window, and between the beginnings of two; bands and rows of a band.
WINDOW, STEP, BANDS, ROWS = 8, 4, 8, 2
#: Shingles that a template needs for windows: so many that one beginning at a STEP lies within it, and one change too.
LEAST = WINDOW + STEP + SHINGLE
_SIGNS = r"[\x00-/:-@\[-`{-\x7F]+"

#: Texts with a notice that are broadcast at most (some 60 bytes each).
BROADCAST_ROWS = 100_000

#: Notices by licence: fixed texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
}


def _masks() -> list[int]:
    """A fixed number for each permutation."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(BANDS * ROWS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 63))
    return out


def _words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SIGNS), "")


def _shingles(words: Column) -> Column:
    """The hashes of all shingles; null if there is none. Elements are taken one by one, as slice() copies the array."""
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - SHINGLE)
    hashed = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, hashed(w)))


def _windows(shingles: Column, step: int) -> Column:
    """(at, h0, h1, ...) of the windows that begin at every step-th shingle; null for what lies beyond the last one."""
    window = lambda s: lambda i: F.struct(i.alias("at"), *[F.get(s, i + j).alias(f"h{j}") for j in range(WINDOW)])
    return _let(shingles, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(step)), window(s)))


def _bands() -> list[Column]:
    """The hashes of the bands of a window whose shingles are columns; least() passes over what is null."""
    least = [F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(WINDOW)]) for m in _masks()]
    return [F.xxhash64(*least[b * ROWS : (b + 1) * ROWS], F.lit(2 + b)) for b in range(BANDS)]


def _let(value: Column, f) -> Column:
    """f(value), with value computed once: as a column of its own Catalyst would put it in wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _single(shingle: Column) -> Column:
    return F.xxhash64(shingle, F.lit(1))


def template_bands(spark, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(key, license) for every band of every window of the templates, and (license, m, shingles): their distinct shingles.
    Templates of fewer words than a shingle are left out. Both are collected and made again: as small as the templates."""
    texts = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", _shingles(_words_of(F.col("text"))).alias("s")).where("s IS NOT NULL")
    starts = texts.select("license", F.size("s").alias("m"), F.inline(_windows(F.col("s"), 1)))
    keys = F.when(F.col("m") < LEAST, F.array(_single(F.col("h0")))).when(F.col("at") <= F.col("m") - WINDOW, F.array(*_bands()))
    bands = starts.select("license", F.explode(keys).alias("key")).distinct().collect()
    shingles = [(r["license"], len(r["s"]), r["s"]) for r in texts.select("license", F.array_distinct("s").alias("s")).collect()]
    return (
        spark.createDataFrame(sorted((r["key"], r["license"]) for r in bands), "key long, license string"),
        spark.createDataFrame(sorted(shingles), "license string, m int, shingles array<long>"),
    )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, at): the licences whose notice a text holds, the share of the notice's distinct
    shingles in the best passage (as many shingles as twice the notice's, from one of its shingles on), and the number of
    the word at which the first passage with a share of `containment` begins.

    Defined cases: null, empty and short texts hold nothing; equal rows give equal rows, each its own; a null id is kept as
    null; very long texts are scanned whole; of notices that contain one another a text may hold several; other columns
    are not looked at. Templates are few: their bands are broadcast."""
    spark = df.sparkSession
    bands, known = template_bands(spark, templates)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    # a row for every window, then for every band, made, looked up and dropped again within one stage. Rows of windows carry
    # their own shingles only: with the text's they would copy the whole array each. The explosions are outer ones since the
    # filter that Catalyst derives from an inner one would make all it explodes a second time. The higher-order function
    # keeps the projection of the bands outside the generated stage: there Catalyst cuts it into small methods, within it
    # one method would grow beyond the size that the JVM compiles
    windows = texts.select("doc_id", "key", _windows(_shingles(_words_of(F.col("text"))), STEP).alias("ws"))
    windows = windows.select("doc_id", "key", F.inline_outer("ws"))
    singles = F.transform(F.array(*[F.col(f"h{j}") for j in range(STEP)]), _single)
    banded = windows.select("doc_id", "key", singles.alias("singles"), F.array(*_bands()).alias("bands"))
    keyed = banded.select("doc_id", "key", F.explode_outer(F.concat("singles", "bands")).alias("band"))
    found = keyed.join(F.broadcast(bands.withColumnRenamed("key", "band")), "band").select("doc_id", "key", "license").distinct()
    found = materialise(found.groupBy("doc_id", "key").agg(F.collect_set("license").alias("licenses")))  # of few templates
    # back to the texts: few hold a notice, as a rule, and then go to all; if many do, both sides are dealt out
    hint = F.broadcast if found.count() <= BROADCAST_ROWS else lambda x: x
    holds = texts.alias("t").join(hint(found).alias("f"), F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.key") == F.col("f.key")))
    pairs = holds.select("t.doc_id", _shingles(_words_of(F.col("text"))).alias("s"), F.explode("licenses").alias("license")).join(F.broadcast(known), "license")
    # the passages: from every shingle of the template's on
    places = F.filter(F.transform("s", lambda h, i: F.when(F.array_contains("shingles", h), F.struct(i.alias("i"), h.alias("h")))), lambda x: x.isNotNull())
    # a passage holds 2 * m places at most: those from one on, taken singly, so that the work is linear in the places
    ahead = lambda p, j: F.transform(F.sequence(j, F.least(j + 2 * F.col("m"), F.size(p)) - 1), lambda k: F.get(p, k))
    inside = lambda p, x, j: F.filter(ahead(p, j), lambda y: y["i"] < x["i"] + 2 * F.col("m"))
    share = lambda p, x, j: F.size(F.array_distinct(F.transform(inside(p, x, j), lambda y: y["h"]))) / F.col("m")
    shares = _let(places, lambda p: F.transform(p, lambda x, j: F.struct(share(p, x, j).alias("share"), x["i"].alias("i"))))
    best = _let(shares, lambda p: F.struct(F.array_max(F.transform(p, lambda x: x["share"])).alias("containment"), F.array_min(F.transform(F.filter(p, lambda x: x["share"] >= containment), lambda x: x["i"])).cast("long").alias("at")))
    passing = pairs.select("doc_id", "license", F.explode(F.filter(F.array(best), lambda r: r["containment"] >= containment)).alias("r"))
    return passing.select("doc_id", "license", "r.containment", "r.at")


def scan_sql(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The definition of the result in SQL: every text against every template, without retrieval."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    words = lambda c: f"list_filter(string_split_regex(lower({c}), '{_SIGNS}'), lambda w: w <> '')"
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(SHINGLE))
    rows = lambda table, columns: f"SELECT {columns}, i - 1 AS i, {shingle} AS g FROM (SELECT {columns}, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM {table})"
    sql = f"""
WITH t AS (SELECT license, {words("text")} AS w FROM (VALUES {quoted}) v(license, text)),
notices AS MATERIALIZED (SELECT DISTINCT license, g FROM ({rows("t", "license")})),
sizes AS (SELECT license, count(*) AS m FROM notices GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
hits AS MATERIALIZED (SELECT r, doc_id, license, i, g FROM ({rows("d", "r, doc_id")}) JOIN notices USING (g)),
shares AS (SELECT a.r, a.doc_id, a.license, a.i, count(DISTINCT b.g) / any_value(m) AS share FROM hits a JOIN sizes USING (license)
  JOIN hits b ON b.r = a.r AND b.license = a.license AND b.i >= a.i AND b.i < a.i + 2 * m GROUP BY ALL)
SELECT any_value(doc_id)::BIGINT AS doc_id, license, max(share) AS containment, (min(i) FILTER (share >= {containment}))::BIGINT AS "at" FROM shares GROUP BY r, license HAVING max(share) >= {containment}"""
    return re.sub(r"\n\s*", " ", sql).strip()
