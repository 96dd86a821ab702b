"""License scans in DataFrame functions only.

The units of a file are its lines, its paragraphs, its runs of comment lines, its whole text and, if
asked for, the sentences of lines and paragraphs. Each is a possible licence header, compared with
header templates; a file with the name of a licence file is compared with full licence texts too,
which decide before its units do. All are sparse TF-IDF vectors over tokens, compared by cosine; a
token that no template has only lengthens the vector. Files without a header of their own inherit from
the nearest ancestor directory that has a licence file, found by joins on path prefixes. A licence
file is one with such a name, or whose whole text is a header.

Weights: ``(1 + ln n) * idf(t)`` for a token that is there ``n`` times, ``idf(t) = ln((1 + N) / (1 + df(t))) + 1`` over the N templates, which are the fixed corpus
of the vectoriser; a token that no template has gets the largest idf. A unit can reach the threshold
only if it has one of some tokens of the template, the rest of whose vector is too short for it; one
pattern of those tokens picks the units that can, and of these a bound on the cosine by the tokens
that templates have picks those that are compared, both without loss.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import literal_rows

_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


def _gnu(name: str, version: str, short: str) -> tuple[str, ...]:
    """Usual headers of the GNU licences, which differ by name and version."""
    terms = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name}"
    granted = f"{terms} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return (
        f"Licensed under the {name}, version {version}.",
        f"This work is licensed under the {name}, version {version}.",
        f"{terms}, version {version}.",
        f"{terms} version {version} as published by the Free Software Foundation.",
        granted,
        f"{granted} {_WARRANTY.format(name=name)}",
        *(f"SPDX-License-Identifier: {short}{x}" for x in ("", "-only", "-or-later")),
    )


#: Usual headers by licence identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This software is released under the MIT License, see LICENSE for details.",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-2.0": _gnu("GNU General Public License", "2", "GPL-2.0"),
    "GPL-3.0": _gnu("GNU General Public License", "3", "GPL-3.0"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "LGPL-2.1"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "LGPL-3.0"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "AGPL-3.0"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
#: Words that prose is full of are the last to be called necessary; that saves work and changes no result.
EVERYDAY = frozenset("a all an and any are as at be but by for from have if in into is it may more no not of on one only or other out should some such that the their this to under was were will with without you your".split())
THRESHOLD = 0.7
TOKEN = "[a-z0-9]+"
#: Names of licence files.
FILE_NAMES = "(?i)^(licen[cs]e|copying|notice|unlicense)(\\.[a-z]+)?$"
#: Runs of lines that begin as comments do.
COMMENTS = "(?m)(?:^[ \\t]*(?:#|//|/\\*|\\*|--|;|%|<!--)[^\n]*(?:\n|\\z))+"


@cache
def full_texts() -> dict[str, tuple[str, ...]]:
    """The full texts by licence identifier. That of the AGPL is the GPL's by the other name: they differ in few places."""
    found = {x.name.removesuffix(".txt"): (x.read_text(encoding="utf-8"),) for x in (resources("plumbline.llm") / "license_texts").iterdir() if x.name.endswith(".txt")}
    return found | {"AGPL-3.0": (re.sub(r"(?i)(GNU)(\s+General Public)", r"\1 Affero\2", found["GPL-3.0"][0]),)}


def _vectors(templates: dict[str, tuple[str, ...]]) -> tuple[list[tuple[int, str, str, float]], float, list[str]]:
    """(template rows: number, licence, token, weight of length 1), idf of unknown tokens, necessary tokens."""
    texts = [(name, Counter(re.findall(TOKEN, text.lower()))) for name, ts in templates.items() for text in ts]
    df = Counter(t for _, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    rows, necessary = [], set()
    for k, (name, c) in enumerate(texts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        weights = sorted(((x / norm, t) for t, x in raw.items()), reverse=True)
        rows += [(k, name, t, w) for w, t in weights]
        # tokens that together stay below the threshold may be missed; one of the others must be there.
        # Short and everyday ones are the first to be missed
        left = 1.0
        for _, w, t in sorted(((2 * (t in EVERYDAY) or len(t) < 3, -w, t) for w, t in weights)):
            if left < THRESHOLD**2 - 1e-9:
                break
            necessary.add(t)
            left -= w * w
    return rows, math.log(1 + len(texts)) + 1, sorted(necessary)


def _any_of(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that a place of a text is tried once a letter, not once a word."""
    rest: dict[str, list[str]] = {}
    for w in sorted(words):
        rest.setdefault(w[:1], []).append(w[1:])
    ends = "?" if rest.pop("", None) else ""
    branches = [first + (_any_of(more) if more != [""] else "") for first, more in rest.items()]
    return f"(?:{'|'.join(branches)}){ends}" if branches else ""


def _possible(tokens: str, templates: dict[str, tuple[str, ...]]) -> Column:
    """Whether a unit can reach the threshold: what no template has only lengthens its vector.

    The known part of the vector bounds the cosine by ``|known| / |all|``, and each token that no
    template has lengthens the vector by its idf at least.
    """
    rows, unknown, _ = _vectors(templates)
    idf = {t: math.log((1 + len({k for k, *_ in rows})) / (1 + n)) + 1 for t, n in Counter(t for _, _, t, _ in rows).items()}
    weights = F.create_map(*(F.lit(x) for pair in sorted(idf.items()) for x in pair))
    known = F.filter(tokens, lambda t: t.isin(*sorted(idf)))
    own = F.transform(F.array_distinct(known), lambda t: F.pow((1 + F.log(F.size(F.filter(known, lambda x: x == t)))) * weights[t], F.lit(2.0)))
    own = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return own >= (THRESHOLD - 1e-5) ** 2 * (own + unknown**2 * F.size(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*sorted(idf))))))


def _best(units: DataFrame, spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """``path, unit, tokens`` to ``path, license, cosine, all_of_it``: the best template of any unit of a file, if it
    reaches the threshold, and whether the unit ``whole`` does."""
    rows, unknown, _ = _vectors(templates)
    table = literal_rows(spark, rows, "tpl int, license string, token string, w double")  # a few hundred rows, fixed
    idf_of = {}
    texts = len({k for k, *_ in rows})
    df = Counter(t for _, _, t, _ in rows)
    for t, n in df.items():
        idf_of[t] = math.log((1 + texts) / (1 + n)) + 1
    idf = literal_rows(spark, list(idf_of.items()), "token string, idf double")
    counts = units.select("path", "unit", F.explode("tokens").alias("token")).groupBy("path", "unit", "token").agg(F.count("*").alias("n"))
    weighted = counts.join(F.broadcast(idf), "token", "left").withColumn("x", (1 + F.log("n")) * F.coalesce("idf", F.lit(unknown)))
    norms = weighted.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.where("idf is not null").join(F.broadcast(table), "token").groupBy("path", "unit", "tpl", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scores = dots.join(norms, ["path", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= THRESHOLD)
    # the highest cosine, of equal ones the licence whose name is first
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    top = scores.groupBy("path").agg(first.alias("top"), F.max(F.col("unit") == "whole").alias("all_of_it"))
    return top.select("path", F.col("top.license").alias("license"), (-F.col("top.c")).alias("cosine"), "all_of_it")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, sentences: bool = False) -> DataFrame:
    """``path, text`` to ``path, own_license, own_cosine, license, source, from_dir``.

    ``own_license`` is that of a licence file's whole text, if that reaches the threshold, else of the
    file's best unit, with sentences among them if ``sentences``; ``source`` is ``header`` (own),
    ``directory`` (inherited from ``from_dir``, the nearest ancestor with a licence file) or ``none``.
    Of templates with equal cosines the licence whose name is first counts; several licence files of a
    directory count by their highest cosine, then by name. A null or empty text has no units; texts
    of any length are read whole; rows with a null path have only their own header; rows that repeat
    a path are one file whose units are taken together, and appear as often as they are given; further
    columns are ignored; an empty table gives an empty result.
    """
    spark = files.sparkSession
    _, _, necessary = _vectors(templates)
    keyed = files.select(F.col("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce(F.concat(F.lit("p:"), "path"), F.concat(F.lit("t:"), F.sha2("text", 256))))
    pattern = F.lit("(?<![a-z0-9])" + _any_of(necessary) + "(?![a-z0-9])")
    could = lambda c: F.rlike(F.lower(c), pattern)
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    possible = keyed.where(could("text"))
    pieces = lambda c, separator: F.filter(F.split(c, separator), could)
    parts = F.concat(pieces(F.col("text"), "\n"), pieces(F.col("text"), "\n[^A-Za-z0-9\n]*\n"), F.filter(F.regexp_extract_all("text", F.lit(COMMENTS), F.lit(0)), could))
    if sentences:
        parts = F.concat(parts, F.flatten(F.transform(parts, lambda x: pieces(x, "(?<=[.!?])\\s+"))))
    units = possible.select(F.col("key").alias("path"), F.explode(F.array_distinct(F.concat(parts, F.array("text")))).alias("unit"), F.col("text"))
    units = units.select("path", F.when(F.col("unit") == F.col("text"), "whole").otherwise(F.hex(F.xxhash64("unit"))).alias("unit"), tokens("unit").alias("tokens")).where(_possible("tokens", templates))
    units = units.dropDuplicates(["path", "unit", "tokens"])
    named = F.coalesce(F.rlike(F.substring_index("path", "/", -1), F.lit(FILE_NAMES)), F.lit(False))
    texts = keyed.where(named).select(F.col("key").alias("path"), F.xxhash64("text").cast("string").alias("unit"), tokens("text").alias("tokens"))
    whole = _best(texts, spark, full_texts()).select("path", F.col("license").alias("whole"), F.col("cosine").alias("whole_cosine"))
    found = _best(units, spark, templates).join(whole, "path", "full")
    own = found.select(F.col("path").alias("key"), F.coalesce("whole", "license").alias("own_license"), F.coalesce("whole_cosine", "cosine").alias("own_cosine"), "all_of_it")
    parent = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    licence_files = keyed.where("path is not null").select("key", "path", named.alias("named")).distinct().join(own, "key").where("named or all_of_it").select(parent(F.col("path")).alias("dir"), "own_license", "own_cosine")
    best = licence_files.groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("l"))).alias("b")).select("dir", F.col("b.l").alias("dir_license"))
    # directories once each, however many files they have; then their ancestors, nearest last in length
    dirs = keyed.where("path is not null").select(parent(F.col("path")).alias("leaf")).distinct()
    parts = F.split("leaf", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    lifted = dirs.select("leaf", F.explode(F.array_distinct(ancestors)).alias("dir")).join(best, "dir")
    nearest = lifted.groupBy("leaf").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license")).alias("m")).select("leaf", F.col("m.dir").alias("from_dir"), F.col("m.dir_license").alias("dir_license"))
    result = keyed.select("path", "key", parent(F.col("path")).alias("leaf")).join(own, "key", "left").join(nearest, "leaf", "left")
    return result.select(
        "path",
        "own_license",
        "own_cosine",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "directory").otherwise("none").alias("source"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, with ``doc_id``: ``source/lang/<thousands>/<hundreds>/<doc_id>.txt``; no path for a null id."""
    k = F.col("doc_id")
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    path = F.concat(known("source"), F.lit("/"), known("lang"), F.lit("/"), F.floor(k / 1000).cast("string"), F.lit("/"), F.floor(k / 100).cast("string"), F.lit("/"), k.cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "text")


def document_licenses(docs: DataFrame) -> DataFrame:
    """The scan of all documents, by ``doc_id``."""
    found = scan(document_files(docs), sentences=True)
    return found.select(F.regexp_extract("path", "([^/]*)[.]txt$", 1).try_cast("long").alias("doc_id"), *found.columns)
