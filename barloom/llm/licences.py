"""Licences of files: TF-IDF cosine of headers to templates, then inheritance from the nearest directory.

A header is a paragraph that speaks of a licence - the lines of a comment block or a
tag joined - or a sentence of it, or the paragraph with the conditions that follow. Of
a licence file (by name) the whole text counts as well. Templates are short forms,
titles, standard notices and the texts of short licences. The
weights of words come from all headers of the table: how many of them hold each
word of the templates. That statistic has one number per template word, so it
travels as a literal, and each file is compared where it is read.

A directory has the licence that most of its own files with a header state. A
file without a header takes that of its directory or the nearest one above, by a
join of paths over distinct directories.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once
from barloom.llm.staging import staged

#: The words of licences. Short forms, titles and notices; several of one name are alternatives.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal, dedicated to the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright. All rights reserved"),
)
SPEAKS = r"(?i)(licen[sc]e|spdx|copyright|all rights reserved|governed by|hereby granted|public domain|creative commons|redistribution and use)"
#: Paragraphs that are compared as one where a licence begins: conditions and disclaimer follow its first words.
TOGETHER = 6
LICENCE_FILE = r"(?i)(^|/)(licen[sc]es?|copying|notice|copyright)([.\-_][^/]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)?"
#: Least cosine for a header to state a licence, and what a named version is worth among near ties.
LEAST, VERSION_LEAD = 0.6, 0.03
#: Directories of the inheritance table that may be broadcast (about 100 bytes each).
MAX_BROADCAST = 500_000


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def paragraphs(text: Column) -> Column:
    """The text without tags and comment signs, cut at empty lines; the lines of a paragraph are one."""
    body = F.coalesce(text, F.lit(""))
    flat = F.regexp_replace(body, r"(?i)</?(a|b|i|u|em|strong|span|code|tt|small|font|abbr)(\s[^<>]*)?>", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r"<[^<>]*>", "\n\n"), r"\r", "")
    flat = F.regexp_replace(flat, r"(?m)^[ \t]*(/\*+|\*+/?|//+|#+|;+|--+|%+|dnl\b|rem\b)", "")
    return F.split(flat, r"\n[ \t]*\n\s*")


def headers(text: Column, path: Column) -> Column:
    """What may state a licence, as lists of terms.

    Those are the paragraphs that speak of one and their sentences, each such
    paragraph with the next ones, and the whole text of a licence file.
    """
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    speaks = lambda x: F.rlike(x, F.lit(SPEAKS))

    def found(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: speaks(parts[k - 1]))
        together = F.transform(at, lambda k: F.array_join(F.slice(parts, k, F.lit(TOGETHER)), " "))
        alone = F.filter(parts, speaks)
        sentences = F.filter(F.flatten(F.transform(alone, lambda p: F.split(p, r"\.(?![0-9])|\n"))), speaks)
        return F.concat(alone, sentences, together)

    # The paragraphs are made once and named by a one-element transform.
    of_text = F.when(speaks(body), F.flatten(F.transform(F.array(paragraphs(text)), found))).otherwise(none)
    whole = F.when(F.rlike(F.coalesce(path, F.lit("")), F.lit(LICENCE_FILE)), F.array(body)).otherwise(none)
    terms = F.transform(F.concat(of_text, whole), lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({TERM})"), F.lit(1)))
    return F.array_distinct(F.filter(terms, lambda t: F.size(t) > 0))


def header_counts(with_headers: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many headers there are, and how many hold each word of the templates."""
    each = with_headers.where(F.size("headers") > 0).select(F.explode("headers").alias("terms"))
    words = F.array_distinct(F.array_append("terms", F.lit("")))
    held = each.select(F.explode(words).alias("term")).where(F.col("term").isin(["", *vocabulary]))
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def counted_terms(terms: str) -> str:
    """SQL: structs (t, n) of the distinct terms of an array and how often each stands there, by one sort."""
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[greatest(i - 1, 0)])"
    runs = "transform(b, (at, k) -> struct(s[at] AS t, IF(k + 1 < size(b), b[least(k + 1, size(b) - 1)], size(s)) - at AS n))"
    return f"transform(array(array_sort({terms})), s -> transform(array({starts}), b -> {runs})[0])[0]"


def _numbers(values: list[float]) -> str:
    """SQL of an array that is folded to one literal."""
    return "CAST(split('" + ",".join(f"{v:.12e}" for v in values) + "', ',') AS ARRAY<DOUBLE>)"


def versions_of(name: str) -> list[str]:
    """The terms under which a licence's version is written."""
    found = re.search(r"-(\d+)\.(\d+)$", name)
    return [] if not found else [f"{found[1]}.{found[2]}"] + ([found[1]] if found[2] == "0" else [])


def best_template(templates: tuple[tuple[str, str], ...], total: int, counts: dict[str, int]) -> Column:
    """Struct of ``score`` and ``licence`` of the best template for the column ``headers``; null without headers.

    Templates that differ in their version only are nearly alike, so a version that
    the header names adds ``VERSION_LEAD`` to the order (not to the score). What still
    ties goes to the name that comes last by text.
    """
    texts = [terms_of(t) for _, t in templates]
    vocabulary = sorted({w for t in texts for w in t} | {v for name, _ in templates for v in versions_of(name)})
    place = {w: k for k, w in enumerate(vocabulary)}
    size = total + len(templates)
    idf = {w: math.log((1 + size) / (1 + counts.get(w, 0) + sum(w in t for t in texts))) + 1 for w in vocabulary}
    rare = math.log(1 + size) + 1
    # One row of weights for each term, a column for each template.
    matrix = [0.0] * (len(vocabulary) * len(templates))
    for k, words in enumerate(texts):
        vector = {w: (1 + math.log(words.count(w))) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        for w, v in vector.items():
            matrix[place[w] * len(templates) + k] = v / norm
    terms = "split('" + ",".join(vocabulary) + "', ',')"
    weighed = (
        f"transform({counted_terms('h')}, x -> struct(CAST(array_position({terms}, x.t) AS INT) AS p, 1 + ln(x.n) AS f))"
    )
    vector = f"transform({weighed}, x -> struct(x.p AS p, x.f * IF(x.p > 0, {_numbers(list(idf.values()))}[greatest(x.p - 1, 0)], {rare:.12e}D) AS w))"
    zero = f"array_repeat(0D, {len(templates)})"
    row = f"slice({_numbers(matrix)}, (x.p - 1) * {len(templates)} + 1, {len(templates)})"
    dots = f"aggregate(filter(v, x -> x.p > 0), {zero}, (a, x) -> zip_with(a, {row}, (d, m) -> d + m * x.w))"
    norm = "sqrt(aggregate(v, 0D, (a, x) -> a + x.w * x.w))"
    names = "split('" + ",".join(name for name, _ in templates) + "', ',')"
    version = "split('" + ",".join("|".join(str(place[v] + 1) for v in versions_of(name)) or "0" for name, _ in templates) + "', ',')"
    lead = f"IF(exists(v, x -> x.p > 0 AND array_contains(split({version}[k], '[|]'), CAST(x.p AS STRING))), {VERSION_LEAD}D, 0D)"
    each = f"transform({dots}, (d, k) -> struct(d / n + {lead} AS ahead, d / n AS score, {names}[k] AS licence))"
    of_header = f"transform(array({vector}), v -> transform(array({norm}), n -> array_max({each}))[0])[0]"
    best = f"array_max(transform(headers, h -> {of_header}))"
    found = F.expr(f"CASE WHEN size(headers) > 0 THEN {best} END")
    return F.when(found.isNotNull(), F.struct(found["score"].alias("score"), found["licence"].alias("licence")))


def folder_of(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def licences(
    files: DataFrame, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """``file`` (the whole row), ``licence, score, origin, source_folder`` of every row.

    ``origin`` is ``own`` (a header scores at least ``least``), ``inherited`` or
    ``none``; ``source_folder`` is the directory that an inherited licence is from.
    In a directory the licence with most files wins, of equal ones the first by
    name. Null texts have no header; a file with a null path inherits nothing and
    gives nothing. Rows that repeat a path are judged each by its own text.
    """
    whole = files.select(F.struct("*").alias("file"), F.col(path).alias("path"), F.col(text).alias("text"))
    # Both are made through a one-row generator: filters on them must not copy them into every use.
    spread = computed_once(whole, {"headers": headers(F.col("text"), F.col("path"))}).drop("text")
    vocabulary = sorted({w for _, t in templates for w in terms_of(t)})
    total, counts = header_counts(spread, vocabulary)
    best = computed_once(spread, {"best": best_template(templates, total, counts)})
    judged = best.select("file", folder_of(F.col("path")).alias("folder"), F.when(F.col("best.score") >= least, F.col("best")).alias("own"), "best")
    stated = judged.where("own IS NOT NULL AND folder IS NOT NULL").groupBy("folder", F.col("own.licence").alias("licence")).agg(F.count("*").alias("n"))
    stated = staged(stated, "stated")
    most = stated.groupBy("folder").agg(F.max("n").alias("n"))
    declared = stated.join(most, ["folder", "n"]).groupBy("folder").agg(F.min("licence").alias("licence"))
    # Every directory with all that are above it, itself first.
    folders = files.select(folder_of(F.col(path)).alias("folder")).where("folder IS NOT NULL").distinct()
    steps = F.expr("transform(sequence(size(split(folder, '/')), 1, -1), k -> array_join(slice(split(folder, '/'), 1, k), '/'))")
    above = folders.select("folder", F.posexplode(steps).alias("up", "ancestor"))
    near = above.join(declared.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.min(F.struct("up", "licence", "ancestor")).alias("near"))
    near = staged(near, "near-licences")
    small = F.broadcast(near) if near.limit(max_broadcast + 1).count() <= max_broadcast else near
    joined = judged.join(small, "folder", "left")
    own, given = F.col("own").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "file",
        F.coalesce("own.licence", "near.licence").alias("licence"),
        F.col("best.score").alias("score"),
        F.when(own, "own").when(given, "inherited").otherwise("none").alias("origin"),
        F.when(~own & given, F.col("near.ancestor")).alias("source_folder"),
    )
