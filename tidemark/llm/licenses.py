"""Licence texts in documents: windows of the words compared with templates by the Dice coefficient of word bigrams.

A whole text is normalised to words of lower-case letters, digits and inner points, so line breaks, case and punctuation
don't count. A template of n words is compared with windows of n words. Windows are placed by anchors: words of the
template such that a window without any of them keeps too few of its bigrams to reach the threshold t; an anchor found in
the text places the window as it stands in the template. Size bounds come first: with b distinct bigrams, a template can
only reach t on t/(2-t) b to (2-t)/t b of them, so a text that is too short meets no long template. Texts without any
anchor are passed over by one pattern search.

All is built-in functions over the row's own text: a map without exchange. Per text and template the best window is
returned (of equal ones the first). Null or empty text has no match; repeated rows give repeated results; only the id and
text columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents

THRESHOLD = 0.8

#: Standard notices and whole short texts of public licences.
TEMPLATES = {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: str) -> list[str]:
    return [w for w in (x.rstrip(".") for x in re.findall("[a-z0-9.]+", text.lower())) if w]


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int]]:
    """(word, place) of words of a template, the longest first, until too few bigrams are left without them."""
    w, grams = _words(text), _bigrams(text)
    left, out = set(grams), []
    for word in sorted(set(w), key=lambda x: (-len(x), x)):
        # the most that a window can reach that holds nothing but bigrams which are left
        if 2 * len(left) < threshold * (len(left) + len(grams)):
            break
        out += [(word, i) for i, x in enumerate(w) if x == word]
        left = {g for g in left if word not in g.split()}
    return out


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, matches): per text its best window for each template that it matches, as (license, start_word, dice)."""
    templates = templates or TEMPLATES
    ratio = threshold / (2 - threshold)
    placed = {k: anchors(v, threshold) for k, v in templates.items()}
    all_anchors = sorted({w for each in placed.values() for w, _ in each})
    any_anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in all_anchors) + r")(?![a-z0-9])"
    kind = "array<struct<license:string,start_word:int,dice:double>>"
    none = F.array().cast("array<string>")
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    raw = F.transform(F.regexp_extract_all(F.lower("_t"), F.lit("[a-z0-9.]+"), F.lit(0)), lambda x: F.rtrim(x, F.lit(".")))
    t = t.select("doc_id", F.when(F.col("_t").rlike(any_anchor), F.filter(raw, lambda x: x != "")).otherwise(none).alias("_w"))
    found = F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: s["w"].isin(all_anchors))
    t = t.withColumn("_a", found)

    def best(name: str, text: str) -> Column:
        """The best window of a template, or null."""
        n, grams = len(_words(text)), _bigrams(text)
        places: dict[str, list[int]] = {}
        for w, i in placed[name]:
            places.setdefault(w, []).append(i)
        where = F.create_map(*[x for w, at in places.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
        own = F.filter("_a", lambda s: s["w"].isin(list(places)))
        starts = F.array_distinct(F.flatten(F.transform(own, lambda s: F.transform(F.try_element_at(where, s["w"]), lambda i: F.greatest(s["i"] - i, F.lit(0))))))

        def compared(start: Column) -> Column:
            window = F.slice("_w", start + 1, n)
            pairs = F.array_distinct(F.zip_with(F.slice(window, 1, F.size(window) - 1), F.slice(window, 2, F.size(window) - 1), lambda a, b: F.concat_ws(" ", a, b)))
            dice = 2.0 * F.size(F.filter(pairs, lambda g: g.isin(grams))) / (F.size(pairs) + len(grams))
            return F.struct((-dice).alias("d"), start.alias("s"))

        long_enough = F.filter(starts, lambda s: (F.size("_w") - s - 1 >= ratio * len(grams)) & (F.size("_w") - s > 1))
        top = F.array_min(F.transform(long_enough, compared))
        return F.when(-top["d"] >= threshold, F.struct(F.lit(name).alias("license"), top["s"].alias("start_word"), (-top["d"]).alias("dice")))

    every = F.array_compact(F.array(*[best(k, v) for k, v in templates.items()])).cast(kind)
    return t.select("doc_id", F.when(F.size("_a") > 0, every).otherwise(F.array().cast(kind)).alias("matches"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = license_matches(documents(spark, sf_dir))
    return m.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.sort_array(F.transform("matches", lambda x: x["license"])), ",").alias("licenses"),
        F.round(F.array_max(F.transform("matches", lambda x: x["dice"])), 9).alias("best_dice"),
    )


def _sql() -> str:
    listed = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
    rows = ", ".join(f"('{name}', {len(_words(text))}, {listed(_bigrams(text))})" for name, text in TEMPLATES.items())
    at = ", ".join(f"('{name}', '{w}', {i})" for name, text in TEMPLATES.items() for w, i in anchors(text))
    return rf"""
WITH t(license, n, own) AS (VALUES {rows}), a(license, word, place) AS (VALUES {at}),
d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.]+'), lambda x: rtrim(x, '.')), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
s AS (SELECT DISTINCT doc_id, license, greatest(i - place, 0) AS s FROM p JOIN a ON x = word),
g AS (SELECT doc_id, license, own, list_distinct(list_transform(range(s + 1, least(s + n, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS g
      FROM s JOIN t USING (license) JOIN d USING (doc_id) WHERE len(w) - s - 1 >= {THRESHOLD} / {2 - THRESHOLD} * len(own) AND len(w) - s > 1),
m AS (SELECT doc_id, license, 2.0::double * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM g),
k AS (SELECT doc_id, license, max(dice) AS dice FROM m WHERE dice >= {THRESHOLD} GROUP BY ALL)
SELECT d.doc_id, count(license)::bigint AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses, round(max(dice), 9) AS best_dice
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


ORACLE_SQL = _sql()
