"""License scans with DataFrame functions: min-hash bands over text windows, then exact shingle containment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
#: Share of a notice's distinct shingles that a run of text must hold.
CONTAINED = 0.8
#: The run may be this much longer than the notice.
REACH = 1.5
#: Shingles in a window that is hashed into bands, and the step to the next window.
WINDOW, STRIDE = 8, 4
#: Bands are the 2**BAND_BITS parts of one permutation of the hashes; a window's value in a band is the least hash there. A shingle
#: that window and template share is their common value in its band unless a smaller one of the window's others lies in the same
#: band, a chance below 8 / 2**(BAND_BITS + 1), or 0.001. Notices share 0.8 of their shingles, so only the shortest can miss at all.
BAND_BITS = 12
#: Most band values of a template table that are broadcast; a larger table is joined by shuffling on them.
BROADCAST_KEYS = 500_000
_GAP = r"[^a-z0-9\x80-\x{10FFFF}]+"

#: Fixed wording of common licence notices.
TEMPLATES = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", text.lower()) if w]


def _words(text) -> Column:
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: Column) -> Column:
    """Hashes of the three-word shingles of an array of words, in order."""
    body = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, body(w)).otherwise(F.array().cast("array<bigint>")))


def bands(window: Column) -> Column:
    """The least hash in each band that an array of hashes reaches: hashes in order, without those that follow one of their band."""
    band = lambda h: F.shiftright(h, 64 - BAND_BITS)
    return _let(F.array_sort(window), lambda s: F.filter(s, lambda h, i: (i == 0) | (band(h) != band(F.get(s, i - 1)))))


def band_keys(shingles: str, stride: int) -> Column:
    """The distinct band values of all windows of a column of shingle hashes. A value lies in one band, so it stands for both."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(shingles) - 1) / stride).cast("int")), lambda i: bands(F.slice(shingles, i * stride + 1, WINDOW)))
    return F.when(F.size(shingles) > 0, F.array_distinct(F.flatten(cut))).otherwise(F.array().cast("array<bigint>"))


def template_rows(spark: SparkSession, templates=None) -> DataFrame:
    """license, variant and text of a dictionary of notices."""
    rows = [F.struct(F.lit(n).alias("license"), F.lit(v).alias("variant"), F.lit(text).alias("text")) for n, texts in (TEMPLATES if templates is None else templates).items() for v, text in enumerate(texts)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Full licence texts from a folder of text files named for their licences (such as the SPDX list's): license, variant 0, text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("license"), F.lit(0).alias("variant"), F.col("value").alias("text"))


def find_licenses(docs: DataFrame, templates: DataFrame | dict | None = None) -> DataFrame:
    """Licence notices in whole texts: doc_id, license, variant, containment, first_word.

    ``docs``: doc_id, text. ``templates``: a table of license, variant and text, or a dictionary of notices; the built-in ones if not given.
    Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. A notice is found if some run of the text, starting
    at one of the notice's three-word shingles and ``REACH`` times as long as the notice, holds at least 0.8 of its distinct shingles;
    containment is the largest share in any such run and first_word where the first run with enough begins.

    Windows of the text and of the notices are hashed into bands; a notice with a band value in common is held against the text in full. One
    row for each row of ``docs`` and notice found: repeated rows give repeated rows and a null doc_id is kept, as every row stands for
    itself. Null, empty and short texts have none; a notice of fewer than three words is never found. Notices equal in licence and variant
    are each their own. Other columns are ignored. Empty input: no rows.

    Plan: one pass over the texts without a shuffle, as long as the templates' band values are few enough to broadcast, which is
    counted first; beyond, texts that share a value are shuffled to it.
    """
    spark = docs.sparkSession
    given = isinstance(templates, DataFrame)
    table = (templates if given else template_rows(spark, templates)).where("text is not null").select("license", "variant", shingle_hashes(_words("text")).alias("all"))
    table = table.where(F.size("all") > 0).select(F.xxhash64("license", "variant", "all").alias("notice"), "license", "variant", F.array_distinct("all").alias("own"), F.ceil(F.size("all") * REACH).cast("int").alias("reach"), band_keys("all", 1).alias("marks"))
    marks = table.select(F.explode_outer("marks").alias("key"), F.col("notice").alias("of"))
    small = not given or marks.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    send = F.broadcast if small else lambda x: x

    sets = docs.where("text is not null").select("doc_id", shingle_hashes(_words("text")).alias("sh"))
    keyed = sets.select("doc_id", "sh", band_keys("sh", STRIDE).alias("keys"))
    # an outer explode, as the filter that Catalyst infers from an inner one would compute the arrays again for every element
    hits = keyed.select("doc_id", "sh", "keys", F.explode_outer("keys").alias("at")).join(send(marks), F.col("at") == F.col("key")).join(send(table), F.col("of") == F.col("notice"))
    # of the values that a text and a notice share, the least one speaks for all; null-safe, so that no filter is inferred on the arrays
    hits = hits.where(F.col("at").eqNullSafe(F.array_min(F.array_intersect("keys", "marks"))))

    places = F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains("own", F.get("sh", i)))
    runs = F.transform(places, lambda p: F.struct(F.size(F.array_intersect(F.slice("sh", p + 1, F.col("reach")), F.col("own"))).alias("n"), p.alias("p")))
    enough = lambda r: r["n"] * 10 >= F.size("own") * int(CONTAINED * 10)
    best = _let(runs, lambda rs: F.struct((F.array_max(rs)["n"] / F.size("own")).alias("containment"), F.array_min(F.transform(F.filter(rs, enough), lambda r: r["p"])).cast("int").alias("first_word")))
    found = hits.select("doc_id", "license", "variant", F.explode(F.filter(F.array(best), lambda b: b["first_word"].isNotNull())).alias("best"))
    return found.select("doc_id", "license", "variant", "best.*")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates=None) -> str:
    """The same as SQL, without hashing: every run that starts at a shingle of a notice."""
    rows, sizes = [], []
    for name, variants in (TEMPLATES if templates is None else templates).items():
        for v, text in enumerate(variants):
            words = words_of(text)
            places = len(words) - SHINGLE + 1
            grams = sorted({" ".join(words[i : i + SHINGLE]) for i in range(places)})
            rows += [f"('{name}', {v}, '{g}')" for g in grams]
            sizes.append(f"('{name}', {v}, {len(grams)}, {-(-places * 3 // 2)})")
    return f"""
WITH t(license, variant, g) AS (VALUES {", ".join(rows)}),
s(license, variant, n, reach) AS (VALUES {", ".join(sizes)}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w),
m AS (SELECT doc_id, i - 1 AS i, license, variant, g FROM (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM p) g JOIN t USING (g)),
r AS (SELECT doc_id, license, variant, a.i, n, count(DISTINCT b.g) AS c FROM m a JOIN s USING (license, variant) JOIN m b USING (doc_id, license, variant) WHERE b.i >= a.i AND b.i < a.i + reach GROUP BY ALL)
SELECT doc_id, license, variant, max(c)::DOUBLE / any_value(n) AS containment, min(i) FILTER (c * 10 >= 8 * n)::INT AS first_word
FROM r GROUP BY doc_id, license, variant HAVING max(c) * 10 >= 8 * any_value(n)
"""
