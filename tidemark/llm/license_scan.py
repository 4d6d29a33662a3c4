"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

All of it is DataFrame expressions. A template of n shingles of five words is looked for in windows of 2n shingles that
begin every n/2, so that any stretch of up to 1.5n shingles lies in one window as a whole. A window that holds a share c of
the template has a Jaccard similarity of at least c / (2 + (1 - c)), since it has 2n shingles at most; with bands of one
MinHash each, at c = 0.8 and 32 bands, all bands miss with a probability of 5e-7 at most. What a band retrieves is verified
by counting the shared shingles.

What could not be verified is left out before hashing. k shingles of a template cover k + 4 of its words, so a window that
holds a share c of its shingles holds all of these words but the repeated ones; a window that shares fewer words with every
template of its size is dropped. Before a text is split into words it has to contain a cover word: these are
chosen so that no template can lose all shingles with one of them and still match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.once import evaluate_once

SHINGLE = 5
#: Notices and characteristic sentences of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction',
    "Apache-2.0": "use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; none for a null or empty text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles(column: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    count = F.size(column) - (SHINGLE - 1)
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(column, i, SHINGLE), " ")))
    return F.when(count >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_sizes(templates: dict[str, str]) -> list[int]:
    """Distinct shingle counts; templates of fewer than five words have none and are refused."""
    sizes = {name: len({*_runs(text)}) for name, text in templates.items()}
    if short := [name for name, size in sizes.items() if not size]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return sorted(set(sizes.values()))


def _runs(text: str) -> list[tuple[str, ...]]:
    found = template_words(text)
    return [tuple(found[i : i + SHINGLE]) for i in range(len(found) - SHINGLE + 1)]


def least_shared(n: int, containment: float) -> int:
    """Shingles that a match shares at least with a template of n."""
    return math.ceil(containment * n - 1e-9)


def cover_words(templates: dict[str, str], containment: float) -> list[str]:
    """Words of which every match of a template holds one.

    A match misses n - least_shared(n) shingles of a template at most, so the words chosen for it have to stand in more
    shingles than that. Long words come first: they are rare.
    """
    chosen: set[str] = set()
    for text in templates.values():
        runs = set(_runs(text))
        spare = len(runs) - least_shared(len(runs), containment)
        runs = {run for run in runs if chosen.isdisjoint(run)}
        while len(runs) > 0 and len(set(_runs(text))) - len(runs) <= spare:
            counts = Counter(w for run in runs for w in set(run))
            best = max(counts, key=lambda w: (len(w) >= 7, counts[w], len(w), w))
            chosen.add(best)
            runs = {run for run in runs if best not in run}
    return sorted(chosen)


def may_match(some_words: Column, templates: dict[str, str], containment: float) -> Column:
    """Whether words are enough of a template's to hold a share of `containment` of its shingles."""
    tests = []
    for text in templates.values():
        found, n = template_words(text), len(set(_runs(text)))
        least = least_shared(n, containment) + SHINGLE - 1 - (len(found) - len(set(found)))
        shared = F.size(F.array_intersect(some_words, F.array(*map(F.lit, sorted(set(found))))))
        tests.append(shared >= max(1, least))
    return reduce(or_, tests)


def signature(window: Column, bands: int) -> Column:
    """One MinHash per band."""
    seeds = F.sequence(F.lit(1), F.lit(bands))
    return F.transform(seeds, lambda s: F.array_min(F.transform(window, lambda x: F.xxhash64(x, s))))


def template_bands(spark: SparkSession, templates: dict[str, str], bands: int) -> DataFrame:
    """(license, size, shingles, band, value); its size depends on the templates alone."""
    rows = spark.createDataFrame(list(templates.items()), "license string, body string")
    rows = rows.select("license", F.array_distinct(shingles(words(F.col("body")))).alias("template"))
    rows = rows.withColumn("n", F.size("template"))
    return rows.select("license", "n", "template", F.posexplode(signature(F.col("template"), bands)).alias("band", "value"))


def _grid(templates: dict[str, str], n: int, containment: float) -> Column:
    """The windows for templates of n shingles, from the columns words and hashes, as structs (n, start, window)."""
    alike = {name: text for name, text in templates.items() if len(set(_runs(text))) == n}
    starts = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit((n + 1) // 2))
    starts = F.filter(starts, lambda s: may_match(F.slice("words", s + 1, 2 * n + SHINGLE - 1), alike, containment))
    return F.transform(
        starts, lambda s: F.struct(F.lit(n).alias("n"), s.alias("start"), F.slice("hashes", s + 1, 2 * n).alias("window"))
    )


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    bands: int = 32,
    containment: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document and license found: doc_id, license, windows, containment, first_word.

    A window matches if it holds a share of `containment` of the template's distinct shingles. `windows` counts the windows
    that match, `containment` is the largest share, `first_word` the word (from 0) at which the first one begins. Texts
    that are null, empty or of fewer than five words match nothing. Rows of the same id, null included, are taken
    together, so repeated rows change nothing. Other columns are not read. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    cover = cover_words(templates, containment)
    lowered = F.lower(F.col(text_column))
    rows = docs.filter(reduce(or_, (F.contains(lowered, F.lit(w)) for w in cover)))
    rows = rows.select(F.col(id_column).alias("doc_id"), evaluate_once(words(F.col(text_column))).alias("words"))
    rows = rows.filter(may_match(F.col("words"), templates, containment))
    rows = rows.select("doc_id", "words", evaluate_once(shingles(F.col("words"))).alias("hashes"))
    rows = rows.filter(F.size("hashes") > 0)
    grids = [_grid(templates, n, containment) for n in template_sizes(templates)]
    windows = rows.select("doc_id", F.explode(F.concat(*grids)).alias("w")).select("doc_id", "w.n", "w.start", "w.window")
    banded = windows.select("doc_id", "n", "start", "window", F.posexplode(signature(F.col("window"), bands)).alias("band", "value"))
    known = template_bands(docs.sparkSession, templates, bands)
    retrieved = banded.join(F.broadcast(known), ["n", "band", "value"])
    share = F.size(F.array_intersect("template", "window")) / F.col("n")
    verified = retrieved.select("doc_id", "license", "start", share.alias("share")).filter(F.col("share") >= containment)
    return verified.groupBy("doc_id", "license").agg(
        F.count_distinct("start").alias("windows"), F.max("share").alias("containment"), F.min("start").alias("first_word")
    )


def oracle_sql(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same rows by comparing the shingles of every window with those of every template."""
    texts = ", ".join(f"""('{name}', '{" ".join(template_words(text))}')""" for name, text in (templates or TEMPLATES).items())
    return f"""
WITH t AS (SELECT license, string_split(body, ' ') AS w FROM (VALUES {texts}) v(license, body)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS shingle
       FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT license, count(*) AS n, (count(*) + 1) // 2 AS step FROM ts GROUP BY license),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w
      FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS shingle
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hits AS (SELECT doc_id, license, n, step, p, shingle FROM ds JOIN ts USING (shingle) JOIN tn USING (license)),
placed AS (SELECT *, unnest(range(greatest(0, (p - 2 * n + step) // step), p // step + 1)) * step AS start FROM hits),
found AS (SELECT doc_id, license, n, start, count(DISTINCT shingle) AS shared FROM placed
          WHERE start <= p AND p < start + 2 * n GROUP BY ALL)
SELECT doc_id, license, count(DISTINCT start) AS windows, max(shared / n) AS containment, CAST(min(start) AS INTEGER) AS first_word
FROM found WHERE shared / n >= {containment} GROUP BY doc_id, license
"""
