"""License scans by MinHash bands over overlapping windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
#: A window of twice a template's size class shares at least 0.15 of its shingles with it if 0.8 of the template is there:
#: one row a band, 1 - 0.85**64 > 0.9999 to meet in one of the bands.
BANDS = 64
#: With one row a band, a window can meet a template only if its least shingle is one of the template's. Up to so many
#: shingles of templates are spelled out, and windows without any of them aren't hashed. That changes no result.
LITERALS = 10_000
#: Templates of up to so many bytes of bands and shingles are broadcast; more are joined as Spark sees fit.
BROADCAST_BYTES = 8 << 20

# Wording of published licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column) -> Column:
    """64-bit hashes of the runs of five words; fewer words have none."""
    places = F.when(F.size(hashes) >= SHINGLE, F.sequence(F.lit(0), F.size(hashes) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))


def bands(window: Column) -> Column:
    """The least hash of a window's shingles under BANDS hash functions, each mixed with its number."""
    return F.array(*[F.xxhash64(F.lit(b), F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(b))))) for b in range(BANDS)])  # noqa: B023


def index(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, shingles (distinct), size_class (the power of two not below 1.25 times their number) and bands."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    rows = rows.select("template", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select("template", F.array_distinct(shingles(F.col("h"))).alias("shingles")).filter(F.size("shingles") > 0)
    size = F.pow(F.lit(2), F.ceil(F.log2(1.25 * F.size("shingles")))).cast("int")
    return rows.select("template", "shingles", size.alias("size_class"), bands(F.col("shingles")).alias("bands"))


def license_scan(
    df: DataFrame, templates: dict[str, str] | None = None, key_col: str = "doc_id", text_col: str = "text", literals: int = LITERALS
) -> DataFrame:
    """A row for each input row and template found in it: the key, `template`, `containment` (share of the template's
    five-word shingles in the best window), `first_word` and `n_words` (that window) and `n_windows` (how many agree).

    Texts are worked on where they are read. Their windows overlap by half, at two times each size class that occurs
    among the templates; a window retrieves the templates that share one of its MinHash bands, and the exact containment
    of at least 0.8 verifies them. A template whose words stand within 1.25 times its length lies whole in a window; one
    with more inserted may be missed. What is shuffled is a row per verified window. A text's windows are cut out class
    by class, so a row holds twice its text at most, however many windows hold a license.

    Null and empty texts, and those of fewer than five words, match nothing; templates of fewer than five words are
    left out. Rows equal in all columns count each. An empty input gives an empty result.
    """
    spark = df.sparkSession
    kept = index(spark, TEMPLATES if templates is None else templates).collect()  # as many as the caller gave
    wanted = sorted({x for r in kept for x in r.shingles})
    classes = sorted({r.size_class for r in kept})
    lookup = spark.createDataFrame([(r.template, list(r.shingles), r.size_class, b) for r in kept for b in r.bands], "template string, shingles array<long>, size_class int, band long")
    if sum(BANDS * (8 * len(r.shingles) + 32) for r in kept) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    rows = df.select(F.col(key_col).alias("_key"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    rows = rows.select("_key", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    rows = rows.select("_key", shingles(F.col("_h")).alias("_s"))
    # The row number also keeps the filter above this projection: pushed below, it would spell out the hashes in it anew.
    numbered = [F.monotonically_increasing_id().alias("_rid"), F.col("_key"), F.col("_s")]
    few = len(wanted) <= literals
    if few:
        hit = F.transform("_s", lambda x, i: F.when(x.isin(wanted) if wanted else F.lit(False), i))
        rows = rows.select(*numbered, F.filter(hit, lambda i: i.isNotNull()).alias("_hits")).filter(F.size("_hits") > 0)
    else:
        rows = rows.select(*numbered).filter(F.size("_s") > 0)

    def steps(c: int) -> Column:
        """Windows of the class by number; of those without a hit, none if hits are known."""
        if not few:
            return F.sequence(F.lit(0).cast("long"), F.floor((F.size("_s") - 1) / c))
        return F.array_distinct(F.flatten(F.transform("_hits", lambda i: F.array(F.floor(i / c), F.greatest(F.floor(i / c) - 1, F.lit(0))))))

    every = F.array(*[F.struct(F.lit(c).alias("size_class"), steps(c).alias("steps")) for c in classes]) if classes else F.array().cast("array<struct<size_class:int,steps:array<long>>>")
    rows = rows.select("_rid", "_key", "_s", F.explode(every).alias("_c")).select("_rid", "_key", "_s", "_c.size_class", "_c.steps")
    place = lambda k: (k * F.col("size_class")).cast("int")
    window = lambda k: F.struct(place(k).alias("at"), F.array_distinct(F.slice("_s", place(k) + 1, 2 * F.col("size_class"))).alias("s"))
    rows = rows.select("_rid", "_key", "size_class", F.explode(F.transform("steps", window)).alias("_win")).select("_rid", "_key", "size_class", "_win.at", F.col("_win.s").alias("_s"))
    rows = rows.withColumn("band", F.explode(bands(F.col("_s")))).join(lookup, ["size_class", "band"])
    rows = rows.withColumn("containment", F.size(F.array_intersect("_s", "shingles")) / F.size("shingles")).filter(F.col("containment") >= SIMILARITY)
    best = F.struct("containment", (-F.col("at")).alias("back"), F.col("size_class"))
    found = rows.groupBy("_rid", "template").agg(F.first("_key").alias(key_col), F.max(best).alias("_best"), F.countDistinct("size_class", "at").alias("n_windows"))
    return found.select(
        key_col,
        "template",
        "_best.containment",
        (-F.col("_best.back")).alias("first_word"),
        (2 * F.col("_best.size_class") + SHINGLE - 1).alias("n_words"),
        "n_windows",
    )
