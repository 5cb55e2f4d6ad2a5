"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, doc_key, let, text_of
from docloom.llm.shingling import WORDS, BitFilter, places_of, shingle_hashes, shingles_of, window_starts, word_hashes

#: License notices and grants, as they are published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
CONTAINMENT = 0.8
#: A window is 1.5 times its template, at steps of a quarter, so every place a template can stand lies inside one. At
#: containment 0.8 its Jaccard similarity is at least 0.8 / 1.7 = 0.47: 24 bands of one minimum miss it once in 4 million.
BANDS = 24
#: Template shingles up to this number are sent to every executor.
MAX_BROADCAST = 1 << 20


def band_keys(shingles: Column) -> Column:
    """One key per band: the band's number with the least of the shingles' hashes under the band's own hash."""
    least = lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, least(k)))


def _windows(docs: DataFrame, sizes: dict[int, list[int]], known, least: float, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, words, n, first, window``: the windows for templates of ``n`` shingles that may hold ``least`` of
    one, since they have that many shingles of any template (``known``); others cannot, and get no signature."""

    def of_size(k: int, s: Column, places: Column, n: Column) -> Column:
        width, step = F.ceil(n * 1.5).cast("int"), F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
        need = F.greatest(F.lit(1), F.ceil(n * least - F.lit(1e-9)).cast("int"))
        row = lambda j: F.struct(F.lit(k).alias("words"), n.alias("n"), (j * step).alias("first"), F.slice(s, j * step + 1, width).alias("window"))
        return F.transform(window_starts(places, width, need, F.size(s) - 1, step), row)

    def of_words(k: int, s: Column) -> Column:
        each = F.split(F.lit(",".join(map(str, sizes[k]))), ",").cast("array<int>")
        return let(places_of(s, known), lambda p: F.flatten(F.transform(F.filter(each, lambda n: n * least <= F.size(p)), lambda n: of_size(k, s, p, n))))

    found = let(word_hashes(text_of(text_col)), lambda h: F.concat(*[let(shingles_of(h, k), lambda s, k=k: of_words(k, s)) for k in sorted(sizes)]))
    return docs.select(doc_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.explode(found).alias("x")).select("id", "text_hash", "x.*")


def license_hits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = CONTAINMENT, prune: bool = True
) -> DataFrame:
    """``id, text_hash, license, template, first, containment``: every (document, template) with a window that holds
    at least ``least`` of the template's shingles, and the first of its best windows (in words from 0).

    Overlapping windows of each template size get MinHash bands; a window that shares a band with templates of its size
    is compared with those. With ``prune``, windows with too few shingles of any template to hold ``least`` of one get no
    bands (a constant Bloom filter in the scan counts them); that loses nothing, and without it every window gets them.

    Shingles are five words (letters, digits and _, lower case); a template of fewer words is one shingle, and one
    without words is left out. Null, empty and wordless texts hold nothing; an empty table, or no templates, give an
    empty result. A null id counts as the smallest; rows repeated with the same id and text count once.
    """
    spark = docs.sparkSession
    rows = [(i, name, text) for i, (name, text) in enumerate(templates) if name is not None and text is not None]
    table = spark.createDataFrame(rows, "template int, license string, text string").withColumn("words", F.least(F.lit(WORDS), F.size(word_hashes(F.col("text")))))
    by_size = F.coalesce(*[F.when(F.col("words") == k, shingle_hashes(F.col("text"), k)) for k in range(1, WORDS + 1)])
    known = table.where("words > 0").select("template", "license", "words", F.array_distinct(by_size).alias("shingles"))
    # Written first, so that each signature is made once.
    known = checkpoint(known.select("*", F.size("shingles").alias("n"), band_keys(F.col("shingles")).alias("bands")))
    sizes: dict[int, list[int]] = {}
    for k, n in known.select("words", "n").distinct().sort("words", "n").collect():
        sizes.setdefault(k, []).append(n)
    if not sizes:
        return spark.createDataFrame([], "id long, text_hash long, license string, template int, first int, containment double")
    vocabulary = known.select(F.explode("shingles").alias("h")).distinct()
    small = known.agg(F.sum("n")).first()[0] <= MAX_BROADCAST
    side = lambda frame: F.broadcast(frame) if small else frame
    may_hold = BitFilter(vocabulary, vocabulary.count()).may_hold if prune else lambda h: F.lit(True)
    windows = checkpoint(_windows(docs, sizes, may_hold, least, id_col, text_col).where(F.size("window") > 0))
    place = ["id", "text_hash", "words", "n", "first"]
    banded = windows.select(*place, F.explode(band_keys(F.col("window"))).alias("band"))
    met = banded.join(side(known.select("template", "words", "n", F.explode("bands").alias("band"))), ["words", "n", "band"]).select(*place, "template").distinct()
    tried = met.join(windows.dropDuplicates(place), place).join(side(known.select("template", "license", "shingles")), "template")
    hits = tried.withColumn("containment", F.size(F.array_intersect("shingles", "window")) / F.col("n")).where(F.col("containment") >= least)
    best = hits.groupBy("id", "text_hash", "license", "template").agg(F.max(F.struct("containment", F.negative("first").alias("back"))).alias("b"))
    return best.select("id", "text_hash", "license", "template", F.negative("b.back").alias("first"), F.col("b.containment").alias("containment"))
