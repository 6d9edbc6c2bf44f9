"""License notices by MinHash over text windows, then exact containment. DataFrame functions only.

Texts and templates become words (letters and digits, lower case) and hashes of their five-word
shingles. For templates of up to L shingles a text is cut into windows of 2 L shingles, L apart, so
that L shingles in a row always lie in one window. A window and a template meet when they agree in
one of ``BANDS`` one-row bands. A template of which a window holds 80 % has a Jaccard similarity of
at least 0.19 with it (its length is above L / 2), so 64 bands miss it with probability
(1 - 0.19)^64 < 2e-6. What meets is verified by the exact share of the template's shingles.

A window can agree with a template in a band only if it holds a shingle of the template; texts and
windows without any template shingle are left out before windows and signatures are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, written

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

#: Public license notices, each of at least five words.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    clean = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(clean, " ")


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order (an empty array below five words or for null)."""
    w = words(F.coalesce(text, F.lit("")))
    # the words are bound once, as a one-element array, so that each shingle does not split anew
    each = F.transform(F.array(w), lambda x: F.when(
        F.size(x) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(x) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(x, i + k) for k in range(SHINGLE)])),
    ).otherwise(F.array().cast("array<bigint>")))
    return F.element_at(each, 1)


def _signature(window: Column) -> Column:
    """The least hash of the window's shingles under each of ``BANDS`` hash functions."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*map(least, range(BANDS)))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``(license, part array<bigint>, size, reach, signature)``; ``reach`` is the least power of two
    that is not below the number of distinct shingles."""
    t = spark.createDataFrame(sorted(texts.items()), "license string, text string")
    t = t.select("license", F.array_distinct(shingles(F.col("text"))).alias("part"))
    t = t.withColumn("size", F.size("part"))
    reach = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double")))).cast("int")
    return t.select("license", "part", "size", reach.alias("reach"), _signature(F.col("part")).alias("signature"))


def scan(
    docs: DataFrame, texts: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, license, matched, size, containment, first_word)``, one row per id and notice found.

    ``matched`` of the notice's ``size`` distinct shingles lie in the best window (of equals the
    first), which starts at word ``first_word`` (from 0). Texts that are null or below five words
    have none; rows that repeat an id are taken together; a null id is an id; other columns are
    ignored. A text that repeats a notice, or a notice that a third of all texts hold, makes rows of
    ids and numbers only, reduced before the shuffle.
    """
    spark = docs.sparkSession
    t = templates(spark, texts)
    # The templates are constants of this module or a caller's dictionary: small by construction.
    known = t.select(F.explode("part")).distinct().collect()
    reaches = sorted(r.reach for r in t.select("reach").distinct().collect())
    known = [r[0] for r in known]
    has = lambda a: F.exists(a, lambda x: x.isin(known))
    # Written, as each length of window reads it: the texts are read and hashed once.
    d = written(docs.select(F.col(id_col).alias("doc_id"), shingles(F.col(text_col)).alias("sh")).where(has(F.col("sh"))), "license-shingles")
    cut = []
    for reach in reaches:
        starts = F.sequence(F.lit(0), F.size("sh") - 1, F.lit(reach))
        w = d.select("doc_id", "sh", F.explode(starts).alias("start"))
        w = w.select("doc_id", F.lit(reach).alias("reach"), "start", F.array_distinct(F.slice("sh", F.col("start") + 1, F.lit(2 * reach))).alias("window"))
        cut.append(w.where(has(F.col("window"))))
    windows = cut[0]
    for w in cut[1:]:
        windows = windows.unionByName(w)
    windows = windows.withColumn("signature", _signature(F.col("window")))
    banded = windows.select("doc_id", "reach", "start", "window", F.posexplode("signature").alias("band", "least"))
    index = t.select("license", "part", "size", "reach", F.posexplode("signature").alias("band", "least"))
    # Broadcast: BANDS rows per template.
    met = banded.join(F.broadcast(index), ["reach", "band", "least"])
    met = met.withColumn("matched", F.size(F.array_intersect("window", "part"))).where(F.col("matched") >= containment * F.col("size"))
    best = F.max(F.struct("matched", (-F.col("start")).alias("back")))
    out = met.groupBy("doc_id", "license", "size").agg(best.alias("best"))
    return out.select(
        "doc_id", "license", F.col("best.matched").cast("bigint").alias("matched"), F.col("size").cast("bigint").alias("size"),
        (F.col("best.matched") / F.col("size")).alias("containment"), (-F.col("best.back")).cast("bigint").alias("first_word"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
