"""License notices found in texts.

Texts are cut into overlapping windows, sized to the templates: a template of n words belongs to the
smallest class W = 4, 8, 16, ... that holds it, and windows of 2W words start at every W-th word, so a
notice lies whole in one of them. A window holds a template if it has three quarters of its shingles.

MinHash bands find the templates to compare a window with. A band is one minimum, as windows are longer than
their templates: the least similarity of a window that holds a template follows from their sizes (1/12 for a
template of one shingle in sixteen words), and each class has as many bands as it takes to miss such a window with a
probability of `MISS` at most (159 there). What the bands find is decided by exact containment.

Only windows around certain words are looked at: for each template few words are named such that
whoever lacks them all lacks more than a quarter of its shingles. That loses nothing.
"""

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
PERCENT = 75
MISS = 1e-6

# Public license notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(words: Column, k: Column | int) -> Column:
    """Distinct hashes of k neighbouring words; none if there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(words, i, k))))


def _plain_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def _class(words: list[str]) -> tuple[int, int]:
    """Class and shingle size of a template."""
    size = 4
    while size < len(words):
        size *= 2
    return size, min(SHINGLE, len(words))


def _every(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def bands_for(size: int, k: int, m: int) -> int:
    """Bands that find a full window of class `size` with `PERCENT` of a template's m shingles, but for a chance of `MISS`."""
    most, need = 2 * size - k + 1, ceil(m * PERCENT / 100)
    return ceil(log(MISS) / log(1 - need / (m + most - need)))


def minima(have: Column, bands: Column) -> Column:
    """Per band the least hash of the shingles."""
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(have, lambda h: F.xxhash64(h, b))))


def _needed(templates: dict[str, str]) -> dict[int, dict[int, list[str]]]:
    """{class: {shingle size: words}}: a text that holds a template of the class holds one of the words."""
    words = {n: _plain_words(t) for n, t in templates.items()}
    holders: dict[str, int] = {}
    for w in words.values():
        for x in set(w):
            holders[x] = holders.get(x, 0) + 1
    out: dict[int, dict[int, list[str]]] = {}
    for w in words.values():
        size, k = _class(w)
        every = _every(w, k)
        bare, chosen = set(every), []
        # rare words first, and those that cover most
        while 100 * len(bare) >= PERCENT * len(every):
            best = max({x for s in bare for x in s}, key=lambda x: (len(x) * sum(x in s for s in bare) / holders[x], x))
            chosen.append(best)
            bare = {s for s in bare if best not in s}
        have = out.setdefault(size, {}).setdefault(k, [])
        have += [x for x in chosen if x not in have]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (greatest over windows), windows (how many hold it).

    Null and empty texts hold none. Rows with one id are reported together; a null id is an id. Each text is
    searched by itself, and repeated rows, equal in id and text, count as one.
    """
    plain = {n: _plain_words(t) for n, t in (templates or TEMPLATES).items()}
    plain = {n: w for n, w in sorted(plain.items()) if w}
    bands: dict[tuple[int, int], int] = {}
    for w in plain.values():
        size, k = _class(w)
        bands[size, k] = max(bands.get((size, k), 1), bands_for(size, k, len(_every(w, k))))
    spark: SparkSession = docs.sparkSession
    named = spark.createDataFrame(
        [(n, w, *_class(w), bands[_class(w)]) for n, w in plain.items()], "license string, w array<string>, size int, k int, bands int"
    )
    lower = F.lower("text")
    needed = _needed({n: " ".join(w) for n, w in plain.items()})
    pivots = sorted({w for by in needed.values() for ws in by.values() for w in ws})
    gate = F.lit(False)
    for w in pivots:
        gate = gate | F.contains(lower, F.lit(w))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text")).where(gate)
    held = held.select("doc_id", "tid", words_of(F.col("text")).alias("w"))
    groups = [(size, k, ws) for size, by in needed.items() for k, ws in by.items()]
    spots = F.array(*[
        F.struct(F.lit(size).alias("size"), F.lit(k).alias("k"), F.lit(bands[size, k]).alias("bands"), F.array(*[F.lit(w) for w in ws]).alias("ws")) for size, k, ws in groups
    ])
    first = F.filter(F.transform("w", lambda w, i: F.when(F.array_contains(F.array(*[F.lit(x) for x in pivots]), w), i)), lambda i: i.isNotNull())
    classed = held.withColumn("hits", first).select("doc_id", "tid", "w", "hits", F.explode(spots).alias("c"))
    at = F.filter("hits", lambda i: F.array_contains("c.ws", F.get("w", i)))
    cells = F.transform(at, lambda i: F.floor(i / F.col("c.size")).cast("int"))
    starts = F.array_distinct(F.concat(cells, F.transform(cells, lambda x: F.greatest(x - 1, F.lit(0)))))
    windows = classed.select("doc_id", "tid", "w", F.col("c.size").alias("size"), F.col("c.k").alias("k"), F.col("c.bands").alias("bands"), F.explode(starts).alias("cell"))
    windows = windows.select("doc_id", "tid", "size", "k", "bands", "cell", F.slice("w", F.col("cell") * F.col("size") + 1, 2 * F.col("size")).alias("w"))
    windows = windows.withColumn("have", shingles(F.col("w"), F.col("k"))).where(F.size("have") > 0)
    by_band = F.posexplode(minima(F.col("have"), F.col("bands"))).alias("band", "least")
    windows = windows.select("doc_id", "tid", "size", "k", "cell", "have", by_band)
    sought = named.withColumn("want", shingles(F.col("w"), F.col("k")))
    sought = sought.select("license", "size", "k", "want", F.posexplode(minima(F.col("want"), F.col("bands"))).alias("band", "least"))
    # a fixed table: as many rows as the templates have bands
    met = windows.join(F.broadcast(sought), ["size", "k", "band", "least"]).groupBy("doc_id", "tid", "license", "cell").agg(
        F.first("have").alias("have"), F.first("want").alias("want")
    )
    share = F.size(F.array_intersect("have", "want"))
    found = met.withColumn("n", share).where(F.col("n") * 100 >= F.size("want") * PERCENT)
    return found.groupBy("doc_id", "license").agg(F.max(F.col("n") / F.size("want")).alias("containment"), F.count("*").alias("windows"))
