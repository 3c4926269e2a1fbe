"""License statements in documents: MinHash over overlapping windows, then exact shingle containment; column expressions only.

A template is a text; a document states it if some window of its words holds CONTAINMENT of the template's
shingles (runs of SHINGLE_WORDS words) or more. For a template of n words the windows have n + n/4 words and
start every n/4 words, so each stretch of n words lies in one.

Each template and window has BANDS minhashes; a window is held against a template if one of them is equal.
A window that holds enough of a template has Jaccard similarity s >= c*t / (t + w - c*t) with it (t, w: their
shingles, c: the containment), and is missed with probability (1 - s)**bands. `band_count` takes as many bands
as keep that below MISS for the worst template.

A band can only be equal if the window holds the very shingle that is the template's minimum there. So windows
are formed around those shingles alone; all others are known to retrieve nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-4
SEPARATORS = r"[^\p{L}\p{N}]+"
MAX_TEMPLATES = 10_000  # they are broadcast

# Statements as authors of licenses ask for them.
STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def window_of(words: int) -> tuple[int, int]:
    """Width and step of the windows for a template of that many words."""
    step = max(1, words // 4)
    return words + step, step


def band_count(sizes: list[int], containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that miss a window with enough of a template, of any of these sizes in words, with probability `miss` at most."""
    worst = 1.0
    for n in sizes:
        t, w = n - SHINGLE_WORDS + 1, window_of(n)[0] - SHINGLE_WORDS + 1
        have = math.ceil(containment * t)
        worst = min(worst, have / (t + w - have))
    return 1 if worst >= 1 else math.ceil(math.log(miss) / math.log(1 - worst))


def template_table(spark: SparkSession, statements: dict[str, str]) -> DataFrame:
    """(template, text) of a dictionary."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in statements.items()))
    return spark.range(1).select(F.inline(rows))


def _words(text: Column) -> Column:
    """What stands between separators, in lower case; a text that begins or ends with one has an empty word there."""
    return F.split(F.lower(text), SEPARATORS)


def _shingles(words: Column | str) -> Column:
    """Distinct runs of words as strings; none if there are too few words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE_WORDS + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE_WORDS), " "))
    return F.when(F.size(words) >= SHINGLE_WORDS, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _shingle_hash(words: list[Column]) -> Column:
    return F.xxhash64(*(F.xxhash64(w) for w in words))


def _hashed(shingle: Column) -> Column:
    """The hash of a shingle string, as _shingle_hash has it."""
    parts = F.split(shingle, " ")
    return _shingle_hash([parts[k] for k in range(SHINGLE_WORDS)])


def find_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """A row for each document and template it states: doc_id, template, containment (the best of its windows), first_word
    (where the first window as good as that starts), windows (how many windows state it).

    Templates have a name and SHINGLE_WORDS words at least, else ValueError. Null texts are empty and state
    nothing. Rows that share a doc_id are reported as one document, rows without one together under null. Other
    columns are not looked at; without documents there are no rows.
    """
    known = (
        templates.select("template", F.filter(_words(plain_text("text")), lambda w: w != "").alias("words"))
        .select("template", F.size("words").alias("n"), _shingles("words").alias("wanted")).limit(MAX_TEMPLATES + 1)
    )
    sizes = [(r.template, r.n) for r in known.select("template", "n").collect()]
    if len(sizes) > MAX_TEMPLATES or any(name is None or n < SHINGLE_WORDS for name, n in sizes):
        raise ValueError(f"at most {MAX_TEMPLATES} templates, each with a name and {SHINGLE_WORDS} words or more")
    bands = band_count([n for _, n in sizes], containment, miss)
    hashed = known.select("template", "n", "wanted", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), F.transform("wanted", _hashed).alias("hashes"))
    least = F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("low"), h.alias("seed"))))
    keyed = hashed.select("template", "n", "wanted", "band", least.alias("m")).select("template", "n", "wanted", "band", "m.low", "m.seed")
    seeds = [r.seed for r in keyed.select("seed").distinct().collect()] or [0]
    return _states(_windows(docs, seeds, sorted({window_of(n) for _, n in sizes})), keyed, bands, containment)


def _windows(docs: DataFrame, seeds: list[int], shapes: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, start, words) of the windows of every shape around a seed shingle."""
    tail = SHINGLE_WORDS - 1
    words = docs.select("doc_id", _words(plain_text("text")).alias("words"))
    hashes = words.select("doc_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    is_seed = lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, SHINGLE_WORDS))).isin(seeds)
    at = F.transform(F.slice("h", 1, F.greatest(F.size("h") - tail, F.lit(0))), lambda x, i: F.when(is_seed(x, i), i).otherwise(-1))
    hits = hashes.select("doc_id", "words", F.array_remove(at, -1).alias("hits"))

    def around(i: Column) -> Column:
        return F.concat(*(of_shape(i, k) for k in range(len(shapes))))

    def of_shape(i: Column, k: int) -> Column:
        width, step = shapes[k]
        first = F.greatest(F.ceil((i + SHINGLE_WORDS - width) / step).cast("int"), F.lit(0))
        return F.transform(F.sequence(first, F.floor(i / step).cast("int")), lambda m: m.cast("long") * (step * len(shapes)) + k)

    # A window is one number, start * shapes + shape: distinct numbers are found by hashing, structs pair by pair.
    places = F.array_distinct(F.flatten(F.transform("hits", around)))
    start = lambda p: F.floor(p / len(shapes)).cast("int")
    width = lambda p: F.element_at(F.array(*(F.lit(w) for w, _ in shapes)), (p % len(shapes)).cast("int") + 1)
    cut = F.transform(places, lambda p: F.struct(start(p).alias("start"), width(p).alias("width"), F.slice("words", start(p) + 1, width(p)).alias("words")))
    return hits.select("doc_id", F.inline(cut))


def _states(windows: DataFrame, keyed: DataFrame, bands: int, containment: float) -> DataFrame:
    """Windows meet templates on equal bands and are verified on the shingles themselves."""
    found = windows.select("doc_id", "start", "width", _shingles("words").alias("has"))
    lows = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.struct(k.alias("band"), F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, k))).alias("low")),
    )
    banded = found.select("doc_id", "start", "width", "has", F.transform("has", _hashed).alias("hashes")).select("doc_id", "start", "width", "has", F.inline(lows))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    met = banded.join(F.broadcast(keyed), ["band", "low"]).filter(F.col("width") == F.col("n") + step)
    share = F.size(F.array_intersect("has", "wanted")) / F.size("wanted")
    good = met.select("doc_id", "template", "start", share.alias("share")).filter(F.col("share") >= containment)
    return (
        good.groupBy("doc_id", "template", "start").agg(F.max("share").alias("share"))
        .groupBy("doc_id", "template")
        .agg(F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("windows"))
        .select("doc_id", "template", F.col("best.share").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"), "windows")
    )
