"""Operator 7: license scans by MinHash over overlapping text windows. DataFrame functions only.

Words are runs of letters and digits in lower case. A text's shingles are its runs of K words;
windows of WINDOW shingles start at every STRIDE-th shingle. Each of BANDS hash functions (the
shingle hash under an exclusive-or mask) gives a window's minimum; each minimum is a band. A
template has windows at every shingle, so that a notice that is copied as it stands has equal
windows, whatever its place. A window retrieves the templates with which it shares a band, and the
template's distinct shingles are then counted exactly among the text's shingles around the window:
CONTAINED of them at least make a match.

A template of one shingle lies in WINDOW / STRIDE windows of which it is a WINDOW-th at least, so it
is retrieved with probability collision(1 / WINDOW, BANDS * WINDOW // STRIDE), 0.99; longer ones
have windows with a Jaccard coefficient of 1 and are retrieved for certain when unchanged.

A template of fewer than K words is one shingle of all its words. It is sought at every word, by the
hash of the run of so many words that starts there; a hit holds the whole template.

Defined cases: a template without words can't be found and raises ValueError; null, empty and short texts match nothing; rows that share a doc_id are one
document; a null doc_id is carried through as one document; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.columns import let

K, WINDOW, STRIDE, BANDS, CONTAINED = 5, 4, 2, 8, 0.75
#: Wording of public licence notices.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Notices of fewer than K words, found as a whole only.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."}
_RANDOM = random.Random(20240607)
MASKS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def collision(jaccard: float, bands: int) -> float:
    """Probability that two windows share one of so many single-row bands."""
    return 1 - (1 - jaccard) ** bands


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _run(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def _shingles(words: Column, n: int = K) -> Column:
    """Hashes of all runs of n words, in order."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _run(words, i, n))).otherwise(F.array().cast("array<long>"))


def _short(words: Column, n: int, values: list[int]) -> Column:
    """at, band, value of the runs of n words that are a whole template of n words; their band is that of no window."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    held = F.filter(starts, lambda i: _run(words, i, n).isin(*values))
    return F.transform(held, lambda i: F.struct(i.alias("at"), F.lit(BANDS + n).alias("band"), _run(words, i, n).alias("value")))


def _minimum(shingles: Column, at: Column, mask: int) -> Column:
    return F.least(*[F.get(shingles, at + j).bitwiseXOR(F.lit(mask)) for j in range(WINDOW)])


def template_bands(df: DataFrame, templates: dict[str, str]) -> tuple[DataFrame, list[tuple]]:
    """Templates with their shingles, and (template, band, minimum) of all of their windows: a few rows for each template word.

    A template of n < K words has band BANDS + n and the hash of its words.
    """
    spark = df.sparkSession
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "\\'")) for k, v in templates.items())
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(license_id, text)")
    rows = rows.select("license_id", _words(F.col("text")).alias("words"))
    empty = [r.license_id for r in rows.where("size(words) = 0").select("license_id").collect()]
    if empty:
        raise ValueError(f"templates without words can't be found: {', '.join(empty)}")
    whole = reduce(lambda c, n: c.when(F.size("words") == n, F.array(_run(F.col("words"), F.lit(0), n))), range(1, K), F.when(F.size("words") >= K, _shingles(F.col("words"))))
    rows = rows.select("license_id", F.size("words").alias("n"), whole.alias("template"))
    windows = rows.where(f"n >= {K}").select("license_id", "template", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("template") - WINDOW))).alias("at"))
    each = F.array(*[F.struct(F.lit(b).alias("band"), _minimum(F.col("template"), F.col("at"), m).alias("value")) for b, m in enumerate(MASKS)])
    short = rows.where(f"n < {K}").select("license_id", (F.col("n") + BANDS).alias("band"), F.get("template", F.lit(0)).alias("value"))
    bands = [tuple(r) for r in windows.select("license_id", F.inline(each)).distinct().union(short).collect()]
    return rows.select("license_id", F.array_distinct("template").alias("template")), bands


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license_id, first_word, places, containment: a row for each document and template that it holds."""
    rows, bands = template_bands(docs, templates or TEMPLATES | SHORT_TEMPLATES)
    values = [[v for _, b, v in bands if b == i] or [0] for i in range(BANDS)]
    hit = lambda sh, at: reduce(Column.__or__, [_minimum(sh, at, m).isin(*v) for m, v in zip(MASKS, values, strict=True)])
    lengths = {n: [v for _, b, v in bands if b == BANDS + n] for n in range(1, K)}
    none = F.array().cast("array<struct<at: int, band: int, value: long>>")
    # (starts) every STRIDE-th shingle, and the last window
    starts = lambda sh: F.filter(F.sequence(F.lit(0), F.size(sh) - 1, F.lit(STRIDE)), lambda at: hit(sh, at))
    each = lambda sh, at: F.array(*[F.struct(at.alias("at"), F.lit(b).alias("band"), _minimum(sh, at, m).alias("value")) for b, m in enumerate(MASKS)])
    places = lambda sh: F.when(F.size(sh) > 0, F.flatten(F.transform(starts(sh), lambda at: each(sh, at)))).otherwise(none)
    short = lambda ws: [_short(ws, n, v) for n, v in lengths.items() if v]
    found = lambda ws: let(_shingles(ws), lambda sh: F.struct(sh.alias("shingles"), F.concat(places(sh), *short(ws)).alias("places")))
    held = docs.select("doc_id", let(_words(F.col("text")), found).alias("f")).where("size(f.places) > 0").select("doc_id", "f.shingles", "f.places")
    spark = docs.sparkSession
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {b}, {v if v > -(1 << 63) else v + 1}L)" for t, b, v in bands) + " AS t(license_id, band, value)")
    probes = held.select("doc_id", "shingles", F.inline("places"))
    # a constant number of rows on the side of the templates
    candidates = probes.join(F.broadcast(table), ["band", "value"]).drop("value").join(F.broadcast(rows), "license_id")
    size = F.size("template")
    start = F.greatest(F.lit(0), F.col("at") - size)
    around = F.slice("shingles", start + 1, F.col("at") - start + WINDOW + size)
    common = F.size(F.array_intersect(around, "template"))
    first = start + F.array_position(F.transform(around, lambda x: F.array_contains("template", x)), True) - 1
    first, share = (F.when(F.col("band") > BANDS, whole).otherwise(part) for whole, part in ((F.col("at"), first), (F.lit(1.0), common / size)))
    exact = candidates.select("doc_id", "license_id", first.cast("long").alias("first_word"), share.alias("containment")).where(F.col("containment") >= contained)
    return exact.groupBy("doc_id", "license_id").agg(F.min("first_word").alias("first_word"), F.countDistinct("first_word").alias("places"), F.max("containment").alias("containment"))
