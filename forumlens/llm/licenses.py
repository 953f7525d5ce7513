"""License scans: MinHash bands over text windows find templates, exact containment decides.

Words are runs of a-z, 0-9 and dots after lower-casing, shingles are SHINGLE words
in a row. Documents are covered by windows of WINDOW words every STRIDE words,
templates by windows at every word. A window's signature has one smallest hash per
band, and a band is one row, so two windows of similarity s miss each other with
probability (1 - s)**BANDS. A template of SHORT shingles in a row has half of the
shingles of the window that covers it, s = 1/2, and is missed once in 16 million;
longer ones line up better, up to a window of their own at s = 1. In a window of
that size templates of fewer shingles would be missed too often, so both sides have
windows of one shingle for them: s = 1, and none is missed.

Only windows that share a shingle with some template are hashed; others can't
match. What a document shares with all templates together is a short list, which
goes along to the exact check: the part of a template's distinct shingles that the
document has. All of it is built-in functions, and nothing but candidates moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, BANDS = 3, 8, 4, 24
#: Templates of fewer distinct shingles are looked for by windows of one shingle.
SHORT = 3
#: Percentage of a template's shingles that a document must have.
CONTAINED = 80

#: The notices that are looked for.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
}


def _words(text: Column) -> Column:
    """Words without the dots that end a sentence."""
    return F.filter(
        F.split(F.regexp_replace(F.lower(text), r"\.+(?=[^a-z0-9.]|$)", " "), "[^a-z0-9.]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of each run of SHINGLE words, in order."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.transform(
        places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])
    )).otherwise(F.array().cast("array<long>"))


def _bands(window: Column) -> Column:
    """The smallest hash of a window's shingles in each band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.array_min(F.transform(window, lambda s: F.xxhash64(s, band))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, shingles (distinct), windows (arrays of shingles at every word, of one shingle if SHORT)."""
    given = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()]
    rows = spark.range(1).select(F.inline(F.array(*given)))
    hashed = rows.withColumn("words", _words(F.col("text"))).withColumn("in_order", _shingles(F.col("words")))
    per_window = WINDOW - SHINGLE + 1
    starts = F.sequence(F.lit(1), F.greatest(F.size("in_order") - per_window + 1, F.lit(1)))
    distinct = F.array_distinct("in_order")
    return hashed.filter(F.size("in_order") > 0).select(
        "license", distinct.alias("shingles"),
        F.when(F.size(distinct) < SHORT, F.transform(distinct, lambda s: F.array(s))).otherwise(
            F.transform(starts, lambda at: F.slice("in_order", at, F.lit(per_window)))).alias("windows"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: int = CONTAINED) -> DataFrame:
    """doc_id, license, shared, shingles: one row per row of docs (doc_id, text) and license in it.

    ``shared`` of the template's ``shingles`` distinct shingles are in the text.
    NULL and empty texts, and those shorter than a shingle, hold no license. Rows
    that repeat an id are scanned one by one, a NULL id is a row like any other.
    Other columns are ignored. The templates are a parameter and few: they are
    broadcast.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    pieces = table.select(F.explode("shingles"), F.size("shingles") < SHORT).collect()
    wanted, short = sorted({r[0] for r in pieces}), sorted({r[0] for r in pieces if r[1]})
    if not wanted:
        wanted = [0]
    per_window = WINDOW - SHINGLE + 1
    in_order = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        _words(F.col("text").cast("string")).alias("words"),
    ).select("row", "doc_id", _shingles(F.col("words")).alias("in_order"))
    hits = F.filter(
        F.transform("in_order", lambda s, i: F.when(s.isin(wanted), i)), lambda i: i.isNotNull())
    found = in_order.withColumn("hits", hits).filter(F.size("hits") > 0)
    # A place lies in the window that begins at the stride before it, and if near to that in the one before.
    begin = F.transform("hits", lambda i: (i - i % STRIDE).cast("int"))
    before = F.transform(
        F.filter("hits", lambda i: (i >= STRIDE) & (i % STRIDE < per_window - STRIDE)), lambda i: (i - i % STRIDE - STRIDE).cast("int"))
    windows = F.transform(
        F.array_union(begin, before), lambda at: F.slice("in_order", at + 1, F.lit(per_window)))
    found = found.select(
        "row", "doc_id", F.array_distinct(F.transform("hits", lambda i: F.get("in_order", i))).alias("mine"),
        windows.alias("windows"))
    if short:
        alone = F.transform(F.filter("mine", lambda s: s.isin(short)), lambda s: F.array(s))
        found = found.withColumn("windows", F.concat("windows", alone))
    candidates = found.select("row", "doc_id", "mine", F.explode("windows").alias("window")).select("row", "doc_id", "mine", F.posexplode(_bands(F.col("window"))).alias("band", "least"))
    buckets = table.select("license", F.explode("windows").alias("window")).select(
        "license", F.posexplode(_bands(F.col("window"))).alias("band", "least")).distinct()
    retrieved = candidates.join(F.broadcast(buckets), ["band", "least"]).groupBy("row", "license").agg(
        F.first("doc_id").alias("doc_id"), F.first("mine").alias("mine"))
    checked = retrieved.join(F.broadcast(table.select("license", "shingles")), "license")
    return checked.select(
        "doc_id", "license", F.size(F.array_intersect("mine", "shingles")).alias("shared"),
        F.size("shingles").alias("shingles"),
    ).filter(f"100 * shared >= {contained} * shingles")
