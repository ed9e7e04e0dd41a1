"""License notices in texts: MinHash bands over overlapping windows find templates, shingle containment checks them.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

SHINGLE = 5  # words
BANDS = 24  # of one row each: see find_licenses
MIN_CONTAINMENT = 0.8
BITS = 1 << 16  # of the table of template shingles
SEED = 77

SLICE = 1024  # shingles of a text whose notices are held against each other at once

# Parts of the BSD licenses. The opening alone does not tell which of them it is.
BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met"
)
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
)
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"

# Notices and the licenses that they name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    ("BSD", BSD_OPENING),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "LGPL-2.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
        "any later version.",
    ),
    ("BSD-2-Clause", " ".join((BSD_OPENING, *BSD_CLAUSES[:2], BSD_END))),
    ("BSD-2-Clause", " ".join((BSD_OPENING, "1.", BSD_CLAUSES[0], "2.", BSD_CLAUSES[1], BSD_END))),
    ("BSD-3-Clause", " ".join((BSD_OPENING, *BSD_CLAUSES, BSD_END))),
    ("BSD-3-Clause", " ".join((BSD_OPENING, "1.", BSD_CLAUSES[0], "2.", BSD_CLAUSES[1], "3.", BSD_CLAUSES[2], BSD_END))),
)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(text: Column) -> Column:
    """A hash of every run of five words, in order; none for fewer words."""

    def each(tokens: Column) -> Column:
        last = F.size(tokens) - SHINGLE
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]),
        )
        return F.when(last >= 0, hashes).otherwise(F.array().cast("array<long>"))

    return let(words(text), each)


def signature(values: Column) -> Column:
    """The least hash of a set of shingles for each band's hash function."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda band: F.array_min(F.transform(values, lambda v: F.xxhash64(F.lit(SEED), band, v))),
    )


def templates(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``template, license, t_shingles, class`` of notices with five words or more; the class is a power of two."""
    table = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(rows)], "template int, license string, text string")
    cut = table.withColumn("t_shingles", F.array_distinct(shingles(F.col("text"))))
    size = F.size("t_shingles")
    return cut.filter(size > 0).select(
        "template", "license", "t_shingles", F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int").alias("class")
    )


def find_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rows: tuple[tuple[str, str], ...] = TEMPLATES,
    min_containment: float = MIN_CONTAINMENT,
    own_only: bool = False,
) -> DataFrame:
    """License notices in whole texts: ``key, license, containment, first_word``, a row per key and license.

    A template of class c (at most c shingles, more than c/2) is sought in windows of 5c/4 shingles, one every c/4, so
    that some window holds any whole occurrence; there the Jaccard similarity is 0.4 or more for a whole notice and
    0.32 for the least containment. With 24 bands of one row, 1 - 0.68**24 > 0.9999 of such windows meet their
    template in a band. Windows without any template shingle cannot: a band's value is the hash of a
    shingle of both sides. They are left out before any signature is worked out, by a table of bits. What the bands
    retrieve is checked exactly: the share of the template's shingles that stand in the window.

    Licenses whose notices share most of their words match each other's. With ``own_only`` a match goes if another
    license's match holds every place of it and more shingles, see :func:`own_matches`.

    The templates are a fixed list given by the caller, so their table is broadcast. Nulls, and texts or templates of
    fewer than five words, have no shingles and give no rows. Rows with equal keys are one key. Columns of
    ``docs`` other than key and text are not read.
    """
    spark = docs.sparkSession
    notices = templates(spark, rows)
    known = notices.collect()
    if not known:
        return docs.select(key).limit(0).selectExpr(
            key, "'' as license", "0D as containment", "0 as first_word"
        )
    bits = [0] * (BITS // 64)
    for row in known:
        for value in row["t_shingles"]:
            bit = value % BITS
            bits[bit >> 6] |= 1 << (bit & 63)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    table = F.array(*[F.lit(b).cast("long") for b in signed])

    def in_table(value: Column) -> Column:
        bit = F.pmod(value, F.lit(BITS))
        return F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1

    classes = sorted({row["class"] for row in known})
    wanted = {c: sorted({v for row in known if row["class"] == c for v in row["t_shingles"]}) for c in classes}

    def starts(hits: Column, c: int) -> Column:
        """Windows of a class that hold a shingle of the class's templates."""
        step, length = max(1, c // 4), c + max(1, c // 4)
        own = F.array(*[F.lit(v).cast("long") for v in wanted[c]])
        # Windows k with k * step <= place < k * step + length.
        windows = F.flatten(
            F.transform(
                F.filter(hits, lambda h: F.array_contains(own, h.value)),
                lambda h: F.sequence(
                    F.greatest(F.lit(0), F.floor((h.place - length) / step).cast("int") + 1),
                    F.floor(h.place / step).cast("int"),
                ),
            )
        )
        return F.transform(
            F.array_distinct(windows),
            lambda k: F.struct(F.lit(c).alias("class"), (k * step).alias("start"), F.lit(length).alias("length")),
        )

    def all_windows(every: Column) -> Column:
        hits = F.filter(
            F.transform(every, lambda v, i: F.when(in_table(v), F.struct(v.alias("value"), i.alias("place")))),
            lambda h: h.isNotNull(),
        )
        windows = let(hits, lambda h: F.concat(*[starts(h, c) for c in classes]))
        return F.transform(
            windows,
            lambda w: F.struct(
                w["class"].alias("class"), w.start.alias("start"), F.slice(every, w.start + 1, w.length).alias("_in")
            ),
        )

    # One expression from the text to its windows, so that nothing of it is worked out twice.
    windows = docs.select(
        F.col(key).alias("_key"), F.explode(let(shingles(F.col(text)), all_windows)).alias("at")
    ).select("_key", "at.class", "at.start", "at._in")
    banded = windows.withColumn("_signature", signature(F.col("_in")))
    marks = notices.select("template", "class", F.posexplode(signature(F.col("t_shingles"))).alias("band", "value"))
    found = banded.select("_key", "class", "start", "_in", F.posexplode("_signature").alias("band", "value")).join(
        F.broadcast(marks), ["class", "band", "value"]
    )
    # A window meets a template in several bands; one row of each goes on.
    met = found.groupBy("_key", "class", "start", "template").agg(F.first("_in").alias("_in"))
    checked = met.join(F.broadcast(notices.drop("class")), "template").withColumn(
        "containment", F.size(F.array_intersect("t_shingles", "_in")) / F.size("t_shingles")
    )
    own = F.filter(
        F.transform("_in", lambda v, i: F.when(F.array_contains("t_shingles", v), i)), lambda i: i.isNotNull()
    )
    matches = checked.filter(F.col("containment") >= min_containment).select(
        "_key", "license", "containment", F.transform(own, lambda i: F.col("start") + i).alias("places"),
        F.size(F.array_intersect("t_shingles", "_in")).alias("shared"),
    )
    if own_only:
        matches = own_matches(matches)
    best = F.struct("containment", (-F.array_min("places")).alias("place"))
    return (
        matches.groupBy("_key", "license")
        .agg(F.max(best).alias("best"))
        .select(
            F.col("_key").alias(key), "license", "best.containment", (-F.col("best.place")).cast("int").alias("first_word")
        )
    )


def own_matches(matches: DataFrame) -> DataFrame:
    """Drop matches that another license's match explains: it holds all their places in the text, and more shingles.

    Two notices next to each other both stay, as each has places that the other has not; so do equally good matches.
    A match is judged in the slice of its first place, where every match that holds this place is, too.
    """
    first, last = F.array_min("places"), F.array_max("places")
    one = F.struct("license", "containment", "places", "shared", F.floor(first / SLICE).alias("home"))
    spread = matches.select(
        "_key", one.alias("m"), F.explode(F.sequence(F.floor(first / SLICE), F.floor(last / SLICE))).alias("slice")
    )
    grouped = spread.groupBy("_key", "slice").agg(F.collect_list("m").alias("all"))

    def explained(x: Column) -> Column:
        return F.exists(
            "all",
            lambda y: (y.license != x.license) & (y.shared > x.shared) & (F.size(F.array_except(x.places, y.places)) == 0),
        )

    return grouped.select(
        "_key", F.inline(F.filter("all", lambda x: (x.home == F.col("slice")) & ~explained(x)))
    )
