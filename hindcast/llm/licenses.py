"""License scans by MinHash bands, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.decontaminate import item_words, run_of

SHINGLE = 3
# Windows of eight shingles, one every four: whatever is five shingles long or shorter lies
# whole in one of them.
WINDOW, STRIDE = 8, 4
# Bands of one row each. A window and a template that share a share j of their shingles meet in
# some band with probability 1 - (1 - j) ** BANDS: 0.996 for three shingles of eight; a longer
# template lies over several windows, each of which retrieves it.
BANDS = 12
CONTAINED = 0.75

# Wordings of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(words: Column) -> Column:
    """Hash of every run of ``SHINGLE`` words, in order.

    ``words`` must be a plain column: an expression would be computed anew for every run.
    """
    last = F.size(words) - SHINGLE + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*run_of(words, i, SHINGLE)))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, start: Column) -> list[Column]:
    """MinHash of the window at ``start`` under each hash function; values tell their function.

    Places past the end of the text count as one more element.
    """
    window = run_of(shingles, start, WINDOW)
    return [F.least(*[F.xxhash64(h, F.lit(j)) for h in window]) for j in range(BANDS)]


def _template_bands(shingles: Column) -> Column:
    def band(j: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(j))))

    return F.array(*map(band, range(BANDS)))


def _literal(rows: list) -> Column:
    """The templates as one constant: name, shingles, bands."""

    def longs(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    return F.array(*[F.struct(F.lit(r["name"]).alias("name"), longs(r["shingles"]).alias("shingles"), longs(r["bands"]).alias("bands")) for r in rows])


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Which license notices every text holds; one row for each input row.

    Returns ``doc_id, n_windows, matches``: windows of the text, and for each notice found its
    ``name``, ``first_word`` (0-based, of the first window that retrieved it) and ``contained``,
    the largest share of the notice's three-word shingles found around such a window, at least
    ``CONTAINED``. Words are runs of letters and digits with A-Z lowered. Bands only retrieve; the
    count of shared shingles decides. Templates are few and given by the caller; those under
    three words are refused. Null and short texts match nothing; repeated rows stay repeated;
    other columns are not read. Nothing is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    known = known.select("name", item_words(F.col("text")).alias("words"))
    known = known.select("name", F.array_distinct(_shingles(F.col("words"))).alias("shingles"))
    rows = known.select("name", "shingles", _template_bands(F.col("shingles")).alias("bands")).orderBy("name").collect()
    if any(not r["shingles"] for r in rows):
        raise ValueError("a template needs at least three words")
    constant = _literal(rows)

    def collides(start: Column) -> Column:
        meets = [b.isin([r["bands"][j] for r in rows]) for j, b in enumerate(_bands(F.col("shingles"), start))]
        return reduce(Column.__or__, meets)

    def verified(start: Column) -> Column:
        bands = F.array(*_bands(F.col("shingles"), start))

        def measured(t: Column) -> Column:
            size = F.size(t["shingles"])
            first = F.greatest(start - size, F.lit(1))
            around = F.slice("shingles", first, start - first + size + WINDOW)
            shared = F.size(F.array_intersect(t["shingles"], around)) / size
            return F.struct(t["name"].alias("name"), (start - 1).alias("first_word"), shared.alias("contained"))

        near = F.filter(constant, lambda t: F.arrays_overlap(t["bands"], bands))
        return F.filter(F.transform(near, measured), lambda m: m["contained"] >= CONTAINED)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), item_words(F.col(text_col)).alias("words"))
    texts = texts.select("doc_id", _shingles(F.col("words")).alias("shingles"))
    starts = F.when(F.size("shingles") > 0, F.sequence(F.lit(1), F.greatest(F.size("shingles"), F.lit(1)), F.lit(STRIDE)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    found = texts.select("doc_id", F.size(starts).cast("long").alias("n_windows"), F.filter(starts, collides).alias("at"), "shingles")
    found = found.select("doc_id", "n_windows", F.flatten(F.transform("at", verified)).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"])))

    def best(name: Column) -> Column:
        own = F.filter("found", lambda m: m["name"] == name)
        return F.struct(
            name.alias("name"),
            F.array_min(F.transform(own, lambda m: m["first_word"])).alias("first_word"),
            F.array_max(F.transform(own, lambda m: m["contained"])).alias("contained"),
        )

    return found.select("doc_id", "n_windows", F.transform(names, best).alias("matches"))
