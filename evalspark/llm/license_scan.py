"""Operator 10, licence scans: MinHash bands over overlapping windows, then exact containment.

Texts and licence templates are cut into words (letters and digits, lower
case) and five-word shingles. Templates of similar size form a class; a text
is read in windows of twice the class size that overlap, so that every
stretch of a template's size lies in one window. A window's MinHash under one
permutation is one band; a window whose value is that of a template is a
candidate for it. The number of bands of a class follows from the least
Jaccard similarity that a window with enough of a template can have, so that
such a window is found with probability RECALL. A candidate matches when it
holds the required share of the template's shingles. DataFrame functions
only, and no row is shuffled before the few matches.

A band of a window can only have a template's value if the window holds the
shingle that the value stands for, so the bands are worked out for the
windows around such shingles and for no others; the result is the same as
with all windows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.999

#: Usual licence notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                "and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(text: Column) -> Column:
    """Hash of every five-word shingle, in order; a text with fewer words is one shingle, one without any has none."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(
            F.array().cast("array<bigint>"))), 1)


def _masks(n: int) -> list[int]:
    """One 64-bit mask for each band: the order of (hash XOR mask) is a permutation of the hashes."""
    rnd = random.Random(10)
    return [rnd.getrandbits(64) - (1 << 63) for _ in range(n)]


class _Class:
    """Window, stride and bands for templates of lo to hi shingles."""

    def __init__(self, templates: list[tuple[str, list[int]]], hi: int, containment: float):
        self.templates = templates
        self.window, self.stride = (1, 1) if hi == 1 else (2 * hi, hi + 1)
        least = 1.0
        for _, own in templates:
            need = math.ceil(containment * len(own) - 1e-9)
            least = min(least, need / (self.window + len(own) - need))
        self.bands = 1 if least == 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - least))


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _classes(templates: list[tuple[str, list[int]]], containment: float) -> list[_Class]:
    out, lo, hi = [], 1, 1
    left = [(name, sorted(set(own))) for name, own in templates if own]
    while any(len(own) >= lo for _, own in left):
        if own := [t for t in left if lo <= len(t[1]) <= hi]:
            out.append(_Class(own, hi, containment))
        lo, hi = hi + 1, 3 if hi == 1 else 2 * hi - 1
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per doc_id and template found in its text: doc_id, template, n_shingles (of the template),
    n_found (most of them in one window), first_window (first word of the first such window), containment.

    Null texts and texts without words match nothing. A null doc_id is a
    name like any other, and rows with equal ids are one document. Template
    shingles count once however often they occur. Texts of fewer than five
    words are one shingle, so templates that short are found only as whole
    texts. Without documents or templates the result is empty. The templates
    go to all tasks as constants; the list is the caller's and does not grow
    with the corpus.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list((templates or TEMPLATES).items()) or [("", None)], "template string, text string")
    known = [(r["template"], r["s"]) for r in known.select("template", shingles(F.coalesce("text", F.lit(""))).alias("s"))
             .orderBy("template").collect()]
    classes = _classes(known, containment)
    masks = _masks(max([c.bands for c in classes], default=0))
    empty = F.array().cast("array<struct<class:int,band:int,value:bigint,start:int,own:array<bigint>>>")
    table = []

    #: the shingles that the templates' band values stand for
    anchors = {_signed(min(_signed(v ^ m) for v in own) ^ m) for c in classes for _, own in c.templates
               for m in masks[:c.bands]}

    def windows(s: Column, starts: Column, k: int, band: int) -> Column:
        """Those of the windows of one class that have a template's value in one band."""
        c, values = classes[k], {}
        for name, own in c.templates:
            value = min(_signed(v ^ masks[band]) for v in own)
            values.setdefault(value, []).append((name, own))
        table.extend((k, band, v, name, tuple(own)) for v, found in values.items() for name, own in found)

        def least(at: Column) -> Column:
            return F.array_min(F.transform(F.slice(s, at, c.window), lambda h: h.bitwiseXOR(F.lit(masks[band]))))

        hit = F.filter(starts, lambda at: least(at).isin(*values))
        return F.transform(hit, lambda at: F.struct(
            F.lit(k).alias("class"), F.lit(band).alias("band"), least(at).alias("value"), at.alias("start"),
            F.slice(s, at, c.window).alias("own")))

    def of_class(s: Column, at: Column, k: int) -> Column:
        """Candidate windows of one class around the shingles at positions ``at``."""
        c = classes[k]
        around = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(
            F.sequence(F.greatest(F.lit(0), F.ceil((p - c.window) / F.lit(c.stride))).cast("int"),
                       F.floor((p - 1) / F.lit(c.stride)).cast("int")), lambda m: m * c.stride + 1))))
        return F.element_at(F.transform(F.array(around), lambda starts: F.concat(
            empty, *[windows(s, starts, k, band) for band in range(c.bands)])), 1)

    def found_in(s: Column) -> Column:
        """Candidate windows of all classes in one text."""
        def around(at: Column) -> Column:
            return F.concat(empty, *[of_class(s, at, k) for k in range(len(classes))])

        values = F.array(*[F.lit(v) for v in sorted(anchors)])
        places = F.filter(F.transform(s, lambda h, i: F.when(h.isin(*anchors), i + 1)), lambda i: i.isNotNull())
        return F.when(F.arrays_overlap(s, values), F.element_at(F.transform(F.array(places), around), 1)).otherwise(empty)

    candidates = empty
    if classes:
        # one-element arrays give an expression a name, so it is worked out once
        candidates = F.element_at(F.transform(F.array(shingles(F.coalesce("text", F.lit("")))), found_in), 1)
    found = docs.select("doc_id", F.explode(candidates).alias("c")).select("doc_id", "c.*")
    band_table = spark.createDataFrame(sorted(set(table))
                                       or [(-1, -1, 0, "", (0,))],
                                       "class int, band int, value long, template string, shingles array<long>")
    n_found = F.size(F.array_intersect("own", "shingles"))
    return (found.join(F.broadcast(band_table), ["class", "band", "value"])  # a row per template and band
            .select("doc_id", "template", F.size("shingles").alias("n_shingles"), n_found.alias("n_found"), "start")
            .where(F.col("n_found") >= F.lit(containment) * F.col("n_shingles") - F.lit(1e-9))
            .groupBy("doc_id", "template", "n_shingles")
            .agg(F.max(F.struct("n_found", (-F.col("start")).alias("at"))).alias("best"))
            .select("doc_id", "template", "n_shingles", F.col("best.n_found").alias("n_found"),
                    (-F.col("best.at") - 1).cast("int").alias("first_window"),
                    (F.col("best.n_found") / F.col("n_shingles")).alias("containment")))
