"""Licence scans by a trained paragraph classifier, made of DataFrame functions alone.

A paragraph is a run of lines that aren't blank, joined by spaces.  Its word n-grams
(n = 2 and 3) that have a weight say where notices may stand: a span for each place
at which a template that holds the n-gram would lie, cut to its length and a bit
wider, and the line itself.  Spans are sought in overlapping windows of ``WINDOW``
words.  A sparse logistic regression with one class for each licence family and one
for unknown gives each span a probability; scores are calibrated by a temperature
fitted on a held-out part, and a span whose best family stays below ``SURE`` is
unknown.  A prediction is confirmed by comparison with the family's templates: the
best share of a template's n-grams (n = 1 to 3) found in the span.  Of spans that
overlap, the one that holds most of a template counts, so a paragraph may hold any
number of licences, wrapped over lines or side by side.

The model is fitted on the driver from a bounded set: the family templates with
deterministic variants, and at most ``NEGATIVES`` corpus lines that hold no
template and have ``MOST_CHARS`` characters at most (those with the smallest hashes).  Its weights, ``FEATURES`` at most, are
joined by n-gram; only windows that hold a weighted n-gram go on.

Defined results: a null, empty or wordless text has no licence; a licence that stands
more than once counts in each place; repeated rows give one result row each; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .native import let

#: Bound of the negative sample, of the length of its lines and of the weights kept; probability that a family needs; template share that confirms.
NEGATIVES = 2000
MOST_CHARS = 4000
FEATURES = 20_000
SURE, CONFIRM = 0.7, 0.6
#: Words of a window, which begin at every half of it: no template's span is longer than that half.
WINDOW = 256
ROUNDS, STEP, DECAY = 200, 0.05, 1e-3

#: Short public notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."],
}
UNKNOWN = "unknown"
_LEADS = ["", "this file is ", "note: ", "copyright (c) 2020 the authors. ", "# ", "// "]
_TAILS = ["", " see the license file for details.", " please cite us.", " (c) 2021"]

#: What separates words; a full stop between digits, a hyphen or a plus inside a word belong to it.
_BREAK = r"[^\p{L}\p{N}.+-]+|\.(?!\d)|(?<!\d)\.|(?<![\p{L}\p{N}])[+-]+|[+-]+(?![\p{L}\p{N}])"


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _BREAK), lambda w: w != "")


def ngrams(ws: Column, least: int = 2) -> Column:
    """The set of word n-grams (up to three words) of a list of words, joined by spaces."""

    def of(w: Column, k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))
        return F.when(F.size(w) >= k, grams).otherwise(F.array().cast("array<string>"))

    return let(ws, lambda w: F.array_distinct(F.concat(*(of(w, k) for k in range(least, 4)))))


def _variants(text: str) -> list[str]:
    """Deterministic variants of a notice: led in, followed, and with one word left out."""
    words = text.split(" ")
    out = [lead + text + tail for lead in _LEADS for tail in _TAILS]
    if len(words) > 5:
        out += [" ".join(words[:i] + words[i + 1 :]) for i in range(1, len(words), 2)]
    return out


class Model:
    """Sparse softmax regression over n-gram sets; n-grams without a weight say nothing."""

    def __init__(self, classes: list[str], grams: list[str]):
        self.classes, self.grams = classes, {g: i for i, g in enumerate(grams)}
        self.weights = np.zeros((len(grams), len(classes)))
        self.bias = np.zeros(len(classes))
        self.temperature = 1.0

    def matrix(self, rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.grams)))
        for i, grams in enumerate(rows):
            x[i, [self.grams[g] for g in grams if g in self.grams]] = 1
        return x

    def probs(self, x: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = (x @ self.weights + self.bias) / (temperature or self.temperature)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Gradient descent with momentum on the class-balanced log loss."""
        share = 1 / np.bincount(y, minlength=len(self.classes)).clip(1)[y]
        want = np.eye(len(self.classes))[y]
        pace_w, pace_b = np.zeros_like(self.weights), np.zeros_like(self.bias)
        for _ in range(ROUNDS):
            off = (self.probs(x, 1.0) - want) * share[:, None]
            pace_w = 0.9 * pace_w - STEP * (x.T @ off + DECAY * self.weights)
            pace_b = 0.9 * pace_b - STEP * off.sum(axis=0)
            self.weights += pace_w
            self.bias += pace_b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on held-out rows."""
        loss = lambda t: -np.log(self.probs(x, t)[np.arange(len(y)), y].clip(1e-12)).sum()
        self.temperature = min((0.5 * 1.25**k for k in range(14)), key=loss) if len(y) else 1.0


def templates(spark) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("line")) for f, t in rows))))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.where(F.length("line") > 2)


def train(docs: DataFrame) -> Model:
    """Fits and calibrates on template variants and a bounded sample of corpus lines."""
    spark = docs.sparkSession
    marks = "(?i)licen[cs]e|copyright|rights reserved|public domain|creative commons|permission|redistribution|spdx"
    share = min(1.0, 4 * NEGATIVES / max(1, docs.count()))  # documents enough for the paragraphs wanted, at any size
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    lines = _lines(some).where((F.length("line") <= MOST_CHARS) & ~F.col("line").rlike(marks)).select("line", F.xxhash64("line").alias("k"))
    picked = lines.orderBy("k", "line").limit(NEGATIVES).select(F.lit(UNKNOWN).alias("family"), "line")
    variants = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(v).alias("line")) for f, ts in TEMPLATES.items() for t in ts for v in _variants(t))))
    )
    rows = variants.unionByName(picked).select("family", ngrams(line_words(F.col("line"))).alias("g"), F.pmod(F.xxhash64("line"), F.lit(5)).alias("fold")).collect()
    rows = sorted(rows, key=lambda r: (r.family, r.fold, r.g))
    classes = [UNKNOWN, *TEMPLATES]
    unknown = {g for r in rows if r.family == UNKNOWN for g in r.g}
    seen = Counter(g for r in rows if r.family != UNKNOWN for g in r.g if g not in unknown)
    model = Model(classes, [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]])
    x, y, fold = model.matrix([r.g for r in rows]), np.array([classes.index(r.family) for r in rows], dtype=int), np.array([r.fold for r in rows])
    model.fit(x[fold > 0], y[fold > 0])
    model.calibrate(x[fold == 0], y[fold == 0])
    return model


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, wd, ln): the words of each run of lines that aren't blank, and the line of each word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, r"\n[^\S\n]*(?=\n)")).alias("at", "text"))
    lines = F.transform(F.split("text", "\n"), line_words)
    rows = rows.where(F.length("text") > 2).select("doc_id", "h", "at", lines.alias("lines"))
    return rows.select("doc_id", "h", "at", F.flatten("lines").alias("wd"), F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x)))).alias("ln"))


def _places(spark) -> dict[str, list[dict]]:
    """For each n-gram of a template: its family, the n-gram's offset and the template's length."""
    out: dict[str, list[dict]] = {}
    for r in templates(spark).select("family", line_words(F.col("line")).alias("wd")).collect():
        for n in (2, 3):
            for i in range(len(r.wd) - n + 1):
                place = {"family": r.family, "off": i, "len": len(r.wd)}
                held = out.setdefault(" ".join(r.wd[i : i + n]), [])
                if place not in held:
                    held.append(place)
    return out


def _spans(hits: Column, ln: Column, first: Column) -> Column:
    """Where notices may stand in a window that begins at word first: [lo, hi) of each, in words of the paragraph."""
    wide = lambda n: F.greatest(F.lit(4), F.floor(n / 6).cast("int"))
    span = lambda lo, hi: F.struct(F.greatest(lo, first).cast("int").alias("lo"), F.least(hi, first + F.size(ln)).cast("int").alias("hi"))
    fitted = lambda x, p: let(x["pos"] - p["off"], lambda s: F.array(span(s, s + p["len"]), span(s - wide(p["len"]), s + p["len"] + wide(p["len"]))))
    by_template = F.flatten(F.flatten(F.transform(hits, lambda x: F.transform(F.coalesce(x["places"], F.array().cast(_PLACES)), lambda p: fitted(x, p)))))
    its_lines = F.array_distinct(F.transform(hits, lambda x: F.get(ln, x["pos"] - first)))
    by_line = F.transform(its_lines, lambda i: let(first + F.array_position(ln, i).cast("int") - 1, lambda lo: span(lo, lo + F.size(F.filter(ln, lambda y: y == i)))))
    return F.array_distinct(F.concat(by_template, by_line))


_PLACES = "array<struct<family:string,off:int,len:int>>"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, h, at, lo, hi, family, probability, confirmed, line): the spans of a sure family that overlap no better one of their
    paragraph; lo and hi bound the n-grams of the family, in words of the paragraph."""
    spark = docs.sparkSession
    model = model or train(docs)
    k = len(model.classes)
    places = _places(spark)
    listed = json.dumps([{"gram": g, "w": model.weights[i].tolist(), "places": places.get(g, [])} for g, i in model.grams.items()])
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<gram:string,w:array<double>,places:{_PLACES}>>")))
    wd, known = F.col("wd"), sorted({w for g in model.grams for w in g.split(" ")})

    def grams(w: Column, usable: Column, n: int) -> Column:
        """The n-grams of words that any n-gram with a weight has, with their places: others can't meet one."""
        at = F.filter(F.sequence(F.lit(0), F.size(w) - n), lambda i: reduce(lambda x, y: x & y, (F.get(usable, i + j) for j in range(n))))
        made = F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(n))).alias("gram")))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<struct<pos:int,n:int,gram:string>>"))

    hits = let(wd, lambda w: let(F.transform(w, lambda x: x.isin(known)), lambda u: F.concat(grams(w, u, 2), grams(w, u, 3))))
    held = _paragraphs(docs).select("doc_id", "h", "at", "wd", "ln", F.inline(hits))
    held = held.join(F.broadcast(weights), "gram")  # FEATURES rows
    half = F.floor(F.col("pos") / (WINDOW // 2)).cast("int")
    held = held.withColumn("half", F.explode(F.when(half > 0, F.array(half - 1, half)).otherwise(F.array(half))))
    first = F.col("half") * (WINDOW // 2)
    cut = lambda c: F.slice(c, first + 1, F.lit(WINDOW))
    held = held.select("doc_id", "h", "at", first.alias("first"), cut("wd").alias("wd"), cut("ln").alias("ln"), F.struct("pos", "n", "gram", "w", "places").alias("hit"))
    per = held.where(F.col("hit.pos") + F.col("hit.n") <= F.col("first") + F.size("wd")).groupBy("doc_id", "h", "at", "first", "wd", "ln").agg(F.collect_set("hit").alias("hits"))
    per = per.select("doc_id", "h", "at", "first", "wd", "hits", F.explode(_spans(F.col("hits"), F.col("ln"), F.col("first"))).alias("span"))
    lo, hi = F.col("span.lo"), F.col("span.hi")
    per = per.withColumn("hits", F.array_sort(F.filter("hits", lambda x: (x["pos"] >= lo) & (x["pos"] + x["n"] <= hi)))).where(F.size("hits") > 0)
    bias = F.array(*(F.lit(float(x)) for x in model.bias))
    once = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["gram"].alias("gram"), x["w"].alias("w")))))
    logits = F.aggregate(once, bias, lambda acc, x: F.zip_with(acc, x["w"], lambda a, b: a + b))
    per = per.withColumn("z", F.transform(logits, lambda x: x / model.temperature)).withColumn("top", F.array_max(F.slice("z", 2, k - 1)))
    total = let(F.array_max("z"), lambda most: F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - most)))
    per = per.withColumn("probability", F.exp(F.col("top") - F.array_max("z")) / total)
    named = F.element_at(F.array(*(F.lit(c) for c in model.classes[1:])), F.array_position(F.slice("z", 2, k - 1), F.col("top")).cast("int"))
    per = per.withColumn("guess", named).where(F.col("probability") >= SURE).withColumn("line", F.slice("wd", lo - F.col("first") + 1, hi - lo)).drop("z", "top", "wd")
    known = templates(spark).select("family", ngrams(line_words(F.col("line")), 1).alias("t")).groupBy("family").agg(F.collect_list("t").alias("ts"))
    per = per.join(F.broadcast(known), per["guess"] == known["family"], "left").drop("family")  # a row a family
    common = let(ngrams(F.col("line"), 1), lambda g: F.transform("ts", lambda t: F.struct((F.size(F.array_intersect(t, g)) / F.size(t)).alias("share"), F.size(F.array_intersect(t, g)).alias("held"))))
    per = per.withColumn("common", common)
    own = F.filter("hits", lambda x: F.exists(F.coalesce(x["places"], F.array().cast(_PLACES)), lambda p: p["family"] == F.col("guess")))
    own = let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(F.col("hits")))
    lo, hi = F.array_min(F.transform(own, lambda x: x["pos"])), F.array_max(F.transform(own, lambda x: x["pos"] + x["n"]))
    confirmed = F.exists("common", lambda x: x["share"] >= CONFIRM)
    best = F.array_max(F.transform("common", lambda x: F.when(~confirmed | (x["share"] >= CONFIRM), x["held"]).otherwise(0)))
    found = per.select("doc_id", "h", "at", F.struct((~confirmed).alias("open"), (-best).alias("less"), (hi - lo).alias("long"), lo.alias("lo"), hi.alias("hi"), F.col("guess").alias("family"), (-F.col("probability")).alias("p"), F.array_join("line", " ").alias("line")).alias("x"))
    listed = found.groupBy("doc_id", "h", "at").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    clear = lambda acc, x: ~F.exists(acc, lambda y: (y["lo"] < x["hi"]) & (x["lo"] < y["hi"]))
    none = F.slice("xs", 1, 0)
    kept = F.aggregate("xs", none, lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    out = listed.select("doc_id", "h", "at", F.explode(kept).alias("x"))
    return out.select("doc_id", "h", "at", "x.lo", "x.hi", "x.family", (-F.col("x.p")).alias("probability"), (~F.col("x.open")).alias("confirmed"), "x.line")


def licences(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_licences, families (confirmed, sorted), unconfirmed, probability (the least of the confirmed)."""
    found = scan(docs)
    per = found.groupBy("doc_id", "h").agg(
        F.count_if("confirmed").alias("n_licences"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.array_sort(F.collect_set(F.when(~F.col("confirmed"), F.col("family")))).alias("unconfirmed"),
        F.min(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    per = written(per, "licences")
    side = per.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "n_licences", "families", "unconfirmed", "probability")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    none = F.array().cast("array<string>")
    return rows.join(side, rows["doc_id"].eqNullSafe(side["__id"]) & (rows["h"] == side["__h"]), "left").select(
        rows["doc_id"], F.coalesce("n_licences", F.lit(0)).cast("bigint").alias("n_licences"), F.coalesce("families", none).alias("families"), F.coalesce("unconfirmed", none).alias("unconfirmed"), "probability"
    )
