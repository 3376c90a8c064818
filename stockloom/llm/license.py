"""Licence scans: which licence family each paragraph of a document grants.

A logistic regression over a paragraph's words and pairs of words tells the
families and an unknown class apart. It is trained here from notice templates,
from parts of them too small to mean anything, and from a bounded sample of
the corpus's own paragraphs; its temperature is calibrated on examples kept
apart. Scoring uses DataFrame functions only: n-grams are joined with the
model's weights, which most n-grams don't have, and summed by stretch: counts
have no bound, so a paragraph is scored in overlapping stretches of
``STRETCH`` words, and a notice inside a long one isn't outvoted. A prediction
is confirmed where the stretch holds enough of the word pairs of one of its
family's templates. A stretch whose pairs all belong to the notice that an
overlapping stretch holds more of is a part of that notice and not reported.

Paragraphs end at blank lines and at lines without a letter or digit, so that
wrapped notices stay whole. Lines of a paragraph that name a licence are scored
apart, too, so that neighbouring lines can grant several. Edge cases: a null or empty text has no paragraph with a
weight and no licence. Repeated rows are each reported. A paragraph counts once
for every family found in it. Of several licensed paragraphs the surest
confirmed one names the document's licence, ties go to the first family by
name. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

# Notices of public licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This software is distributed under the Apache License 2.0.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
#: A word: letters and digits, with points, hyphens or underscores between them; the same in Java and in Python.
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: What parts paragraphs; the same in Java and in Python.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: The end of a line inside a hyphenated word.
BROKEN = r"(?<=[\p{L}\p{N}])-[ \t\r]*\n[^\p{L}\p{N}\n]*"
#: Lines that are scored apart, too: every template has one of these words.
NAMES = r"(?i)licen|redistribut|permission|copyright|public|cc0"
#: Numbers of stretches begin anew by this for every line that is scored apart.
APART = 1_000_000_000
#: Words of a stretch and from one stretch's begin to the next; a notice of up to STRETCH - STEP + 1 words is whole in one of them.
STRETCH, STEP = 64, 30
#: Corpus texts and paragraphs for the unknown class (the classifier is fitted on this bounded sample).
TEXTS, PARAGRAPHS, LONGEST = 300, 3000, 20_000
#: Examples of a family, passes, step, weight of the penalty on the weights' absolute values.
EXAMPLES, EPOCHS, RATE, PENALTY = 120, 300, 2.0, 2e-5
#: Least probability of a family, and least share of a template's word pairs in a confirmed paragraph.
SURE, CONFIRMED = 0.5, 0.7


@dataclass
class Model:
    grams: list[str]
    weights: np.ndarray  # [grams, families]
    bias: np.ndarray
    temperature: float


def _words(paragraph: str) -> list[str]:
    import regex

    return regex.findall(WORD, paragraph.lower())


def _paragraphs(text: str) -> list[str]:
    import regex

    return [regex.sub(BROKEN, "-", p) for p in regex.split(BLANK, text)]


def _stretches(words: list[str]) -> list[list[str]]:
    """Overlapping stretches of a paragraph's words; the last one ends with it."""
    return [words[k : k + STRETCH] for k in range(0, max(1, len(words) - STRETCH + STEP), STEP)]


def _grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def _examples(r: np.random.Generator, background: list[list[str]]) -> tuple[list[list[str]], np.ndarray]:
    """Paragraphs as words and their classes."""
    out: list[tuple[list[str], int]] = []
    backdrop = [p for p in background if p] or [["the"]]
    some = lambda: backdrop[int(r.integers(len(backdrop)))]
    unknown = FAMILIES.index(UNKNOWN)
    for family, templates in TEMPLATES.items():
        for k in range(EXAMPLES):
            words = _words(templates[k % len(templates)])
            kept = [w for w in words if r.random() > 0.05 * (k % 3)]
            # a notice may stand anywhere in a stretch of prose
            before = int(r.integers(0, max(1, STRETCH - len(kept))))
            out.append(([*some()[:before], *kept, *some()[: int(r.integers(0, max(1, STRETCH - len(kept) - before)))]], FAMILIES.index(family)))
            # too little of one grants nothing
            size = max(1, len(words) // 3)
            at = int(r.integers(0, len(words) - size + 1))
            out.append(([*some()[:20], *words[at : at + min(size, 3)], *some()[:20]], unknown))
    out += [(p, unknown) for p in background]
    return [p for p, _ in out], np.array([y for _, y in out])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(background: list[str], seed: int = 9) -> Model:
    r = np.random.default_rng(seed)
    notices = [set(_words(t)) for ts in TEMPLATES.values() for t in ts]
    paragraphs = [w for p in background for w in _stretches(_words(p)) if not any(len(n & set(w)) >= CONFIRMED * len(n) for n in notices)]
    texts, label = _examples(r, paragraphs)
    # only n-grams of templates can speak for a family, so others need no weight
    known = sorted({g for ts in TEMPLATES.values() for t in ts for g in _grams(_words(t))})
    place = {g: k for k, g in enumerate(known)}
    table = np.zeros((len(texts), len(known)), np.float32)
    for k, words in enumerate(texts):
        for g in _grams(words):
            if g in place:
                table[k, place[g]] += 1
    test = r.random(len(texts)) < 0.2
    x, y = table[~test], np.eye(len(FAMILIES), dtype=np.float32)[label[~test]]
    w, b = np.zeros((len(known), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    seen = np.full(w.shape, 1e-3, np.float32)
    for _ in range(EPOCHS):
        error = (_softmax(x @ w + b) - y) / len(x)
        g = x.T @ error
        seen += g * g
        step = RATE * 0.1 / np.sqrt(seen)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        b -= RATE * error.sum(axis=0)
    scores, truth = table[test] @ w + b, label[test]
    grid = np.linspace(0.3, 3.0, 28)
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() if len(truth) else 0.0 for t in grid]
    # pairs stay for the comparison with templates, whatever they weigh
    used = np.flatnonzero((np.abs(w).max(axis=1) > 1e-3) | np.array([" " in g for g in known]))
    return Model([known[k] for k in used], w[used].astype(float), b.astype(float), float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Train with paragraphs of about TEXTS of the corpus's documents."""
    share = TEXTS / max(TEXTS, docs.count())
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = docs.where(draw & F.col(text).isNotNull() & (F.length(text) <= LONGEST)).select(F.col(text).cast("string").alias("t"))
    # in order, so that reruns see the same rows where one id stands on very many
    rows = drawn.orderBy(F.xxhash64("t"), "t").limit(2 * TEXTS).collect()
    # stretches, so that the sample holds as much text whatever the paragraphs' sizes
    found = sorted(" ".join(w) for r in rows for p in _paragraphs(r.t) for w in _stretches(_words(p)) if w)
    return train(found[:: max(1, len(found) // PARAGRAPHS)])


def _table(docs: DataFrame, **columns: list) -> DataFrame:
    """A small table of texts and numbers from one literal that SQL functions take apart."""
    lines = "\n".join("\t".join(v if isinstance(v, str) else repr(v) for v in row) for row in zip(*columns.values(), strict=True))
    cells = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line")).select(F.split("line", "\t").alias("cells"))
    numbers = {name: bool(values) and not isinstance(values[0], str) for name, values in columns.items()}
    return cells.select(*[(F.col("cells")[k].cast("double") if numbers[name] else F.col("cells")[k]).alias(name) for k, name in enumerate(columns)])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row, doc_id, line, stretch, family, probability and grams: every stretch that the classifier takes for a licence, and one row of line -1 for every document.

    Rows are numbered here and written, so that repeated rows stay apart and what was found finds its document again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.col(text).cast("string"), BLANK).alias("paragraphs"))
    lines = rows.select("row", "doc_id", F.posexplode(F.concat(F.array(F.lit("")), F.coalesce("paragraphs", F.array().cast("array<string>")))).alias("line", "paragraph"))
    lines = lines.withColumn("line", F.col("line") - 1)
    single = F.filter(F.split("paragraph", "\n"), lambda x: F.col("paragraph").contains("\n") & x.rlike(NAMES))
    lines = lines.select("row", "doc_id", "line", F.posexplode(F.concat(F.array("paragraph"), single)).alias("unit", "paragraph"))
    found = F.regexp_extract_all(F.lower(F.regexp_replace("paragraph", BROKEN, "-")), F.lit(WORD), F.lit(0))
    words = lines.select("row", "doc_id", "line", "unit", F.when(F.col("line") < 0, F.array(F.lit(""))).otherwise(found).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - STRETCH) / STEP)).cast("int"))
    parts = words.select("row", "doc_id", "line", "unit", F.posexplode(F.transform(starts, lambda k: F.slice("words", k * STEP + 1, STRETCH))).alias("stretch", "words"))
    parts = parts.withColumn("stretch", F.col("unit") * F.lit(APART).cast("long") + F.col("stretch")).drop("unit")
    pairs = parts.select("row", "doc_id", "line", "stretch", F.inline(F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), F.size("words")).alias("after"))))
    # both tables have at most as many rows as the model has n-grams; the empty word is the document's own row
    firsts = ["", *sorted({g.split(" ")[0] for g in model.grams})]
    pairs = pairs.join(F.broadcast(_table(docs, word=firsts)), "word")
    grams = pairs.select("row", "doc_id", "line", "stretch", F.explode(F.array(F.col("word"), F.concat("word", F.lit(" "), "after"))).alias("gram"))
    names = [f"w{k}" for k in range(len(FAMILIES))]
    weights = _table(docs, gram=["", *model.grams], **{n: [0.0, *(float(v) for v in model.weights[:, k])] for k, n in enumerate(names)})
    keys = ["row", "doc_id", "line", "stretch"]
    summed = grams.join(F.broadcast(weights), "gram").groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], F.collect_set("gram").alias("grams"))
    scores = F.array(*[(F.col(n) + float(model.bias[k])) / model.temperature for k, n in enumerate(names)])
    found = summed.select(*keys, "grams", scores.alias("scores")).withColumn("top", F.array_max("scores"))
    # the softmax of the best score, and the first family that has it
    probability = 1 / F.aggregate("scores", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("scores", F.col("top")).cast("int"))
    found = found.select(*keys, "grams", family.alias("family"), probability.alias("probability"))
    return materialize(found.where((F.col("line") < 0) | ((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE))), "license-stretches")


def confirmations(found: DataFrame) -> DataFrame:
    """Licensed stretches with confirmed, template_share and the template's pairs held: their pairs of words against those of their family's templates."""
    listed = [(f, sorted({g for g in _grams(_words(t)) if " " in g})) for f, ts in TEMPLATES.items() for t in ts]
    templates = _table(found, family=[f for f, _ in listed], template=[";".join(g) for _, g in listed])
    held = found.where("line >= 0").join(F.broadcast(templates), "family")
    both = held.withColumn("held", F.array_sort(F.array_intersect(F.split("template", ";"), "grams")))
    best = F.max(F.struct((F.size("held") / F.size(F.split("template", ";"))).alias("share"), "held"))
    found = both.groupBy("row", "line", "stretch", "family", "probability").agg(best.alias("best"))
    return found.select("row", "line", "stretch", "family", "probability", (F.col("best.share") >= CONFIRMED).alias("confirmed"), F.col("best.share").alias("template_share"), "best.held")


def notices(found: DataFrame) -> DataFrame:
    """One row for every paragraph and family of ``found``, without stretches that hold just a part of what an overlapping one holds."""
    along = Window.partitionBy("row", "line").orderBy("stretch")
    part = F.lit(False)
    for other in (F.lag, F.lead):
        near = other(F.struct("stretch", "family", "held")).over(along)
        within = (F.size(F.array_except("held", near["held"])) == 0) & (F.size("held") < F.size(near["held"]))
        part = part | F.coalesce((F.abs(near["stretch"] - F.col("stretch")) == 1) & (near["family"] != F.col("family")) & within, F.lit(False))
    # a line apart counts if it holds a notice, and not if a stretch of the paragraph holds more of the same words
    whole = F.collect_set(F.when(F.col("stretch") < APART, F.struct("family", "held"))).over(Window.partitionBy("row", "line"))
    more = F.exists(whole, lambda x: (x["family"] != F.col("family")) & (F.size(F.array_except("held", x["held"])) == 0) & (F.size("held") < F.size(x["held"])))
    part = part | ((F.col("stretch") >= APART) & (~F.col("confirmed") | more))
    kept = found.withColumn("part", part).where(~F.col("part"))
    best = F.max(F.struct("confirmed", "probability", "template_share"))
    return kept.groupBy("row", "line", "family").agg(best.alias("best")).select("row", "line", "family", "best.*")


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, license (null: none), probability, n_confirmed, n_unconfirmed and families of every document."""
    stretches = scored(docs, model, text)
    found = notices(confirmations(stretches)).groupBy("row").agg(
        F.max_by(F.struct("family", "probability"), F.when(F.col("confirmed"), F.struct("probability", "template_share", -F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))))).alias("best"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"),
        F.count(F.when(~F.col("confirmed"), 1)).alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    )
    out = stretches.where("line < 0").select("row", "doc_id").join(found, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.col("best.family").alias("license"), F.coalesce("best.probability", F.lit(0.0)).alias("probability"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), F.coalesce("families", F.lit("")).alias("families"),
    )
