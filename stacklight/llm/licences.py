"""Licence scan of paragraphs: sparse word n-gram logistic regression with an unknown class calibrated on held-out paragraphs,
confirmed against templates. Notices that are wrapped over several lines are found too.

DataFrame and SQL functions only, training included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import remove, table, written_at
from stacklight.llm.oph import let

#: Hashed n-gram features; words of an n-gram at most.
DIMENSION, NGRAM = 1 << 13, 2
#: Paragraphs of the corpus that may teach the unknown class: those of at most so many documents, the smallest hashes of ids first.
SAMPLE = 400
#: A prediction stands if it is at least so probable and the paragraph has at least this share of a template's word pairs.
PROBABLE, ALIKE = 0.5, 0.8
UNKNOWN = "unknown"
#: Lines of at most so many characters may be parts of a wrapped notice, which takes at most so many lines.
WRAPPED, LINES = 120, 8
#: Paragraphs of more words are judged in windows of so many, each beginning half a window after the last.
WINDOW = 150
#: One in so many training paragraphs is held out for the calibration.
HELD = 5

#: Notices by licence family, as their publishers word them (fixed values).
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl-3.0": ["licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0.", "Dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}

#: Paragraphs that sound like notices and are none.
NOT_NOTICES = [
    "The driver was asked for a license and a version of the story.", "Human rights are reserved for all who work under the law.", "The general public may use the park free of charge.",
    "This work is in two versions.", "He was released under bail.", "A table was reserved for all.", "The terms of the contract are met.", "by and under the law of the sea", "in the public interest", "version 3",
    "Apache helicopters flew over the town.", "MIT is a university.", "the foundation of the house", "with or without you", "a copy of this letter", "the following conditions", "Permission was denied.",
    "All rights", "the license", "4.0", "2.0", "licensed drivers only", "for any purpose", "to any person", "copyright law", "an international driving license", "work", "the source of the river", "this file", "binary stars",
]


def words(paragraph: Column) -> Column:
    clean = F.split(F.lower(paragraph), "[^\\p{L}\\p{N}]+")
    return F.filter(clean, lambda w: w != "")


def pairs(w: Column) -> Column:
    """array<long>: hashes of neighbouring words; of a single word, of that."""
    n = F.size(w)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.transform(w, lambda x: F.xxhash64(x)))


def features(w: Column) -> Column:
    """array<int>: the distinct hashed words and word pairs."""
    n = F.size(w)
    two = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<long>"))
    both = F.concat(F.transform(w, lambda x: F.xxhash64(x)), two)
    return F.array_distinct(F.transform(both, lambda h: F.pmod(h, F.lit(DIMENSION)).cast("int")))


def _numbers(values: list, kind: str) -> Column:
    """A constant array, written as one string that is parsed once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@dataclass
class Scanner:
    """Logits are intercepts + the sum of the rows `weights` of the features present; row 0 of `weights` is zero and
    `row` gives each feature's row. A paragraph none of whose features has a row is unknown."""

    families: list[str]
    intercepts: list[float]
    row: list[int]
    weights: list[float]
    #: The calibration: a notice of the best family has probability 1 / (1 + exp(-(scale * margin + shift))).
    scale: float = 1.0
    shift: float = 0.0
    #: The share of the held-out paragraphs that are told rightly.
    held_out: float = float("nan")

    def best(self, feats: Column) -> Column:
        """struct(p, k): the likeliest family, and the calibrated probability that the paragraph is a notice of it; the
        rest is the unknown class's. The margin is the family's logit less the unknown class's."""
        k = len(self.families)
        row, weights = _numbers(self.row, "int"), _numbers(self.weights, "double")

        def told(rows: Column) -> Column:
            margins = F.array(*[_logit(rows, weights, self.intercepts[j], k, j) for j in range(1, k)])
            unknown = _logit(rows, weights, self.intercepts[0], k, 0)
            return let(margins, lambda z: let(F.array_max(z), lambda top: F.struct((1 / (1 + F.exp(-(self.scale * (top - unknown) + self.shift)))).alias("p"), F.array_position(z, top).cast("int").alias("k"))))

        return let(F.filter(F.transform(feats, lambda f: F.get(row, f)), lambda r: r > 0), told)


def _logit(rows: Column, weights: Column, intercept: float, k: int, j: int) -> Column:
    return F.aggregate(rows, F.lit(float(intercept)), lambda s, r: s + F.get(weights, r * k + j))


def _variants(text: str) -> list[str]:
    """A template as it stands, shortened at either end, and with what often stands before and after it."""
    w = text.split()
    out = [text, text.upper(), f"Copyright (c) 2021 The Authors. {text}", f"{text} See the file LICENSE.", f"Note: {text}", f"This page: {text} All others, see below."]
    if len(w) > 4:
        out += [" ".join(w[1:]), " ".join(w[:-1])]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scanner:
    """Fits multinomial logistic regression with an L1 penalty on variants of the templates, alone and between words of the
    corpus, and as unknown on NOT_NOTICES and on paragraphs of at most `sample` documents that share under half of any
    template's word pairs; of these at most ten for each document.

    One in HELD of these paragraphs, by hash, takes no part in the fit: the probability that a paragraph is a notice of its best family is
    calibrated on them, as a logistic function of the margin over the unknown class (Platt's scaling, with smoothed targets). The unknown
    class weighs as much as all families together, so probabilities hold for paragraphs that are as likely a notice as not.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *TEMPLATES]
    known = [(families.index(f), v) for f, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    known += [(0, v) for t in NOT_NOTICES for v in (t, f"{t} {t}")]
    given = spark.createDataFrame([(n, *x) for n, x in enumerate(known)], "n int, label int, p string")
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    few = few.join(F.broadcast(few.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)), "id")  # at most `sample` ids
    seen = few.select(F.explode(F.split("t", "\n")).alias("p")).where("length(p) > 0")
    told = [t for ts in template_pairs(spark).values() for t in ts]
    alike = let(_hits(words(F.col("p")), told), lambda h: F.when(F.size(h) > 1, _most(told)(h)).otherwise(0.0))  # no template has a single pair
    seen = seen.where(alike < 0.5).orderBy(F.xxhash64("p"), "p").limit(10 * sample)
    seen, seen_at = written_at(seen, "paragraphs")
    around = seen.select(F.pmod(F.xxhash64("p"), F.lit(len(known))).cast("int").alias("n"), F.array_join(F.slice(F.split("p", " "), 1, 40), " ").alias("a"))
    around = around.groupBy("n").agg(F.min("a").alias("a"), F.max("a").alias("b"))  # one row for each variant at most
    mixed = given.join(F.broadcast(around), "n").select("label", F.concat_ws(" ", "a", "p", "b").alias("p"))
    rows = given.select("label", "p").unionByName(mixed).unionByName(seen.select(F.lit(0).alias("label"), "p"))
    rows = rows.select("label", (F.pmod(F.xxhash64("p", F.lit("held out")), F.lit(HELD)) == 0).alias("held"), let(words(F.col("p")), features).cast("array<string>").alias("f")).where("size(f) > 0")
    rows, rows_at = written_at(rows, "notices")
    rows = rows.join(F.broadcast(rows.groupBy("label", "held").count()), ["label", "held"])  # two rows for each family
    rows = rows.withColumn("w", F.when(F.col("label") == 0, len(TEMPLATES) * 200.0).otherwise(200.0) / F.col("count")).coalesce(1)
    fit = rows.where(~F.col("held"))
    counter = CountVectorizer(inputCol="f", outputCol="features", minDF=2, binary=True, vocabSize=DIMENSION).fit(fit)
    model = LogisticRegression(weightCol="w", family="multinomial", regParam=2e-4, elasticNetParam=1.0, standardization=False, maxIter=30).fit(counter.transform(fit).select("label", "features", "w"))
    scale, shift, right = _calibrated(model.transform(counter.transform(rows.where("held")).select("label", "features", "w")))
    for path in (seen_at, rows_at):
        remove(spark, path)
    matrix = model.coefficientMatrix.toArray()
    k = len(families)
    row, weights = [0] * DIMENSION, [0.0] * k
    for j, name in enumerate(counter.vocabulary):
        column = matrix[:, j]
        if abs(column[1:] - column[0]).max() > 1e-9:
            row[int(name)] = len(weights) // k
            weights += [round(float(x), 6) for x in column]
    return Scanner(families, [float(x) for x in model.interceptVector], row, weights, scale, shift, right)


def _calibrated(held: DataFrame) -> tuple[float, float, float]:
    """(scale, shift) of the calibration and the share of paragraphs told rightly at PROBABLE, from predictions for held-out paragraphs."""
    logits = held.select("label", "w", vector_to_array("rawPrediction").alias("z")).select("label", "w", F.col("z")[0].alias("u"), F.slice("z", 2, len(TEMPLATES)).alias("z"))
    top = F.array_max("z")
    at = logits.select("label", "w", (top - F.col("u")).alias("margin"), (F.array_position("z", top) == F.col("label")).alias("y")).cache()
    n = at.agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no")).first()
    target = F.when(F.col("y"), (n.yes + 1) / (n.yes + 2)).otherwise(1 / (n.no + 2))
    both = at.select("margin", F.explode(F.array(F.struct(F.lit(1.0).alias("is"), (F.col("w") * target).alias("v")), F.struct(F.lit(0.0).alias("is"), (F.col("w") * (1 - target)).alias("v")))).alias("o")).select("margin", "o.*")
    both = VectorAssembler(inputCols=["margin"], outputCol="features").transform(both)
    line = LogisticRegression(labelCol="is", weightCol="v", maxIter=50).fit(both)
    scale, shift = float(line.coefficients[0]), float(line.intercept)
    sure = 1 / (1 + F.exp(-(scale * F.col("margin") + shift))) >= PROBABLE
    right = at.agg(F.avg(F.when(sure, F.col("y")).otherwise(F.col("label") == 0).cast("int"))).first()[0]
    at.unpersist()
    return scale, shift, float(right)


def template_pairs(spark: SparkSession) -> dict[str, list[list[int]]]:
    """The distinct word pairs of each family's templates, as hashes."""
    flat = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    got = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(flat)], "k int, t string").select("k", F.array_distinct(pairs(words(F.col("t")))).alias("h")).collect()
    out: dict[str, list[list[int]]] = {f: [] for f in TEMPLATES}
    for r in sorted(got, key=lambda r: r.k):
        out[flat[r.k][0]].append(list(r.h))
    return out


def _share(template: list[int]):
    """The share of a template's word pairs that an array of word pairs has."""
    return lambda have: F.size(F.array_intersect(_numbers(template, "bigint"), have)) / len(template)


def _hits(w: Column, templates: list[list[int]]) -> Column:
    """The word pairs that any template has. A paragraph with fewer than two has less than ALIKE of every template."""
    return F.filter(pairs(w), lambda h: h.isin(sorted({h for t in templates for h in t})))


def scan(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """`docs` with n_paragraphs and licences, array<struct<paragraph, family, probability, alike>> of each paragraph (a line) that
    is a notice: its most probable family has PROBABLE or more, and it has ALIKE or more of one of the family's templates' pairs. Columns of
    these names are replaced. An empty table stays empty.

    A notice wrapped over lines of at most WRAPPED characters is looked for in the LINES lines from each line that has a
    template's pair and is no notice by itself; it is told with its first line, unless one of these lines is itself a notice of
    the family. Of such finds that overlap and are of one family, the one with most of a template counts, the last of equal ones.
    Comment marks and blank lines between do not matter. In lines of over WINDOW words each window is judged, and the most probable one tells.

    Null and empty texts are one empty paragraph without licence. Each row is scanned by itself: repeated rows get equal
    results, no rows meet in a shuffle, long texts take time in proportion, other columns are kept.
    """
    names = F.array(*map(F.lit, scanner.families))
    templates = template_pairs(docs.sparkSession)
    every = [t for ts in templates.values() for t in ts]
    none = F.struct(F.lit(False).alias("sure"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("alike"), F.lit(UNKNOWN).alias("family"))

    def judged(w: Column, hits: Column) -> Column:
        """struct(sure, probability, alike, family) of words."""

        def with_best(b: Column) -> Column:
            alike = F.lit(0.0)
            for k, ts in enumerate(templates.values(), 1):
                alike = F.when(b["k"] == k, _most(ts)(hits)).otherwise(alike)
            return let(alike, lambda a: F.struct(((b["p"] >= PROBABLE) & (a >= ALIKE)).alias("sure"), b["p"].alias("probability"), a.alias("alike"), F.get(names, b["k"]).alias("family")))

        return F.when(F.size(hits) < 2, none).otherwise(let(features(w), lambda f: let(scanner.best(f), with_best)))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
        return F.array_max(F.transform(starts, lambda s: let(F.slice(w, s + 1, WINDOW), lambda v: let(_hits(v, every), lambda h: judged(v, h)))))

    def line(text: Column) -> Column:
        def of(w: Column) -> Column:
            part = F.when(F.length(text) <= WRAPPED, w).otherwise(F.slice(w, 1, 0))
            return let(F.size(_hits(w, every)), lambda n: F.struct(part.alias("w"), n.alias("n"), F.when(n < 2, none).otherwise(windows(w)).alias("j")))

        return let(words(text), of)

    def wrapped(lines: Column):
        def at(x: Column, i: Column) -> Column:
            begins = (x["n"] > 0) & (F.size(x["w"]) > 0) & ~x["j"]["sure"] & (i + 1 < F.size(lines))
            return F.when(begins, let(F.flatten(F.transform(F.slice(lines, i + 1, LINES), lambda y: y["w"])), windows)).otherwise(none)

        return at

    def found(lines: Column, over: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            def notice(j: Column) -> Column:
                return F.struct((i + 0).alias("paragraph"), *[j[c].alias(c) for c in ("family", "probability", "alike")])

            def first(b: Column) -> Column:
                same = lambda y: y["sure"] & (y["family"] == b["family"])
                alone = ~F.exists(F.slice(lines, i + 1, LINES), lambda y: same(y["j"]))
                later = F.exists(F.slice(over, i + 2, LINES - 1), lambda y: same(y) & (y["alike"] >= b["alike"]))
                earlier = F.exists(F.slice(over, F.greatest(i - LINES + 2, F.lit(1)), F.least(i, F.lit(LINES - 1))), lambda y: same(y) & (y["alike"] > b["alike"]))
                return F.when(b["sure"] & alone & ~later & ~earlier, notice(b))

            return F.when(x["j"]["sure"], notice(x["j"])).otherwise(let(F.get(over, i), first))

        return F.filter(F.transform(lines, at), lambda x: x.isNotNull())

    paragraphs = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    licences = let(F.transform(paragraphs, line), lambda ls: let(F.transform(ls, wrapped(ls)), lambda over: found(ls, over)))
    return docs.withColumns({"n_paragraphs": F.size(paragraphs).cast("long"), "licences": licences})


def _most(templates: list[list[int]]):
    def of(have: Column) -> Column:
        shares = [_share(t)(have) for t in templates]
        return F.greatest(*shares) if len(shares) > 1 else shares[0]

    return of


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    best = F.array_max(F.transform("licences", lambda x: F.struct(x["probability"].alias("p"), x["family"].alias("f"))))
    return found.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licensed"), best["f"].alias("family"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
    )
