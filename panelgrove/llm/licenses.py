"""Licence scan of paragraphs, in DataFrame functions and Spark's own learners only.

A paragraph is a block between blank lines. Its lines are scored each, so that notices one after another
are told apart, and the whole block once more, so that a notice wrapped over lines is read as one.
Features are the word n-grams (two and three words) of the licence templates, but for those of
function words alone; every line that holds one is scored, and one without any is ``unknown``.
Multinomial logistic regression learns the families from the templates and parts of them, and class
``unknown`` from sentences that name no family and from lines of the corpus that share a few n-grams
with templates. The probability is calibrated on held-out parts of templates, held-out sentences and
lines of the corpus the fit has not seen: a logistic fit of whether the first guess is right. From
``LEAST`` on a family is believed. A prediction is confirmed where the paragraph holds most of the
n-grams of one of the family's templates.

All paragraphs of whole texts are scanned. The corpus sample that the fit reads is bounded (about
``SAMPLE_DOCS`` documents and at most ``SAMPLE_LINES`` lines, both picked by a hash).

Defined cases: null and empty texts have no paragraphs; rows are judged one by one, so repeated
rows get equal results; of several findings of a family in a paragraph the first line and the highest
probability are given; ties go to the family that sorts first; very long texts are read whole; an empty
table gives an empty one. Of clashing names, ``n_paragraphs`` and ``licenses`` are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

SAMPLE_DOCS, SAMPLE_LINES = 400, 4000
#: Least calibrated probability of a family.
LEAST = 0.5
#: A corpus line with more n-grams of templates than this may be a notice, and is no example of "unknown".
FEW = 2
#: Share of a template's n-grams that confirms a family.
CONFIRM = 0.6
UNKNOWN = "unknown"

# Short public notices of licence families.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Copyright Example Inc. All rights reserved. Proprietary and confidential.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
}
#: Sentences that speak of licences and name no family. Every second one is held out.
NO_FAMILY = [
    "See the license file for details.",
    "Please read the license before you use the software.",
    "The license of this work is not known.",
    "A copy of the license is kept with this file.",
    "Licensed under terms that are described elsewhere.",
    "This software is distributed under its own license.",
    "Released under a license.",
    "Released under terms of the owner.",
    "This work is licensed under other terms.",
    "This work is licensed under an agreement with the publisher.",
    "Copyright notice.",
    "The copyright holder gave written permission to the museum.",
    "The driving license was issued in the general public office.",
    "The general public may use the library free of charge.",
    "Version 2.0 of the program will be released under a new name.",
    "Version 3 of this software was distributed to the public.",
    "Permission to use this file was granted by the office.",
    "Subject to the following conditions, any person may enter the building.",
    "The names of contributors may be used in the documentation.",
    "The source code must be kept in binary form with the documentation.",
    "All rights of the tenants were discussed.",
    "The rights to use the garden are limited.",
    "You may not use this door.",
    "You should have received a copy of the letter.",
]
#: Function words; n-grams of these alone tell nothing.
FUNCTION_WORDS = "a an and any are as at be by can for from if in is it its may must not of on one or other shall should so that the their this to under was which will with you your".split()


def _words(p: Column) -> Column:
    return F.filter(F.split(F.lower(p), r"[^\p{L}0-9]+", -1), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Runs of two or three words."""
    last = F.size(words) - (n - 1)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    made = pairs if n == 2 else F.zip_with(F.slice(pairs, F.lit(1), last), F.slice(words, F.lit(3), last), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(last > 0, made).otherwise(F.array().cast("array<string>"))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def _hits(words: Column, vocabulary: list[str]) -> Column:
    """The distinct n-grams of the vocabulary that a list of words holds. Each of three words has one of
    two words, so those are looked for first."""
    two, three = ([g for g in vocabulary if g.count(" ") == n] for n in (1, 2))

    def more(w: Column) -> Column:
        pairs = F.filter(_runs(w, 2), lambda g: g.isin(two))
        return _let(pairs, lambda x: F.when(F.size(x) > 0, F.array_distinct(F.concat(x, F.filter(_runs(w, 3), lambda g: g.isin(three))))).otherwise(x))

    return _let(words, more)


@dataclass
class Model:
    """Weights by n-gram, the templates' n-grams, and the calibration (slope and intercept on log-odds)."""

    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    templates: list[tuple[str, list[str]]]
    slope: float
    intercept: float
    #: Held-out examples: families guessed right or not, and ``unknown`` taken for a family or not.
    held_out: dict[str, int]


def _telling(p: str) -> list[str]:
    """The n-grams of a template, but for those of function words alone."""
    words = [w for w in re.split(r"[\W_]+", p.lower()) if w]
    grams = {tuple(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}
    return sorted(" ".join(g) for g in grams if not set(g) <= set(FUNCTION_WORDS))


def _fit(rows: DataFrame, label: str, penalty: float):
    learner = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=penalty, maxIter=80, standardization=False)
    return learner.fit(rows.coalesce(1))  # a bounded table: one task


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    spark = docs.sparkSession
    templates = [(f, _telling(t)) for f, own in sorted(TEMPLATES.items()) for t in own]
    vocabulary = sorted({g for _, own in templates for g in own})
    families = [*sorted(TEMPLATES), UNKNOWN]
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / n) if n else 1.0
    picked = docs.where(F.col(text).isNotNull()).filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1))
    lines = picked.select(F.explode(F.split(text, "\n", -1)).alias("p")).distinct()
    few = lines.withColumn("g", _hits(_words(F.col("p")), vocabulary)).where(F.size("g").between(1, FEW))
    sample = few.orderBy(F.xxhash64("p"), "p").limit(SAMPLE_LINES).select(F.lit(UNKNOWN).alias("family"), "g", (F.pmod(F.xxhash64("p"), F.lit(2)) == 0).alias("seen"))
    # Whole templates and their halves teach that a part of a notice tells the family too; the middles are held out.
    known = [(f, t, True) for f, own in sorted(TEMPLATES.items()) for t in own] + [(UNKNOWN, t, i % 2 == 0) for i, t in enumerate(NO_FAMILY)]
    w = _words(F.col("p"))
    half = F.ceil(F.size(w) / 2).cast("int")
    middle = F.slice(w, F.floor(F.size(w) / 4).cast("int") + 1, half)
    rows = spark.createDataFrame(known, "family string, p string, seen boolean")
    parts = rows.select("family", "seen", F.explode(F.array(w, F.slice(w, F.lit(1), half), F.slice(w, half, F.size(w)))).alias("w"))
    held = rows.where((F.col("family") != UNKNOWN) & (F.size(w) >= 8)).select("family", F.lit(False).alias("seen"), middle.alias("w"))
    examples = parts.unionByName(held).select("family", _hits(F.col("w"), vocabulary).alias("g"), "seen").unionByName(sample)
    number = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "g", "features", minTF=1.0)
    examples = settle(examples.where(F.size("g") > 0).select("family", number.alias("label"), "g", "seen"), "licence-examples")
    # Equal examples of the corpus are many: together they weigh as much as a few templates.
    data = vectors.transform(examples.where("seen")).groupBy("label", "features").agg(F.least(F.count("*").cast("double"), F.lit(50.0)).alias("weight"))
    fitted = _fit(data, "label", 0.002)
    coefficients = fitted.coefficientMatrix.toArray()
    bias = fitted.interceptVector.toArray().tolist()
    weights = {g: coefficients[:, i].tolist() for i, g in enumerate(vocabulary)}
    model = Model(families, bias + [0.0] * (len(families) - len(bias)), weights, templates, 1.0, 0.0, {})
    guess = examples.where("not seen").select("family", _let(_scores(model, F.col("g")), lambda x: _guess(model, x)).alias("r"))
    guess = settle(guess.select("family", "r.family", "r.odds").toDF("family", "guess", "odds"), "licence-held-out")
    truth = guess.select(((F.col("family") == F.col("guess")) & (F.col("family") != UNKNOWN)).cast("double").alias("right"), array_to_vector(F.array("odds")).alias("features"), F.lit(1.0).alias("weight"))
    if truth.agg(F.count_distinct("right")).first()[0] == 2:
        own = _fit(truth, "right", 0.001)
        if own.coefficients[0] > 0:
            model.slope, model.intercept = float(own.coefficients[0]), float(own.intercept)
    believed = F.col("odds") * model.slope + model.intercept >= math.log(LEAST / (1 - LEAST))
    counts = guess.groupBy((F.col("family") == UNKNOWN).alias("unknown"), believed.alias("believed"), (F.col("family") == F.col("guess")).alias("right")).count().collect()
    for r in counts:
        name = ("unknown_taken" if r["believed"] else "unknown_left") if r["unknown"] else ("family_right" if r["believed"] and r["right"] else "family_missed")
        model.held_out[name] = model.held_out.get(name, 0) + r["count"]
    return model


def _scores(model: Model, hits: Column) -> Column:
    """Log-odds of the classes, in their order, up to a common term."""
    known = F.create_map(*[F.lit(x) for g, w in sorted(model.weights.items()) for x in (g, w)])
    return F.aggregate(hits, F.lit(model.bias), lambda acc, g: F.zip_with(acc, F.try_element_at(known, g), lambda a, b: a + b))


def _guess(model: Model, scores: Column) -> Column:
    """The likeliest family (but ``unknown``) and its log-odds against all other classes."""
    names = F.lit(model.families)
    own = F.slice(scores, 1, len(model.families) - 1)

    def odds(best: Column) -> Column:
        at = F.array_position(own, best).cast("int")
        rest = F.aggregate(F.transform(scores, lambda v, i: F.when(i + 1 != at, F.exp(v - best)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        return F.struct(names[at - 1].alias("family"), (-F.log(F.greatest(rest, F.lit(1e-300)))).alias("odds"))

    return _let(F.array_max(own), odds)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs`` (blocks that are not blank) and ``licenses``: for each family
    found in a paragraph the ``paragraph`` (from 0, blank ones left out), the ``line`` in it, ``family``,
    ``probability`` and ``confirmed``."""
    vocabulary = sorted(model.weights)
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n[ \t\r]*\n", -1), lambda p: F.rlike(p, F.lit(r"\S")))
    shown = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(g).alias("grams")) for f, g in model.templates])

    def judged(unit: Column) -> Column:
        def made(r: Column) -> Column:
            return F.struct(unit["line"].alias("line"), r["family"].alias("family"), (1 / (1 + F.exp(-(r["odds"] * model.slope + model.intercept)))).alias("probability"))

        return _let(_let(_scores(model, unit["hits"]), lambda s: _guess(model, s)), made)

    def found(p: Column, number: Column) -> Column:
        lines = F.transform(F.split(p, "\n", -1), lambda x, i: F.struct(i.alias("line"), _hits(_words(x), vocabulary).alias("hits")))

        def read(own: Column) -> Column:
            return _let(_hits(_words(p), vocabulary), lambda whole: named(own, whole))

        def named(own: Column, whole: Column) -> Column:
            units = F.concat(own, F.when(F.size(own) > 1, F.array(F.struct(own[0]["line"].alias("line"), whole.alias("hits")))).otherwise(F.array().cast(_UNITS)))
            good = F.filter(F.transform(units, judged), lambda r: r["probability"] >= LEAST)
            return _let(good, lambda g: F.transform(F.array_sort(F.array_distinct(F.transform(g, lambda r: r["family"]))), lambda f: one(f, F.filter(g, lambda r: r["family"] == f), whole)))

        def one(family: Column, own: Column, whole: Column) -> Column:
            confirmed = F.exists(shown, lambda t: (t["family"] == family) & (F.size(F.array_intersect(whole, t["grams"])) >= F.lit(CONFIRM) * F.size(t["grams"])))
            line, probability = F.array_min(F.transform(own, lambda r: r["line"])), F.array_max(F.transform(own, lambda r: r["probability"]))
            return F.struct(number.alias("paragraph"), line.alias("line"), family.alias("family"), probability.alias("probability"), confirmed.alias("confirmed"))

        return _let(F.filter(lines, lambda x: F.size(x["hits"]) > 0), lambda own: F.when(F.size(own) > 0, read(own)).otherwise(F.array().cast(_FOUND)))

    return docs.withColumns({"n_paragraphs": F.size(blocks).cast("long"), "licenses": F.flatten(F.transform(blocks, found))})


_UNITS = "array<struct<line:int,hits:array<string>>>"
_FOUND = "array<struct<paragraph:int,line:int,family:string,probability:double,confirmed:boolean>>"


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    best = F.array_max(F.transform("licenses", lambda r: r["probability"]))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("long").alias("n_license_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda r: r["family"]))), ",").alias("families"),
        F.size(F.filter("licenses", lambda r: r["confirmed"])).cast("long").alias("n_confirmed"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
