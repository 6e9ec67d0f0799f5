"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is what stands between newlines. Besides the whole paragraph, its sentences and its windows of ``WINDOW`` words, half
of them apart, are judged where they hold at least two word pairs of templates; of these only the words of such pairs are
classified, so that prose around a notice doesn't hide it. A paragraph has at most one notice of a family. Spark's multinomial logistic regression over hashed word pairs and triples
tells licence families and the class ``unknown`` apart. It is trained on ``TEMPLATES``, as whole paragraphs, halves and sentences, and for
``unknown`` on at most ``UNKNOWN`` paragraphs, the first in the order of a hash, of about as many documents drawn by a hash;
paragraphs that share a word triple with a template are left out.

* Calibration: half of those paragraphs are kept out of the training. A family is only predicted at a probability above all
  that it is given on the half kept out, and of at least ``FLOOR``.
* Confirmation: a prediction counts if the paragraph and some template of that family share at least ``SHARED`` of the word
  pairs of the shorter of the two.

Nulls: a null or empty text has no paragraphs; paragraphs of fewer than two words are unknown. Rows of the same ``doc_id`` are
reported together, those without one too. An empty table gives no rows. Without any paragraph for ``unknown`` no
prediction is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import settle
from .keys import share_of

UNKNOWN = 4_000
FEATURES = 1 << 13
FLOOR = 0.5
SHARED = 0.6
PULL = 0.0005
WINDOW = 12
SENTENCE = r"(?<=[.!?;:])\s+"

#: Notices by family, as their licences ask for them or as they are commonly worded.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "This project is released under the Apache 2.0 license."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License. See the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "This project is available under the terms of the MIT license."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("gpl", "Released under the GNU GPL version 2 or later."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Released into the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
)
FAMILIES = ("unknown", *sorted({family for family, _ in TEMPLATES}))


@dataclass
class Classifier:
    counted: HashingTF
    regression: LogisticRegressionModel
    #: Least probability by family, in the order of ``FAMILIES``.
    least: list[float]


def words_of(paragraph: Column) -> Column:
    """Lower-case words of letters, digits, dots and hyphens inside."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}.-]+|[.-]+(?![\p{L}\p{N}])"), lambda w: w != "")


def _lines_of_words(text: Column) -> Column:
    """``words_of`` of every line, by one search of the whole text."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.\n-]+|[.-]+(?![\p{L}\p{N}])", " ")
    return F.transform(F.split(spaced, "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != ""))


def grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words."""
    last = F.size(words) - n
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    runs = F.transform(places, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``paragraph`` (number from 0) and ``words`` of every paragraph of at least two words."""
    # Words are made before the rows are, or Spark would make them again for every run of words that is asked for.
    each = F.transform(F.split("text", "\n"), words_of)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(each).alias("paragraph", "words"))
    return rows.filter(F.size("words") >= 2)


def _with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pairs", grams(F.col("words"), 2)).withColumn(
        "grams", F.concat("pairs", grams(F.col("words"), 3))
    )


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TEMPLATES, "family string, text string").coalesce(1)
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("pairs", grams(F.col("words"), 2))


def fit(documents: DataFrame, unknown: int = UNKNOWN) -> Classifier | None:
    """The classifier; None if the table has no paragraph to learn ``unknown`` from."""
    spark = documents.sparkSession
    templates = _templates(spark)
    known = [r["g"] for r in templates.select(F.explode(grams(F.col("words"), 3)).alias("g")).distinct().collect()]
    # About ``unknown`` documents by a hash of each row, and the first of their paragraphs in the order of a hash.
    some = documents.filter(share_of(F.xxhash64("doc_id", "text"), unknown, documents.count()))
    drawn = paragraphs(some).select("words", F.xxhash64(F.concat_ws(" ", "words")).alias("mark")).distinct()
    drawn = drawn.orderBy("mark").limit(unknown)
    drawn = drawn.filter(~F.arrays_overlap(grams(F.col("words"), 3), F.array(*map(F.lit, known))))
    drawn = settle(drawn.withColumn("out", F.pmod("mark", F.lit(2)) == 1).select("words", "out"))
    if not drawn.filter("NOT out").count():
        return None
    number = F.create_map(*(x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))))
    half = F.ceil(F.size("words") / 2).cast("int")
    parts = F.array("words", F.slice("words", F.lit(1), half), F.slice("words", half + 1, half))
    parts = F.array_distinct(F.concat(parts, F.transform(F.split("text", SENTENCE), words_of)))
    rows = templates.select(number[F.col("family")].alias("label"), F.explode(parts).alias("words"))
    rows = rows.filter(F.size("words") >= 2).withColumn("weight", F.lit(float(10)))
    rows = rows.union(drawn.filter("NOT out").select(F.lit(0.0), "words", F.lit(1.0))).coalesce(1)
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    regression = LogisticRegression(
        family="multinomial", regParam=PULL, maxIter=40, standardization=False, weightCol="weight",
        probabilityCol="probability", rawPredictionCol="raw", predictionCol="place",
    ).fit(counted.transform(_with_grams(rows)))
    model = Classifier(counted, regression, [FLOOR] * len(FAMILIES))
    kept_out = _scored(drawn.filter("out").select("words"), model)
    most = kept_out.select([F.max(F.col("p")[i]).alias(f"p{i}") for i in range(len(FAMILIES))]).first()
    model.least = [max(FLOOR, x or 0.0) for x in most]
    return model


def _scored(rows: DataFrame, model: Classifier) -> DataFrame:
    found = model.regression.transform(model.counted.transform(_with_grams(rows)))
    return found.withColumn("p", vector_to_array("probability")).drop("grams", "features", "raw", "probability")


def notices(documents: DataFrame, model: Classifier | None) -> DataFrame:
    """``doc_id``, ``paragraph``, ``family``, ``probability``, ``shared`` and ``confirmed`` of every predicted notice that has a
    word pair of a template.
    """
    spark = documents.sparkSession
    if model is None:
        shape = "doc_id long, paragraph int, family string, probability double, shared double, confirmed boolean"
        return spark.createDataFrame([], shape)
    templates = _templates(spark).select("family", "pairs").collect()
    rows = _scored(_judged(documents, sorted({p for r in templates for p in r["pairs"]})), model)
    place = F.col("place").cast("int")
    least, names = F.array(*map(F.lit, model.least)), F.array(*map(F.lit, FAMILIES))
    rows = rows.filter((place > 0) & (F.col("p")[place] > least[place]))
    family, probability = names[place].alias("family"), F.col("p")[place].alias("probability")
    rows = rows.select("_row", "doc_id", "paragraph", family, probability, grams(F.col("full"), 2).alias("pairs"))
    shared = F.lit(0.0)
    for r in templates:
        pairs = F.array(*map(F.lit, r["pairs"]))
        shorter = F.least(F.size(F.array_distinct("pairs")), F.lit(len(set(r["pairs"]))))
        part = F.size(F.array_intersect("pairs", pairs)) / shorter
        shared = F.greatest(shared, F.when(F.col("family") == r["family"], part).otherwise(0.0))
    rows = rows.withColumn("shared", shared)
    # Predicted notices are few; of the parts of a paragraph the one that a template confirms best stands for all.
    best = F.max(F.struct("shared", "probability")).alias("best")
    rows = rows.groupBy("_row", "doc_id", "paragraph", "family").agg(best)
    shared = F.col("best.shared")
    return rows.select(
        "doc_id", "paragraph", "family", "best.probability", "best.shared", (shared >= SHARED).alias("confirmed")
    )


def _judged(documents: DataFrame, known: list[str]) -> DataFrame:
    """``_row``, ``doc_id``, ``paragraph`` and of every paragraph and part of one the ``full`` words and those to classify.

    A notice is confirmed by word pairs it shares with a template, so paragraphs without any known pair are left out at once,
    before rows are made of them.
    """
    met = lambda words: F.transform(grams(words, 2), lambda p: p.isin(known))
    number = lambda flags: F.size(F.filter(flags, lambda x: x))
    lines = F.split(F.col("text"), "\n")
    each = F.transform(
        _lines_of_words(F.col("text")), lambda x, i: F.struct(i.alias("paragraph"), x.alias("all"), met(x).alias("flags"))
    )
    each = F.filter(each, lambda x: F.exists(x["flags"], lambda f: f))
    rows = documents.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"),
        F.inline(each),
    )
    rows = rows.select("*", F.get("lines", F.col("paragraph")).alias("line"))
    sentences = F.transform(F.split("line", SENTENCE), words_of)
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(WINDOW // 2))
    windows = F.transform(starts, lambda i: F.slice("all", i, WINDOW))
    parts = F.transform(
        F.array_distinct(F.concat(sentences, windows)), lambda x: F.struct(x.alias("full"), met(x).alias("flags"))
    )
    at = lambda flags, i: F.coalesce(F.get(flags, i), F.lit(False))
    parts = F.transform(
        F.filter(parts, lambda x: number(x["flags"]) >= 2),
        lambda x: F.struct(
            x["full"].alias("full"),
            F.filter(x["full"], lambda w, i: at(x["flags"], i) | at(x["flags"], i - 1)).alias("words"),
        ),
    )
    whole = F.array(F.struct(F.col("all").alias("full"), F.col("all").alias("words")))
    # Without a second known pair no part of a paragraph has two.
    every = F.when(number(F.col("flags")) >= 2, F.concat(whole, parts)).otherwise(whole)
    return rows.select("_row", "doc_id", "paragraph", F.inline(every))


def licences(documents: DataFrame, unknown: int = UNKNOWN) -> DataFrame:
    """Per ``doc_id`` the number of ``paragraphs`` and of confirmed ``notices``, and the confirmed ``families``."""
    found = notices(documents, fit(documents, unknown)).filter("confirmed")
    # A document has as many families as there are, at most.
    found = found.groupBy("doc_id").agg(
        F.count("*").alias("notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families")
    )
    held = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != ""))
    totals = documents.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.sum(F.coalesce(held, F.lit(0))).alias("paragraphs")
    )
    met = totals.join(found, totals["_id"].eqNullSafe(found["doc_id"]), "left")
    return met.select(
        F.col("_id").alias("doc_id"),
        "paragraphs",
        F.coalesce("notices", F.lit(0)).cast("long").alias("notices"),
        F.coalesce("families", F.lit("")).alias("families"),
    )
