"""License scans: a trained paragraph classifier with an unknown class, confirmed by templates; DataFrame operations only.

Paragraphs are lines. Features are words and pairs of neighbouring words, lower-cased, each once, hashed to ``PLACES``
places. One logistic regression per licence family is trained against all other families and against paragraphs of the
corpus that name no licence: full-batch gradient steps with an L1 shrinkage, so weights are sparse. The data of a step
stay in Spark; what is summed per (family, place), at most families * PLACES numbers, comes to the driver and goes back as
literal arrays, so scoring is a lookup inside the row, without join or shuffle.

Calibration. Scores of notices and paragraphs that no gradient step has seen give the cut of each family: half way between
the highest score of a paragraph of another class and the lowest of its own. Below its cut a paragraph is of unknown class.
A family that passes is confirmed by the best of its templates, which are all its notices: enough of the word triples and
all name words of the template occur in the paragraph; SPDX lines and notices of fewer than five words must be its last
words.

Defined results: null and empty texts have no paragraphs; repeated paragraphs count each; without rows for training the
templates alone are used; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.llm.common import keep

PLACES = 4096
UNKNOWN_ROWS = 3000
CONFIRM = 0.6

# Short notices of the families, written for training.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This file is licensed under the Apache License, Version 2.0 (the License).",
        "Distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is shared under a Creative Commons Attribution-NonCommercial licence, CC BY-NC 4.0.",
        "Released under CC BY-NC 4.0, for non-commercial use only.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software under the GNU General Public License, version 3 or later.",
        "Distributed under the GNU GPL, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
}

# Notices in other wordings: held out from the gradient steps, they give the cuts.
HELD_OUT = {
    "apache-2.0": [
        "You may use this project under the Apache License, Version 2.0.",
        "Available under the terms of the Apache License, Version 2.0 (Apache-2.0).",
        "This software is released under the Apache 2.0 license.",
    ],
    "cc-by-nc": [
        "This document is available under the Creative Commons Attribution-NonCommercial 4.0 licence.",
        "Shared under the CC BY-NC 4.0 licence; commercial use is not permitted.",
        "You may use this text under CC BY-NC 4.0.",
    ],
    "gpl-3.0": [
        "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.0.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "This project is licensed under the terms of the MIT License.",
        "Distributed under the MIT License.",
        "The source code is available under the MIT License.",
    ],
}
# A template's words among these must all occur in a paragraph it confirms.
NAMES = {
    "apache-2.0": {"apache", "2"},
    "cc-by-nc": {"cc", "by", "nc", "creative", "commons", "attribution", "noncommercial"},
    "gpl-3.0": {"gnu", "gpl", "general", "public", "3", "v3"},
    "mit": {"mit"},
}


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


PLACES_OF = (
    "array_distinct(concat(transform(words, w -> cast(pmod(xxhash64(w), {0}) AS int)),"
    " CASE WHEN size(words) < 2 THEN array() ELSE"
    " transform(sequence(0, size(words) - 2), i -> cast(pmod(xxhash64(words[i], words[i + 1]), {0}) AS int)) END))"
).format(PLACES)


def featured(paragraphs: DataFrame) -> DataFrame:
    """Adds words and places to rows with a column paragraph."""
    return paragraphs.withColumn("words", words_of(F.col("paragraph"))).withColumn("places", F.expr(PLACES_OF))


def _literal(values: list[float]) -> str:
    return "cast(split('" + ",".join(f"{v:.6g}" for v in values) + "', ',') AS array<double>)"


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """Adds s_0, s_1, ...: the score of every family, a sum of weights over the places."""
    return rows.withColumns(
        {
            f"s_{k}": F.expr(f"aggregate(places, {b:.9g}D, (s, p) -> s + element_at({_literal(w)}, p + 1))")
            for k, (w, b) in enumerate(zip(model["weights"], model["bias"]))
        }
    )


def training_table(docs: DataFrame, text_col: str = "text", unknown_rows: int = UNKNOWN_ROWS) -> DataFrame:
    """(paragraph, label, held_out): notices by family, and sampled paragraphs that name no licence (label -1)."""
    spark = docs.sparkSession
    rows = [(p, k, held) for k, f in enumerate(sorted(NOTICES)) for held, of in ((False, NOTICES), (True, HELD_OUT)) for p in of[f]]
    values = ", ".join(f"('{p}', {k}, {held})" for p, k, held in rows)
    notices = spark.sql(f"SELECT * FROM VALUES {values} AS t(paragraph, label, held_out)")
    # the sample is of documents, so no text is exploded for nothing; it is bounded by its share of the row count
    share = min(1.0, unknown_rows / 4 / max(1, docs.count()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    lines = chosen.select(F.explode(F.split(text, "\n", -1)).alias("paragraph")).where("length(paragraph) > 0")
    named = "lower(paragraph) rlike 'licen[cs]|copyright|spdx|gnu|gpl|apache|creative commons|cc[ -]by'"
    plain = lines.where(f"NOT ({named})").orderBy(F.xxhash64("paragraph")).limit(unknown_rows).withColumn("label", F.lit(-1))
    held = F.pmod(F.xxhash64("paragraph", F.lit(5)), F.lit(4)) == 0
    return notices.union(plain.withColumn("held_out", held))


def train(table: DataFrame, steps: int = 25, rate: float = 1.0, l1: float = 2e-4) -> dict:
    """Weights, bias and cut of every family."""
    families = sorted(NOTICES)
    rows = keep(featured(table).select("places", "label", "held_out"))
    fold = rows.where("NOT held_out")
    weights = [[0.0] * PLACES for _ in families]
    bias = [0.0] * len(families)
    counts = {r.label: r["count"] for r in fold.groupBy("label").count().collect()}
    total = sum(counts.values())
    model = {"families": families, "weights": weights, "bias": bias, "cut": [0.0] * len(families)}
    for _ in range(steps):
        # each class has the same mass, so few notices weigh as much as many plain paragraphs
        errors = []
        for k in range(len(families)):
            own, other = max(1, counts.get(k, 0)), max(1, total - counts.get(k, 0))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"s_{k}")))
            mass = F.when(F.col("label") == k, 0.5 / own).otherwise(0.5 / other)
            errors.append((mass * (p - (F.col("label") == k).cast("double"))).alias(f"e_{k}"))
        wrong = scored(fold, model).select(F.explode(F.concat("places", F.array(F.lit(PLACES)))).alias("place"), *errors)
        gradient = wrong.groupBy("place").agg(*[F.sum(f"e_{k}").alias(f"g_{k}") for k in range(len(families))]).collect()
        for g in gradient:
            for k in range(len(families)):
                if g.place == PLACES:
                    bias[k] -= rate * g[f"g_{k}"]
                else:
                    moved = weights[k][g.place] - 8 * rate * g[f"g_{k}"]
                    weights[k][g.place] = math.copysign(max(0.0, abs(moved) - l1), moved)
    cuts = scored(rows.where("held_out"), model).agg(
        *[F.min(F.when(F.col("label") == k, F.col(f"s_{k}"))).alias(f"own_{k}") for k in range(len(families))],
        *[F.max(F.when(F.col("label") != k, F.col(f"s_{k}"))).alias(f"other_{k}") for k in range(len(families))],
    ).first()
    model["cut"] = [
        (cuts[f"own_{k}"] + cuts[f"other_{k}"]) / 2 if cuts[f"own_{k}"] is not None and cuts[f"other_{k}"] is not None else 0.0
        for k in range(len(families))
    ]
    return model


def _triples(words: str) -> str:
    return (
        f"CASE WHEN size({words}) < 3 THEN array() ELSE transform(sequence(0, size({words}) - 3),"
        f" i -> concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2])) END"
    )


def _confirms(family: str, template: str) -> Column:
    """Whether the template confirms a paragraph with columns words and _triples."""
    words = re.findall(r"[^\W_]+", template.lower())
    if words[0] == "spdx" or len(words) < 5:
        return F.slice("words", -len(words), len(words)) == F.array(*map(F.lit, words))
    triples = F.array(*[F.lit(t) for t in dict.fromkeys(" ".join(words[i : i + 3]) for i in range(len(words) - 2))])
    names = F.array(*[F.lit(w) for w in sorted(NAMES[family] & set(words))])
    share = F.size(F.array_intersect(F.col("_triples"), triples)) / F.size(triples)
    return (share >= CONFIRM) & (F.size(F.array_except(names, F.col("words"))) == 0)


def classified(rows: DataFrame, model: dict) -> DataFrame:
    """Adds family (null: unknown) and confirmed to rows with a column paragraph."""
    families = model["families"]
    out = scored(featured(rows), model)
    margins = [F.struct((F.col(f"s_{k}") - F.lit(c)).alias("m"), F.lit(f).alias("family"), F.lit(k).alias("k")) for k, (f, c) in enumerate(zip(families, model["cut"]))]
    out = out.withColumn("_best", F.greatest(*margins)).withColumn("family", F.when(F.col("_best.m") > 0, F.col("_best.family")))
    out = out.withColumn("_triples", F.when(F.col("family").isNotNull(), F.expr(_triples("words"))))
    confirmed = F.lit(False)
    for f in families:
        any_of = reduce(or_, [_confirms(f, t) for t in NOTICES[f] + HELD_OUT[f]])
        confirmed = F.when(F.col("family") == f, any_of).otherwise(confirmed)
    return out.withColumn("confirmed", F.coalesce(confirmed, F.lit(False))).drop("_best", "_triples")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_licensed, n_confirmed, families, confirmed) of every row; families sorted, comma-joined."""
    model = train(training_table(docs, text_col))
    numbered = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), lambda x: F.length(x) > 0)
    each = numbered.select("given", "row", F.explode_outer(lines).alias("paragraph"))
    found = classified(each, model)
    return (
        found.groupBy("row", "given")
        .agg(
            F.count("paragraph").alias("n_paragraphs"),
            F.count("family").alias("n_licensed"),
            F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
            F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("confirmed"),
        )
        .withColumnRenamed("given", id_col)
        .drop("row")
    )
