"""Quality rules with thresholds that adapt to language and source, with DataFrame operations only.

Figures of every whole text are counted in its row (no shuffle). Four rates of it fall into logarithmic buckets of one
hundredth (a relative error of one percent): symbols, repeated lines and repeated words, smoothed by ``ONE`` mark in a short
text, and the mean word length. The sketch of a rate is the count of documents by (language, source, bucket): sketches merge
by addition, so neither the order of rows nor a repeated task can change a threshold. The sketch of a source is mixed
with that of its language, which counts as ``PRIOR`` documents more, and the language's likewise with that of all
documents: a small group leans on its language, a large one speaks for itself, without a size at which the rule changes.

The fence of a rate is its upper quantile times (upper quantile / median) to the power ``REACH``, and at least ``LEAST``
times the quantile, so that a group without spread does not reject a single odd mark; mean word length has a lower
fence of the same form too. A document beyond a fence of its own group is dropped. So a rate that is usual in a source
rejects nothing there, and clean texts stay. The thresholds are few and narrow; documents meet them in a join on
(language, source) that carries no text, and a hot source is split by the adaptive skew join. A sketch holds at most some
thousand buckets, whatever the number of documents.

Words are compared in three-word windows by a 64-bit hash inside one text.

Defined results: null, empty and word-less texts have all figures 0, fail the base rule and are not kept; null language
and null source are groups of their own; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.llm.common import keep

SPACE = r"[\\x20\\x09-\\x0D]"
RATES = ("symbol_rate", "line_rate", "repeat_rate", "word_length")
ONE = {"symbol_rate": 50, "line_rate": 10, "repeat_rate": 50}  # words or lines that one mark more is spread over
LEAST = {"symbol_rate": 2.0, "line_rate": 2.0, "repeat_rate": 2.0, "word_length": 1.25}
PER_LOG = 100  # buckets for a factor of e
PRIOR = 100
UPPER, REACH = 0.85, 4.0


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every row: (id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    text = docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # each select is used several times by the next, so Spark computes it once
    words = text.select(
        "id",
        "lang",
        "source",
        F.expr(f"filter(split(text, '{SPACE}+', -1), w -> w != '')").alias("words"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        F.expr("filter(split(text, '\\n', -1), l -> length(translate(l, ' \\t\\n\\u000b\\u000c\\r', '')) > 0)").alias("lines"),
    )
    windows = words.select(
        "*",
        F.expr(
            "CASE WHEN size(words) < 3 THEN array() ELSE"
            " transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"
        ).alias("windows"),
    )
    ordered = windows.select(
        "*",
        F.expr(
            "CASE WHEN size(array_distinct(windows)) = size(windows) THEN array()"
            " ELSE sort_array(transform(windows, (h, i) -> struct(h, i))) END"
        ).alias("ordered"),
    )
    found = ordered.select(
        "*",
        F.expr(
            "filter(transform(ordered, (s, k) -> CASE WHEN s.h = get(ordered, k - 1).h OR s.h = get(ordered, k + 1).h"
            " THEN s.i END), i -> i IS NOT NULL)"
        ).alias("found"),
    )
    return found.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "cast(size(array_union(array_union(found, transform(found, i -> i + 1)), transform(found, i -> i + 2))) AS bigint)"
        ).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def rated(counts: DataFrame) -> DataFrame:
    """Adds base_failed, the smoothed rates (word_length null without words) and their buckets."""

    def smoothed(marks: str, of: str, rate: str):
        return ((F.col(marks) + 1) / (F.col(of) + ONE[rate])).alias(rate)

    rates = counts.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        smoothed("n_symbols", "n_words", "symbol_rate"),
        smoothed("n_dup_lines", "n_lines", "line_rate"),
        smoothed("n_repeat_words", "n_words", "repeat_rate"),
        (F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("word_length"),
    )
    return rates.select("*", *[F.floor(F.ln(r) * PER_LOG).cast("int").alias(f"{r}_bucket") for r in RATES])


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): how many documents that pass the base rule lie in each bucket.

    Give it rates of written figures: a filter pushed below the figures would count every text several times.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"{r}_bucket").alias("bucket")) for r in RATES]))
    cells = rates.where(~F.col("base_failed")).select("lang", "source", cells.alias("cell"))
    return cells.groupBy("lang", "source", "cell.rate", "cell.bucket").agg(F.count("*").alias("n"))


def thresholds(
    own: DataFrame, prior: int = PRIOR, upper: float = UPPER, reach: float = REACH, least: dict[str, float] = LEAST
) -> DataFrame:
    """(lang, source, lowest and highest bucket kept of every rate), from the sketches of all groups."""

    def gathered(*keys: str) -> DataFrame:
        merged = own.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        return merged.groupBy(*keys, "rate").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("cells"))

    def mixed(table: DataFrame, wider: DataFrame) -> DataFrame:
        """The table's shares of each bucket, with ``prior`` documents spread like the wider group's."""
        wide = wider.select(*[F.col(c).alias(f"_{c}") for c in wider.columns])
        met = F.col("rate") == F.col("_rate")
        if "_lang" in wide.columns:
            met = met & F.col("lang").eqNullSafe(F.col("_lang"))
        shares = F.expr(
            f"sort_array(concat(transform(cells, c -> struct(c.bucket AS bucket, c.n / (total + {prior}D) AS share)),"
            f" transform(_shares, c -> struct(c.bucket AS bucket, c.share * {prior}D / (total + {prior}D) AS share))))"
        )
        return table.join(wide, met).select(*[c for c in table.columns if c != "cells"], shares.alias("shares"))

    every = gathered().select(
        "rate", F.expr("transform(cells, c -> struct(c.bucket AS bucket, c.n / cast(total AS double) AS share))").alias("shares")
    )
    groups = mixed(gathered("lang", "source"), mixed(gathered("lang"), every))

    def at(q: float):
        # sums of shares may fall short of the quantile by rounding
        return F.expr(
            "aggregate(shares, struct(0D AS sum, cast(null AS int) AS bucket), (s, c) -> struct(s.sum + c.share AS sum,"
            f" CASE WHEN s.bucket IS NULL AND s.sum + c.share >= {q - 1e-9}D THEN c.bucket ELSE s.bucket END AS bucket), s -> s.bucket)"
        )

    points = groups.select("lang", "source", "rate", at(upper).alias("high"), at(0.5).alias("middle"), at(1 - upper).alias("low"))
    floor = F.element_at(F.create_map(*[F.lit(x) for r in RATES for x in (r, round(math.log(least[r]) * PER_LOG))]), F.col("rate"))

    def step(spread):
        return F.greatest(F.round(reach * spread).cast("int"), floor)

    fences = points.select(
        "lang", "source", "rate",
        (F.col("high") + step(F.col("high") - F.col("middle"))).alias("most"),
        (F.col("low") - step(F.col("middle") - F.col("low"))).alias("fewest"),
    )
    wide = [F.max(F.when(F.col("rate") == r, F.col("most"))).alias(f"{r}_most") for r in RATES]
    return fences.groupBy("lang", "source").agg(
        *wide, F.max(F.when(F.col("rate") == "word_length", F.col("fewest"))).alias("word_length_fewest")
    )


def judged(docs: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """(id, the counts, base_failed, kept) of every row."""
    rates = rated(keep(figures(docs, id_col, **names)))
    fences = keep(thresholds(keep(sketches(rates)))).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.col("word_length_bucket") >= F.col("word_length_fewest")
    for r in RATES:
        inside = inside & (F.col(f"{r}_bucket") <= F.col(f"{r}_most"))
    # a group without fences has no document that passes the base rule
    return rates.join(fences, same, "left").select(
        F.col("id").alias(id_col),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
