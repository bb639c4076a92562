"""Co-occurrence of classes and words, marginals, conditionals and excess probability.

A record's distinct items are one array; its pairs are made a member at a time and stream into a map-side partial count:
only (hi, lo, n) partials are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.functions import arrays


def set_cooccurrence(df: DataFrame, record: str, item: str) -> DataFrame:
    """Records holding both items, for every unordered pair incl. (i, i), whose count is the item's marginal."""
    sets = df.where(F.col(item).isNotNull()).groupBy(record).agg(F.collect_set(item).alias("_items"))
    pairs = arrays.exploded_pairs(sets.select(F.array_sort("_items").alias("_items")), "_items")
    return pairs.groupBy("hi", "lo").agg(F.count("*").alias("n"))


def bag_cooccurrence(df: DataFrame, record: str, item: str, self_pairs: str = "bag") -> DataFrame:
    """Position pairs (later >= earlier) per record with multiplicity.

    The number of position pairs follows from the per-record counts a, b: a*b for two items, and for an item with itself
    a(a+1)/2 ('bag', each position also pairs with itself) or a ('set-diagonal', the plain marginal of occurrences).
    """
    counts = df.where(F.col(item).isNotNull()).groupBy(record, item).agg(F.count("*").alias("_n"))
    bags = counts.groupBy(record).agg(
        F.array_sort(F.collect_list(F.struct(F.col(item).alias("w"), F.col("_n").alias("n")))).alias("_bag")
    )
    pairs = arrays.exploded_pairs(bags, "_bag", "a", "b")
    a, b = F.col("a.n"), F.col("b.n")
    alone = (a * (a + 1) / 2 if self_pairs == "bag" else a).cast("long")
    weighed = pairs.select(F.col("b.w").alias("hi"), F.col("a.w").alias("lo"), F.when(F.col("a.w") == F.col("b.w"), alone).otherwise(a * b).alias("n"))
    return weighed.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def cross_cooccurrence(words: DataFrame, classes: DataFrame, record: str, word: str, cls: str) -> DataFrame:
    """Each word occurrence of a record with each distinct class of the record."""
    w = words.groupBy(record, word).agg(F.count("*").alias("_n"))
    c = classes.select(record, cls).distinct()
    return w.join(c, record).groupBy(word, cls).agg(F.sum("_n").alias("n"))


def bag_marginals(df: DataFrame, record: str, item: str) -> DataFrame:
    """(item, n_item): the self pairs of ``bag_cooccurrence`` without the other pairs."""
    counts = df.where(F.col(item).isNotNull()).groupBy(record, item).agg(F.count("*").alias("_n"))
    return counts.groupBy(F.col(item).alias("item")).agg(F.sum((F.col("_n") * (F.col("_n") + 1) / 2).cast("long")).alias("n_item"))


def cross_conditionals(cross: DataFrame, words: DataFrame, classes: DataFrame, word: str, cls: str) -> DataFrame:
    """Both conditionals of every (word, class) of ``cross_cooccurrence``: over the word's and over the class's marginal.

    The marginals are the diagonals (item, n_item) of the two pair tables.
    """
    w = words.select(F.col("item").alias(word), F.col("n_item").alias("_w"))
    c = classes.select(F.col("item").alias(cls), F.col("n_item").alias("_c"))
    joined = cross.join(w, word).join(c, cls)
    return joined.select(word, cls, "n", F.try_divide("n", "_w").alias("p_cls_given_word"), F.try_divide("n", "_c").alias("p_word_given_cls"))


def marginals(pairs: DataFrame) -> DataFrame:
    return pairs.where("hi = lo").select(F.col("hi").alias("item"), F.col("n").alias("n_item"))


def conditional_probability(pairs: DataFrame) -> DataFrame:
    """P(item given cond) for both directions of every pair."""
    both = pairs.select(F.col("hi").alias("item"), F.col("lo").alias("cond"), "n").unionByName(
        pairs.where("hi <> lo").select(F.col("lo").alias("item"), F.col("hi").alias("cond"), "n")
    )
    base = marginals(pairs).withColumnsRenamed({"item": "cond", "n_item": "n_cond"})
    return both.join(base, "cond").select("item", "cond", "n", F.try_divide("n", "n_cond").alias("p"))


def excess_joint(pairs: DataFrame, total: Column) -> DataFrame:
    """Joint probability against independence: difference and log ratio. A zero count gives -Infinity."""
    m = marginals(pairs)
    out = (
        pairs.join(m.withColumnsRenamed({"item": "hi", "n_item": "n_hi"}), "hi")
        .join(m.withColumnsRenamed({"item": "lo", "n_item": "n_lo"}), "lo")
        .withColumn("_total", total.cast("double"))
    )
    joint, alone = F.col("n") / F.col("_total"), F.col("n_hi") * F.col("n_lo") / (F.col("_total") * F.col("_total"))
    return out.select(
        "hi",
        "lo",
        "n",
        joint.alias("p_joint"),
        alone.alias("p_indep"),
        (joint - alone).alias("excess"),
        F.when(F.col("n") == 0, F.lit(float("-inf"))).otherwise(F.ln(F.try_divide(joint, alone))).alias("lift"),
    )


def not_plural_pair(a: str, b: str) -> Column:
    """False for (x, xs) in either order and for words equal but for spaces."""
    x, y = F.col(a), F.col(b)
    bare = [F.replace(c, F.lit(" "), F.lit("")) for c in (x, y)]
    return ~((F.concat(x, F.lit("s")) == y) | (F.concat(y, F.lit("s")) == x) | (bare[0] == bare[1]))


def top_pairs(pairs: DataFrame, score: str, k: int, background: str | None = None, finite: bool = True) -> DataFrame:
    """The k pairs of largest absolute score, self pairs and pairs with the background class left out."""
    keep = F.col("hi") != F.col("lo")
    if background is not None:
        keep = keep & (F.col("hi") != background) & (F.col("lo") != background)
    if finite:
        keep = keep & (F.abs(F.col(score)) < float("inf"))
    return pairs.where(keep).orderBy(F.abs(F.col(score)).desc(), "hi", "lo").limit(k)


def class_names(pairs: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Names of both classes of a pair."""
    hi = names.select(F.col(key).alias("hi"), F.col(name).alias("hi_name"))
    lo = names.select(F.col(key).alias("lo"), F.col(name).alias("lo_name"))
    return pairs.join(hi, "hi", "left").join(lo, "lo", "left")


def resolve_pair_words(pairs: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Class ids of two words; an unknown word has none."""
    hi = names.select(F.col(name).alias("hi"), F.col(key).alias("hi_id"))
    lo = names.select(F.col(name).alias("lo"), F.col(key).alias("lo_id"))
    return pairs.join(hi, "hi", "left").join(lo, "lo", "left")
