"""Result tables of repeated runs and set operations over data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_and_deviation(df: DataFrame, group: list[str], values: list[str], digits: int = 2) -> DataFrame:
    """Mean, sample deviation and 'm±s' text of each metric over the runs of a group."""
    agg = []
    for v in values:
        mean, dev = F.avg(v), F.stddev_samp(v)
        agg += [mean.alias(f"{v}_mean"), dev.alias(f"{v}_std")]
    out = df.groupBy(*group).agg(*agg)
    for v in values:
        text = F.concat(
            F.format_string(f"%.{digits}f", F.col(f"{v}_mean")),
            F.when(F.col(f"{v}_std").isNull(), "").otherwise(F.format_string(f"±%.{digits}f", F.col(f"{v}_std"))),
        )
        out = out.withColumn(f"{v}_text", text)
    return out


def drop_columns_containing(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def rename_metric(name: Column, prefix: str = "") -> Column:
    """'r10' style recall names to 'R@10', with a prefix."""
    return F.concat(F.lit(prefix), F.regexp_replace(name, r"(?i)^r(?:ecall)?@?(\d+)$", r"R@$1"))


def top_causes(scores: DataFrame, effect: str, cause: str, score: str, counts: str, n_classes: int, k: int) -> DataFrame:
    """The most counted effect classes but the first, with their k best causes as 'name: score' texts."""
    totals = scores.groupBy(effect).agg(F.max(counts).alias("_n"))
    chosen = totals.orderBy(F.col("_n").desc(), effect).limit(n_classes + 1)
    first = chosen.orderBy(F.col("_n").desc(), effect).limit(1)
    kept = chosen.join(first, effect, "left_anti").select(effect)
    w = Window.partitionBy(effect).orderBy(F.col(score).desc(), cause)
    ranked = scores.join(kept, effect, "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(effect, "rank", F.concat(F.col(cause).cast("string"), F.lit(": "), F.format_string("%.3f", score)).alias("text"))


def in_listed_order(df: DataFrame, column: str, listed: list[str]) -> DataFrame:
    """Place of the value in a given order; unlisted values go last."""
    order = F.array(*[F.lit(v) for v in listed])
    place = F.array_position(order, F.col(column))
    return df.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(listed) + 1)))


def concat_datasets(sets: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of all sets with the set number and the 0-based index inside it."""
    from scenetally.operators.ordered import positions

    whole = None
    for i, df in enumerate(sets):
        tagged = df.withColumn("set_no", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    return positions(whole, ["set_no"], order, "_pos").withColumn("local_index", F.col("_pos") - 1).drop("_pos")


def union_counts(parts: list[DataFrame], key: str, n: str) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(key).agg(F.sum(n).alias(n))


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.distinct()


def first_wins(shards: list[DataFrame], key: str) -> DataFrame:
    """One row per key, from the earliest shard that has it; rows of one shard are unique by key."""
    whole = None
    for i, df in enumerate(shards):
        tagged = df.withColumn("shard", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged)
    rest = [c for c in whole.columns if c not in (key, "shard")]
    best = whole.groupBy(key).agg(F.min(F.struct("shard", *rest)).alias("_m"))
    return best.select(key, "_m.*")


def wide_concat(parts: list[DataFrame]) -> DataFrame:
    """Rows appended, columns united."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole
