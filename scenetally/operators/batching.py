"""Sharding, batches, windowed history and islands over exact positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.operators.ordered import framed, positions, running


def round_robin_shard(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every n-th record to the same shard."""
    return positions(df, [], order, "_pos").withColumn("shard", F.pmod(F.col("_pos") - 1, F.lit(n))).drop("_pos")


def hash_shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """Shards without any order or shuffle."""
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)))


def fixed_batch(df: DataFrame, order: list[str], k: int, keep_remainder: bool = True) -> DataFrame:
    """Consecutive groups of k records."""
    out = positions(df, [], order, "_pos").withColumn("batch", F.floor((F.col("_pos") - 1) / k))
    if not keep_remainder:
        whole = df.agg(F.floor(F.count("*") / k).alias("w")).scalar()
        out = out.withColumn("_w", whole).where("batch < _w").drop("_w")
    return out.drop("_pos")


def grouped_batch(df: DataFrame, group: str, order: list[str], k: int, drop_uneven: bool = False) -> DataFrame:
    """Batches of k inside a group, numbered by their first element in sampler order."""
    placed = positions(df, [], order, "_at")
    placed = positions(placed, [group], ["_at"], "_in").withColumn("_b", F.floor((F.col("_in") - 1) / k))
    heads = placed.groupBy(group, "_b").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    if drop_uneven:
        heads = heads.where(F.col("_size") == k)
    numbered = positions(heads, [], ["_first"], "_n").select(group, "_b", (F.col("_n") - 1).alias("batch"))
    return placed.join(numbered, [group, "_b"]).select(
        *df.columns, "batch", (F.pmod(F.col("_in") - 1, F.lit(k)) + 1).alias("slot")
    )


def contiguous_shard(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """Equal consecutive slices, the last may be short."""
    size = df.agg(F.ceil(F.count("*") / world).alias("s")).scalar()
    placed = positions(df, [], order, "_pos").withColumn("_size", size)
    return placed.withColumn("shard", F.floor((F.col("_pos") - 1) / F.col("_size"))).drop("_pos", "_size")


def even_shard(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """Slices of equal size; the last ones are filled up from the start of the order."""
    count = df.agg(F.count("*").alias("n")).scalar()
    placed = positions(df, [], order, "_pos").withColumn("_n", count)
    size = F.ceil(F.col("_n") / world)
    extra = size * world - F.col("_n")
    at = F.col("_pos") - 1
    # a table smaller than the shortfall goes round more than once
    wraps = F.ceil(size * world / F.col("_n"))
    seats = F.transform(F.sequence(F.lit(0).cast("long"), wraps - 1), lambda j: at + j * F.col("_n"))
    seats = F.filter(seats, lambda s: s < F.col("_n") + extra)
    spread = placed.select(*df.columns, size.alias("_size"), F.explode(seats).alias("_seat"))
    return spread.withColumn("shard", F.floor(F.col("_seat") / F.col("_size"))).drop("_size", "_seat")


def windowed_history(df: DataFrame, group: list[str], order: list[str], value: str, window: int = 20) -> DataFrame:
    """Lower median and mean of the last ``window`` values of each series, and its mean so far."""
    placed = running(df, group, order, {"_pos": ("count", None), "_sum": ("sum", value)})

    def build(spec):
        last = spec.rowsBetween(-(window - 1), 0)
        ordered = F.array_sort(F.collect_list(value).over(last))
        return {
            "median": F.element_at(ordered, F.floor((F.size(ordered) + 1) / 2).cast("int")),
            "window_mean": F.avg(value).over(last),
        }

    out = framed(placed, group, "_pos", window - 1, build)
    return out.withColumn("global_mean", F.col("_sum") / F.col("_pos")).drop("_pos", "_sum")


def remaining_time(median_step: Column, iteration: Column, total: Column) -> Column:
    return median_step * (total - iteration - 1)


def latest_value(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias(value))


def sub_sequence_number(df: DataFrame, group: list[str], order: list[str], same: list[str]) -> DataFrame:
    """0 where the ``same`` columns change, else one more than the row before."""
    placed = positions(df, group, order, "_pos")

    def build(spec):
        alike = F.lit(True)
        for c in same:
            alike = alike & F.col(c).eqNullSafe(F.lag(c).over(spec))
        return {"_start": F.when(alike & (F.col("_pos") > 1), F.lit(None)).otherwise(F.col("_pos"))}

    marked = framed(placed, group, "_pos", 1, build)
    out = running(marked, group, ["_pos"], {"_island": ("max", "_start")})
    return out.withColumn("sub", F.col("_pos") - F.col("_island")).drop("_pos", "_start", "_island")


def shown_on_change(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """The column's value where it differs from the row before, else an empty text."""
    placed = positions(df, [], order, "_pos")

    def build(spec):
        return {"shown": F.when(F.col(column) == F.lag(column).over(spec), "").otherwise(F.col(column))}

    return framed(placed, [], "_pos", 1, build).drop("_pos")


def log_group_average(scores: DataFrame, file: str, order: list[str], score: str, world: str) -> DataFrame:
    """Mean of each run of ``world`` consecutive score lines; the i-th run belongs to the i-th checkpoint."""
    placed = positions(scores, [file], order, "_pos")
    return (
        placed.withColumn("checkpoint", F.floor((F.col("_pos") - 1) / F.col(world)))
        .groupBy(file, "checkpoint")
        .agg(F.avg(score).alias("score"), F.count("*").alias("n"))
    )


def best_checkpoint(averages: DataFrame, file: str) -> DataFrame:
    return averages.groupBy(file).agg(
        F.max(F.struct("score", (-F.col("checkpoint")).alias("c"))).alias("_b")
    ).select(file, (-F.col("_b.c")).alias("checkpoint"), F.col("_b.score").alias("score"))


def tail_split(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Last n rows in order are 'minival', the rest 'train'."""
    count = df.agg(F.count("*").alias("n")).scalar()
    placed = positions(df, [], order, "_pos").withColumn("_n", count)
    return placed.withColumn("split", F.when(F.col("_pos") > F.col("_n") - n, "minival").otherwise("train")).drop("_pos", "_n")


def head_subset(df: DataFrame, order: list[str], n: int) -> DataFrame:
    from scenetally.operators.ordered import order_columns

    return df.orderBy(*order_columns(order)).limit(n)
