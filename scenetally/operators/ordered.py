"""Exact ordered scans that never put a whole group into one task.

A plain window over (group, order) sends a group to a single task, which fails once one group holds a large share of
the table. Here the rows are range partitioned by (group, order); every slice is scanned on its own and the totals of
the earlier slices of the same group are added. The only unpartitioned step works on one row per (group, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetally.session import pin

BLOCK_ROWS = 8192


def order_columns(order: list[str], flip: bool = False) -> list[Column]:
    """'-name' is descending, 'name' ascending; ``flip`` gives the exact reverse, also for nulls."""
    return [
        F.col(o.removeprefix("-")).desc() if o.startswith("-") != flip else F.col(o.removeprefix("-")).asc() for o in order
    ]


def sliced(df: DataFrame, group: list[str], order: list[str], slice_col: str = "_slice") -> DataFrame:
    """Range partition by (group, order) and name each row's slice. Pinned, so the slices stay fixed.

    The rows come back partitioned by slice, which serves every scan that follows without a further shuffle of them.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order_columns(order))
    return pin(ranged.withColumn(slice_col, F.spark_partition_id())).repartition(slice_col)


_FOLD = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "max_after": F.max}


def _unit(kind: str, column: str | None) -> Column:
    return F.lit(1).cast("long") if kind == "count" else F.col(column)


def _carries(parts: DataFrame, group: list[str], scans: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row per slice: what earlier slices give its first group (_back) and later ones its last group (_ahead).

    Slices follow (group, order), so no other group of a slice goes on elsewhere, however many groups there are.
    """
    key = F.struct(*group) if group else F.lit(0)
    folded = [_FOLD[kind](_unit(kind, col)).alias(f"_t_{out}") for out, (kind, col) in scans.items()]
    totals = parts.groupBy("_slice", *group).agg(*folded).select("_slice", key.alias("_k"), *[f"_t_{out}" for out in scans])
    cell = F.struct("_k", *[f"_t_{out}" for out in scans])
    ends = totals.groupBy("_slice").agg(F.min_by(cell, "_k").alias("_first"), F.max_by(cell, "_k").alias("_last"))
    alone = F.col("_first._k").eqNullSafe(F.col("_last._k"))
    rows = ends.select("_slice", F.explode(F.when(alone, F.array("_first")).otherwise(F.array("_first", "_last"))).alias("_e")).select("_slice", "_e.*")
    # looking ahead is looking back in reverse order: a frame that ends unbounded is quadratic in Spark
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_k").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select(
        "_slice", "_k",
        *[_FOLD[kind](f"_t_{out}").over(later if kind == "max_after" else earlier).alias(f"_b_{out}") for out, (kind, _) in scans.items()],
    )
    value = F.struct("_k", *[f"_b_{out}" for out in scans])
    return carried.groupBy("_slice").agg(F.min_by(value, "_k").alias("_back"), F.max_by(value, "_k").alias("_ahead"))


def scan_slices(parts: DataFrame, group: list[str], order: list[str], scans: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Running values over rows that ``sliced`` has placed; _slice stays, so scans can follow each other.

    Kinds: count, sum, max, min look back (inclusive); max_after looks ahead (inclusive).
    """
    key = F.struct(*group) if group else F.lit(0)
    inside = Window.partitionBy("_slice", *group)
    back = inside.orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.orderBy(*order_columns(order, flip=True)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = []
    for out, (kind, col) in scans.items():
        here = _FOLD[kind](_unit(kind, col)).over(ahead if kind == "max_after" else back)
        side = "_ahead" if kind == "max_after" else "_back"
        carry = F.when(F.col(f"{side}._k").eqNullSafe(key), F.col(f"{side}._b_{out}"))
        if kind in ("count", "sum"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "min":
            value = F.least(here, carry)
        else:
            value = F.greatest(here, carry)
        added.append(value.alias(out))
    # one row per slice: the hash side stays small, and the rows keep their placing by slice
    carried = _carries(parts, group, scans).hint("shuffle_hash")
    return parts.join(carried, "_slice", "left").select(*[F.col(c) for c in parts.columns], *added)


def running(df: DataFrame, group: list[str], order: list[str], scans: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Add inclusive running values; a count takes no column and gives the 1-based position.

    ``order`` must be a total order inside a group, else ties are in no fixed order.
    """
    return scan_slices(sliced(df, group, order), group, order, scans).drop("_slice")


def positions(df: DataFrame, group: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1-based row number per group (or over everything with no group).

    With no group the rows go through one shuffle: a row's place in its slice is read off the sorted slice, and the sizes
    of the earlier slices, one row a slice, are added.
    """
    if group:
        return running(df, group, order, {out: ("count", None)})
    ranged = df.repartitionByRange(*order_columns(order)).sortWithinPartitions(*order_columns(order))
    # slice number in the upper bits, place in the slice in the lower 33
    parts = pin(ranged.withColumn("_at", F.monotonically_increasing_id()))
    number = F.shiftright("_at", 33).alias("_slice")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy(number).agg(F.count("*").alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return parts.withColumn("_slice", F.shiftright("_at", 33)).join(F.broadcast(carried), "_slice").select(*df.columns, place.alias(out))


def framed(
    df: DataFrame,
    group: list[str],
    pos: str,
    reach: int,
    build,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window expressions that look at most ``reach`` rows back, on blocks of consecutive positions.

    ``build(window_spec)`` returns {name: Column}. The last ``reach`` rows of a block are copied in front of the next
    one, so frames crossing a border are whole; the copies are dropped afterwards.
    """
    block_rows = max(block_rows, reach + 1)
    offset = (F.col(pos) - 1) % block_rows
    own = F.floor((F.col(pos) - 1) / block_rows)
    blocks = F.when(offset >= block_rows - reach, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.select("*", own.alias("_own"), F.explode(blocks).alias("_block"))
    spec = Window.partitionBy(*group, "_block").orderBy(pos)
    added = build(spec)
    return (
        spread.select(*df.columns, "_own", "_block", *[c.alias(n) for n, c in added.items()])
        .where("_own = _block")
        .drop("_own", "_block")
    )
