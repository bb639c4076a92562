"""Joins and roll-ups over trace tables: marker intervals, kernels, launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.operators.ordered import running

BEGIN, END = 2, 4  # marker flags
LEVEL_STEP = 4  # cells of one level are 16 times as wide as those of the one below


def marker_intervals(markers: DataFrame, key: str, at: str, flags: str, keep: list[str]) -> DataFrame:
    """Begin and end rows of one marker id to an interval."""
    begin = markers.where(F.col(flags) == BEGIN).select(key, F.col(at).alias("start_time"), *keep)
    end = markers.where(F.col(flags) == END).select(key, F.col(at).alias("end_time"))
    return begin.join(end, key)


def profile_start(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Earliest time over several tables."""
    out = None
    for df, at in tables:
        low = df.agg(F.min(at).alias("start"))
        out = low if out is None else out.unionByName(low)
    return out.agg(F.min("start").alias("start"))


def interval_level(length: Column) -> Column:
    """The exponent of the cell width of an interval, a multiple of ``LEVEL_STEP``."""
    return (F.ceil(F.log2(length.cast("double")) / LEVEL_STEP) * LEVEL_STEP).cast("int")


def enclosing(
    inner: DataFrame, outer: DataFrame, keys: list[str], lo: str, hi: str, start: str, end: str
) -> DataFrame:
    """Pairs with start < lo and end > hi on equal keys; times are whole numbers.

    An outer interval of length up to 2^k lies in at most two cells of width 2^k, so at its own level it is stored at most
    twice; an inner row looks into one cell per level in use. The join key then holds the cell, so neither one busy object
    nor long intervals meet all rows of the object. Inner rows are copied once a level, so only every fourth power is one.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    ranked = outer.where(F.col(end) > F.col(start)).withColumn("_level", interval_level(length))
    width = F.pow(F.lit(2.0), F.col("_level"))
    cells = F.array_distinct(F.array(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    stored = ranked.select("*", F.explode(cells).alias("_cell"))
    levels = ranked.agg(F.collect_set("_level").alias("l")).scalar()  # at most 17 values
    probes = inner.withColumn("_levels", levels).select("*", F.explode("_levels").alias("_level")).drop("_levels")
    probes = probes.withColumn("_cell", F.floor(F.col(lo) / F.pow(F.lit(2.0), F.col("_level"))))
    joined = probes.join(stored, [*keys, "_level", "_cell"])
    return joined.where((F.col(start) < F.col(lo)) & (F.col(end) > F.col(hi))).drop("_level", "_cell")


def between_launches(markers: DataFrame, launches: DataFrame, obj: str, marker_id: str, launch_id: str) -> DataFrame:
    """Each marker with the first launch after it on the same object.

    The ranges between consecutive launches do not overlap, so the range join is a look ahead in id order.
    """
    m = markers.select(obj, F.col(marker_id).alias("_id"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_launch"))
    k = launches.select(obj, F.col(launch_id).alias("_id"), F.lit(1).alias("_kind"), F.col(launch_id).cast("long").alias("_launch"))
    both = running(m.unionByName(k), [obj], ["-_id", "_kind"], {"next_launch": ("min", "_launch")})
    return both.where("_kind = 0 AND next_launch IS NOT NULL").select(obj, F.col("_id").alias(marker_id), "next_launch")


def cpu_info(kernels: DataFrame, runtime: DataFrame, driver: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields from the runtime table, from the driver table where the runtime has none."""
    a = runtime.select(key, F.struct(*fields).alias("_a"))
    b = driver.select(key, F.struct(*fields).alias("_b"))
    return kernels.join(a, key, "left").join(b, key, "left").select(
        *kernels.columns, *[F.coalesce("_a", "_b")[f].alias(f) for f in fields]
    )


def last_forward(events: DataFrame, idx: str, direction: str, seq: str, alt: str) -> DataFrame:
    """For each backward row the latest earlier forward row with its sequence id, looked up by alternate ids second.

    ``seq`` and ``alt`` are arrays. Forward and backward rows of an id are scanned together in index order.
    """
    forward = events.where(F.col(direction) == "fprop")
    backward = events.where(F.col(direction) == "bprop").select(idx, F.col(seq)[0].alias("_s"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_f"))

    def look_up(ids: str, out: str) -> DataFrame:
        known = forward.select(idx, F.explode(ids).alias("_s"), F.lit(0).alias("_kind"), F.col(idx).cast("long").alias("_f"))
        scanned = running(known.unionByName(backward), ["_s"], [idx, "_kind", "_f"], {out: ("max", "_f")})
        return scanned.where("_kind = 1").select(idx, out)

    return look_up(seq, "_first").join(look_up(alt, "_second"), idx).select(
        idx, F.coalesce("_first", "_second", F.lit(-1)).alias("forward_idx")
    )


# Contained texts that tell the marker kinds apart, tried in this order.
MARKER_KINDS = [
    ("layer", ["layer:"]),
    ("trace", ["traceMarker"]),
    ("repr", ["strRepr"]),
    ("seq", [", seq = "]),
]


def marker_kind(text: Column) -> Column:
    out = F.when(
        F.contains(text, F.lit("mod")) & F.contains(text, F.lit("op")) & F.contains(text, F.lit("args")) & F.contains(text, F.lit("type")),
        "call",
    )
    for name, marks in MARKER_KINDS:
        for mark in marks:
            out = out.when(F.contains(text, F.lit(mark)), name)
    return out.otherwise("other")


def marker_fields(text: Column) -> Column:
    """Kind, layer name, sequence id and backward flag of a marker text."""
    backward = F.lit(False)
    for mark in ("_backward, seq =", "Backward, seq =", "Backward0, seq ="):
        backward = backward | F.contains(text, F.lit(mark))
    layer = F.nullif(F.regexp_extract(text, r"layer:([^,]*)", 1), F.lit(""))
    seq = F.nullif(F.regexp_extract(text, r", seq = ?(\d+)", 1), F.lit("")).cast("long")
    return F.struct(marker_kind(text).alias("kind"), layer.alias("layer"), seq.alias("seq"), backward.alias("backward"))


def trace_rollup(kernels: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Total duration and calls by the chosen columns."""
    return kernels.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("duration"), F.count("*").alias("calls"))
