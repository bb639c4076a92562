"""Filters and roll-ups over image annotation records (one row per image, annotations in an array of structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetally.functions.boxes import Box, mask_area
from scenetally.session import pin

BOX_KINDS = {"int": "long", "str": "string", None: "string"}


def has_non_crowd(annotations: Column) -> Column:
    return F.exists(annotations, lambda a: F.coalesce(a["iscrowd"], F.lit(0)) == 0)


def visible_keypoints(keypoints: Column) -> Column:
    """Points of a flat x, y, v list whose v is set."""
    return F.size(F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0)))


def enough_keypoints(annotations: Column, k: int) -> Column:
    total = F.aggregate(
        annotations, F.lit(0), lambda acc, a: acc + F.coalesce(visible_keypoints(a["keypoints"]), F.lit(0))
    )
    return total >= k


def valid_annotation(annotations: Column, min_objects: int = 1, min_keypoints: int | None = None) -> Column:
    """Not empty, some box with a side over 1, enough keypoints where asked for, enough objects."""
    sized = F.exists(annotations, lambda a: (a["x2"] - a["x1"] > 1) & (a["y2"] - a["y1"] > 1))
    ok = (F.size(annotations) >= F.lit(max(1, min_objects))) & sized
    if min_keypoints is not None:
        ok = ok & enough_keypoints(annotations, min_keypoints)
    return ok


def has_mask(annotations: Column, least: float = 1.0) -> Column:
    """Some annotation whose polygons enclose at least so much."""
    return F.exists(annotations, lambda a: mask_area(a["segmentation"]) >= least)


def keep_instance(general: list[Column], specific: list[Column]) -> Column:
    """All general predicates and, where any are given, at least one specific one."""
    out = F.lit(True)
    for p in general:
        out = out & p
    if specific:
        one = F.lit(False)
        for p in specific:
            one = one | p
        out = out & one
    return out


def whitelist_and_map(annotations: Column, allowed: list[str], mapping: dict[str, str]) -> Column:
    """Drop categories off the list, then rename by the map."""
    kept = F.filter(annotations, lambda a: a["category"].isin(allowed))
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.transform(kept, lambda a: a.withField("category", F.coalesce(F.try_element_at(pairs, a["category"]), a["category"])))


def field_selector(spec: str) -> Column:
    """'name[:type]=value' or 'name[:type]=min-max', joined by commas (all must hold); '*' selects everything."""
    if spec == "*":
        return F.lit(True)
    out = F.lit(True)
    for part in spec.split(","):
        head, equal, value = part.partition("=")
        name, _, kind = head.partition(":")
        if not equal or not name or not value or (kind or None) not in BOX_KINDS:
            raise ValueError(f"invalid field selector {part!r}")
        cast = BOX_KINDS[kind or None]
        low, dash, high = value.partition("-")
        if dash and low:
            test = F.col(name).cast(cast).between(F.lit(low).cast(cast), F.lit(high).cast(cast))
        else:
            test = F.col(name).cast(cast) == F.lit(value).cast(cast)
        out = out & test
    return out


def score_filter(entries: Column, minimum: float) -> Column:
    return F.filter(entries, lambda e: e["score"] >= minimum)


def proposal_filter(proposals: Column, width: Column, height: Column, k: int, min_side: float = 0.0) -> Column:
    """Clip to the image, drop empty boxes, keep the k best by score."""
    clipped = F.transform(
        proposals,
        lambda p: F.struct(
            (-p["score"]).alias("s"), p["id"].alias("id"),
            *[c.alias(n) for c, n in zip(_corners(Box.field(p).clipped(width, height)), ("x1", "y1", "x2", "y2"))],
        ),
    )
    return F.slice(F.array_sort(F.filter(clipped, lambda p: Box.field(p).nonempty(min_side))), 1, k)


def _corners(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.x2, b.y2


def category_histogram(annotations: DataFrame, category: str, crowd: str) -> DataFrame:
    """Instances per category without crowds, and the total (category NULL)."""
    return annotations.where(F.coalesce(F.col(crowd).cast("int"), F.lit(0)) == 0).rollup(category).agg(F.count("*").alias("n"))


def repeat_factors(annotations: DataFrame, image: str, category: str, threshold: float) -> DataFrame:
    """max over an image's categories of max(1, sqrt(threshold / share of images with the category))."""
    once = annotations.select(image, category).distinct()
    total = annotations.agg(F.count_distinct(image).cast("double").alias("n")).scalar()
    per = once.groupBy(category).agg(F.count("*").alias("_c")).withColumn("_n", total)
    factor = F.greatest(F.lit(1.0), F.sqrt(threshold / (F.col("_c") / F.col("_n"))))
    rated = per.select(category, factor.alias("_f"))
    return once.join(rated, category).groupBy(image).agg(F.max("_f").alias("repeat_factor"))


def value_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between minimum and maximum with the usual moments; empty bins are listed with 0."""
    stats = df.agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("num"),
        F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("sum_squares"),
    )
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).scalar()
    width = F.try_divide(F.col("_b.hi") - F.col("_b.lo"), F.lit(float(bins)))
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("_b.lo"), width)), F.lit(bins - 1))
    counts = df.where(F.col(value).isNotNull()).withColumn("_b", bounds).groupBy(F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    listed = stats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins
    return listed.join(counts, "bin", "left").select(
        "bin", edge.alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", "num", "total", "sum_squares"
    )


def merged_categories(maps: list[DataFrame], key: str, name: str) -> DataFrame:
    """Union of category tables with contiguous ids from 0; two names for one id raise an error when read."""
    whole = maps[0].select(key, name)
    for m in maps[1:]:
        whole = whole.unionByName(m.select(key, name))
    per = whole.groupBy(key).agg(F.min(name).alias(name), F.max(name).alias("_other"))
    checked = F.when(F.col(name) == F.col("_other"), F.col(name)).otherwise(
        F.raise_error(F.concat(F.lit("category with two names: "), F.col(key).cast("string")))
    )
    from scenetally.operators.ordered import positions

    return positions(per.select(key, checked.alias(name)), [], [key], "_pos").select(key, name, (F.col("_pos") - 1).alias("contiguous_id"))


def download_report(df: DataFrame, mime: str, status: str, size: str) -> dict[str, DataFrame]:
    """Counts by mime type, failures by status, and the log size of images."""
    kind = F.split(F.col(mime), ";")[0]
    return {
        "by_mime": df.groupBy(kind.alias("mime")).agg(F.count("*").alias("n")),
        "failures": df.where(F.col(status) != 200).groupBy(status).agg(F.count("*").alias("n")),
        "image_size": df.where(kind.startswith("image") & (F.col(size) > 0)).agg(
            F.count("*").alias("n"), F.avg(F.ln(size)).alias("mean_log"), F.min(F.ln(size)).alias("min_log"), F.max(F.ln(size)).alias("max_log")
        ),
    }


def assign_split(split: str, rest: str, train_only: bool) -> Column:
    """Split rows: none means all three, rest goes to train unless only train is wanted."""
    s = F.col(split)
    every = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    if train_only:
        other = F.when(s == rest, F.array().cast("array<string>"))
    else:
        other = F.when(s == rest, F.array(F.lit("train")))
    return F.explode(F.when(s.isNull(), every).otherwise(F.coalesce(other, F.array(s))))


def ref_split(split: str, wanted: str) -> Column:
    """testA, testB, testC match by suffix letter inside a test split; test matches any test split; others exactly."""
    s = F.col(split)
    if wanted in ("testA", "testB", "testC"):
        return F.contains(s, F.lit(wanted[-1]))
    if wanted == "test":
        return F.contains(s, F.lit("test"))
    return s == wanted


def count_valid(df: DataFrame, parsed: Column) -> DataFrame:
    """(clean, dirty): rows whose parse succeeded and rows left out."""
    return df.agg(F.count_if(parsed.isNotNull()).alias("clean"), F.count_if(parsed.isNull()).alias("dirty"))


def flatten_results(df: DataFrame, results: str, keep: list[str] = ()) -> DataFrame:
    """map<task, map<metric, value>> to rows 'task/metric'."""
    outer = df.select(*keep, F.explode(results).alias("task", "m"))
    return outer.select(*keep, "task", F.explode("m").alias("name", "value")).select(
        *keep, F.concat_ws("/", "task", "name").alias("metric"), "value"
    )


def verify_results(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected metrics that are missing, not finite or out of tolerance."""
    joined = expected.join(actual.select("metric", "value"), "metric", "left")
    good = (
        F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
        & (F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"))
    )
    return joined.where(~good)


def first_unused_examples(df: DataFrame, cls: str, image: str, arrival: str, n_classes: int | None = None) -> DataFrame:
    """One image per class in arrival order, no image twice; rows without class or image are no examples.

    A class can lose at most n_classes - 1 candidates to others, so its first n_classes candidates settle it. A candidate
    that comes first both among those left of its class and among those left of its image is taken by the greedy order
    whatever the others do. So each round takes all such candidates at once and drops what they rule out; the earliest
    candidate is always one of them, so the rounds end, mostly after a few.
    """
    once = df.where(F.col(cls).isNotNull() & F.col(image).isNotNull()).groupBy(cls, image).agg(F.min(arrival).alias("_at"))
    if n_classes is None:
        n_classes = once.select(cls).distinct().count()
    w = Window.partitionBy(cls).orderBy("_at", image)
    place = F.struct("_at", cls, image)
    left = pin(once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_classes).select(place.alias("_place")))
    taken = None
    while True:
        by_class = left.groupBy(f"_place.{cls}").agg(F.min("_place").alias("_place"))
        by_image = left.groupBy(f"_place.{image}").agg(F.min("_place").alias("_place"))
        now = pin(by_class.select("_place").join(by_image.select("_place"), "_place").select("_place.*"))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        rest = left.select("_place.*").join(now.select(cls), cls, "left_anti").join(now.select(image), image, "left_anti")
        left = pin(rest.select(place.alias("_place")))
    return (now if taken is None else taken).select(cls, image)
