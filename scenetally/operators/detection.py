"""Precision-recall curves and their summaries, segmentation and panoptic scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scenetally.operators.ordered import order_columns, scan_slices, sliced
from scenetally.session import pin

# Area ranges in pixels and IoU levels of the detection benchmarks.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
IOU_LEVELS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
RECALL_LEVELS = [i / 100 for i in range(101)]


def precision_recall(
    flags: DataFrame, keys: list[str], order: list[str], positives: DataFrame, positive_keys: list[str]
) -> DataFrame:
    """Cumulative tp, fp, precision, recall and the precision envelope of every curve.

    ``positives`` has n_pos per ``positive_keys``. Both scans use the same slices.
    """
    joined = flags.join(positives.select(*positive_keys, "n_pos"), positive_keys, "left")
    parts = sliced(joined, keys, order)
    summed = scan_slices(parts, keys, order, {"pos": ("count", None), "cum_tp": ("sum", "tp"), "cum_fp": ("sum", "fp")})
    rated = summed.withColumn(
        "precision", F.coalesce(F.try_divide("cum_tp", F.col("cum_tp") + F.col("cum_fp")), F.lit(0.0))
    ).withColumn("recall", F.try_divide("cum_tp", "n_pos"))
    return scan_slices(rated, keys, order, {"envelope": ("max_after", "precision")}).drop("_slice")


def count_positives(truths: DataFrame, keys: list[str]) -> DataFrame:
    counted = F.count_if(~F.col("difficult")) if "difficult" in truths.columns else F.count("*")
    return truths.groupBy(*keys).agg(counted.alias("n_pos"))


def average_precision_area(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the envelope: recall moves by 1/n at true positives only."""
    step = F.sum(F.when(F.col("tp") == 1, F.col("envelope")).otherwise(0.0))
    return curve.groupBy(*keys).agg(
        F.coalesce(F.try_divide(step, F.max("n_pos")), F.lit(0.0)).alias("ap"), F.coalesce(F.max("n_pos"), F.lit(0)).alias("n_pos")
    )


def average_precision_11(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over recall 0, .1 .. 1 of the best precision at or beyond it."""
    levels = [0.1 * i for i in range(11)]
    best = [F.coalesce(F.max(F.when(F.col("recall") >= t, F.col("precision"))), F.lit(0.0)) for t in levels]
    total = best[0]
    for b in best[1:]:
        total = total + b
    return curve.groupBy(*keys).agg((total / 11.0).alias("ap"), F.coalesce(F.max("n_pos"), F.lit(0)).alias("n_pos"))


def voc_map(aps: DataFrame, threshold: str = "threshold") -> DataFrame:
    """AP over all IoU levels, AP50 and AP75, in percent."""
    per = aps.groupBy(threshold).agg(F.avg("ap").alias("m"))
    return per.agg(
        (F.avg("m") * 100).alias("AP"),
        (F.max(F.when(F.round(threshold, 2) == 0.5, F.col("m"))) * 100).alias("AP50"),
        (F.max(F.when(F.round(threshold, 2) == 0.75, F.col("m"))) * 100).alias("AP75"),
    )


def class_thresholds(curve: DataFrame, cls: str, score: str) -> DataFrame:
    """Score of the best F value per class; classes without one get the mean of the others."""
    f = F.coalesce(F.try_divide(F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    best = curve.groupBy(cls).agg(
        F.max(F.struct(f.alias("f"), (-F.col("pos")).alias("p"), F.col(score).alias("s"))).alias("_b"), F.max("n_pos").alias("n_pos")
    )
    raw = best.select(cls, F.when(F.col("n_pos") > 1, F.col("_b.s")).otherwise(0.0).alias("_t"))
    mean = raw.where("_t <> 0").agg(F.avg("_t").alias("m")).scalar()
    return raw.withColumn("_mean", mean).select(cls, F.when(F.col("_t") == 0, F.col("_mean")).otherwise(F.col("_t")).alias("threshold"))


def weighted_map(aps: DataFrame) -> DataFrame:
    return aps.agg(
        F.avg("ap").alias("mean_ap"),
        F.try_divide(F.sum(F.col("ap") * F.col("n_pos")), F.sum("n_pos")).alias("weighted_ap"),
    )


def _pieces(batches: Iterator[pa.RecordBatch], cls: str, n: int) -> Iterator[tuple[int, object, dict[str, np.ndarray]]]:
    """(slice, class, columns) of the runs of one class in the batches of a slice, tp and fp with one column a setting."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        runs = pc.run_end_encode(batch.column(cls))
        columns = {c: batch.column(c).flatten().to_numpy().reshape(-1, n) for c in ("tp", "fp")}
        for c in batch.schema.names:
            if c == "n_pos":
                columns[c] = batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1)
            elif c == "place":
                columns[c] = batch.column(c).to_numpy()
        start, number = 0, batch.column("_slice")[0].as_py()
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            yield number, key, {c: v[start:end] for c, v in columns.items()}
            start = end


def _precision(piece: dict[str, np.ndarray], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(true positives so far, precision, totals after the piece) from the tp and fp totals before it."""
    tp, fp = (np.cumsum(piece[c], axis=0, dtype=np.int64) + b for c, b in zip(("tp", "fp"), before))
    return tp, np.divide(tp, tp + fp, out=np.zeros(tp.shape), where=tp + fp > 0), np.stack([tp[-1], fp[-1]])


def _edges(parts: DataFrame, cls: str, n: int, value: Callable, fold: Callable) -> dict[int, list[tuple]]:
    """Per slice (class, folded values) of its first and, where there are more, its last class."""
    field, kind = parts.schema[cls].dataType.simpleString(), to_arrow_type(parts.schema[cls].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ends = None, []
        for number, key, piece, got in value(_pieces(batches, cls, n)):
            if ends and ends[-1][0] == key:
                ends[-1] = (key, fold(ends[-1][1], got))
            else:
                ends = [*ends[:1], (key, got)]
        if ends:
            cells = pa.array([np.ravel(v).astype(float) for _, v in ends], pa.list_(pa.float64()))
            where = [pa.array([number] * len(ends), pa.int32()), pa.array(range(len(ends)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*where, pa.array([k for k, _ in ends], kind), cells], names=["_slice", "no", cls, "v"])

    out = {}
    # at most two rows a slice
    for row in sorted(parts.mapInArrow(scan, f"_slice int, no int, {cls} {field}, v array<double>").collect(), key=lambda r: r[:2]):
        out.setdefault(row[0], []).append((row[2], np.array(row[3])))
    return out


def _carried(edges: dict[int, list[tuple]], fold: Callable, back: bool) -> dict[int, np.ndarray]:
    """What earlier slices give the first class of a slice, or later ones its last class."""
    carried, key, held = {}, None, None
    for number in sorted(edges, reverse=not back):
        ends = edges[number] if back else edges[number][::-1]
        if held is not None and ends[0][0] == key:
            carried[number] = held
        key, held = ends[-1]
        if len(ends) == 1 and number in carried:
            held = fold(carried[number], held)
    return carried


def curve_sums(
    flags: DataFrame, cls: str, order: list[str], n: int, positives: DataFrame | None = None, area_of: list[int] = (), limits: list[int] = ()
) -> DataFrame:
    """Per class and setting i of a tp / fp array: step, the envelope summed over the true positives, its top and the count found.

    With ``positives`` (n_pos array per class) the k-th of n true positives counts 100k div n - 100(k-1) div n times, n being
    entry ``area_of[i]``. found_m counts those of a place up to m. All settings rank the same detections, so they share one
    ordering: a slice is read once for its totals, once for its best precision and once for the sums, and only the values
    of its first and last class go from slice to slice.
    """
    names = [o.removeprefix("-") for o in order]
    ranged = flags.select(cls, *names, "tp", "fp").repartitionByRange(F.col(cls), *order_columns(order))
    whole = ranged.sortWithinPartitions(F.col(cls), *order_columns(order)).withColumn("_slice", F.spark_partition_id())
    parts = pin(whole.select("_slice", cls, *(["place"] if limits else []), "tp", "fp"))
    none, kind = np.zeros((2, n)), to_arrow_type(flags.schema[cls].dataType)

    def forward(pieces, back: dict[int, np.ndarray]) -> Iterator[tuple]:
        last, before = None, None
        for number, key, piece in pieces:
            if before is None:
                before = back.get(number, none).reshape(2, n).astype(np.int64)
            elif key != last:
                before = none.astype(np.int64)
            start, last = before, key
            cum, precision, before = _precision(piece, before)
            yield number, key, piece, start, precision

    def totals(pieces):
        for number, key, piece in pieces:
            yield number, key, piece, np.stack([piece[c].sum(axis=0, dtype=np.int64) for c in ("tp", "fp")])

    back = _carried(_edges(parts, cls, n, totals, np.add), np.add, True)

    def peaks(pieces):
        for number, key, piece, _, precision in forward(pieces, back):
            yield number, key, piece, precision.max(axis=0)

    ahead = _carried(_edges(parts, cls, n, peaks, np.maximum), np.maximum, False)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the flags of one slice, of a byte each
        held = [(number, key, piece, start) for number, key, piece, start, _ in forward(_pieces(batches, cls, n), back)]
        top, following, out = None, None, {}
        for number, key, piece, start in reversed(held):
            if top is None:
                top = ahead.get(number, np.zeros(n))
            elif key != following:
                top = np.zeros(n)
            following = key
            cum, precision, _ = _precision(piece, start)
            envelope = np.maximum(np.maximum.accumulate(precision[::-1], axis=0)[::-1], top)
            top, hit = envelope[0], piece["tp"] == 1
            weight = hit
            if "n_pos" in piece:
                most = piece["n_pos"][0][list(area_of)]
                n_pos = np.maximum(most, 1)
                weight = np.where(hit & (most > 0), 100 * cum // n_pos - (100 * cum - 100) // n_pos, 0)
            got = [(envelope * weight).sum(axis=0), top, hit.sum(axis=0), *[(hit & (piece["place"] <= m)[:, None]).sum(axis=0) for m in limits]]
            if key in out:
                old = out[key]
                got = [old[0] + got[0], np.maximum(old[1], got[1]), *[a + b for a, b in zip(old[2:], got[2:])]]
            out[key] = got
        if out:
            keys = pa.array([k for k in out for _ in range(n)], kind)
            columns = [pa.array(np.concatenate(v)) for v in zip(*out.values())]
            place = pa.array(np.tile(np.arange(n, dtype=np.int32), len(out)))
            yield pa.RecordBatch.from_arrays([keys, place, *columns], names=[cls, "i", "step", "top", *found])

    found = ["found", *[f"found_{m}" for m in limits]]
    # the closed list of classes
    read = parts if positives is None else parts.join(F.broadcast(positives), cls)
    schema = f"{cls} {flags.schema[cls].dataType.simpleString()}, i int, step double, top double, " + ", ".join(f"{c} long" for c in found)
    return read.mapInArrow(sums, schema).groupBy(cls, "i").agg(F.sum("step").alias("step"), F.max("top").alias("top"), *[F.sum(c).alias(c) for c in found])


def wide_area_ap(flags: DataFrame, cls: str, order: list[str], thresholds: list[float], positives: DataFrame) -> DataFrame:
    """Area AP per (class, threshold) from a tp / fp array over the thresholds."""
    steps = curve_sums(flags, cls, order, len(thresholds))
    level = F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("i"))
    return steps.join(positives, cls, "left").select(
        cls, level.alias("threshold"), F.coalesce(F.try_divide("step", "n_pos"), F.lit(0.0)).alias("ap"), F.coalesce("n_pos", F.lit(0)).alias("n_pos")
    )


def valid_truths(truths: DataFrame, cls: str, areas: dict[str, tuple[float, float]]) -> DataFrame:
    """Array of the truths that count per area range, for every class."""
    plain = ~F.col("iscrowd").cast("boolean")
    counts = [F.count_if(plain & (F.col("area") >= lo) & (F.col("area") <= hi)) for lo, hi in areas.values()]
    return truths.groupBy(cls).agg(F.array(*counts).alias("n_pos"))


def coco_ap(
    flags: DataFrame, truths: DataFrame, image: str, cls: str, score: str,
    areas: dict[str, tuple[float, float]], thresholds: list[float] | None = None, limits: list[int] = (1, 10),
) -> DataFrame:
    """AP and final recall per (class, area, threshold), precision read at recall 0, .01 .. 1; wide flags in.

    Also recall_m for each of ``limits``, the recall of the first m detections of an image and class: detections are matched
    in score order, so what the first m take does not depend on the later ones, and one matching serves all limits.

    A recall level i/100 belongs to the first row that reaches it, which is a true positive, so the k-th of n true
    positives reads 100k div n - 100(k-1) div n levels; level 0 reads the best precision of the curve.
    """
    levels = thresholds or IOU_LEVELS
    cells = [(a, j, t) for j, a in enumerate(areas) for t in levels]
    positives = valid_truths(truths, cls, areas)
    # pinned, or the sampling for the range partitioning would run the Python match a second time
    order = [f"-{score}", image, "place"]
    used = flags.select(image, cls, score, "place", "tp", "fp")
    got = curve_sums(pin(used), cls, order, len(cells), positives, [j for _, j, _t in cells], list(limits))
    names = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(j).alias("j"), F.lit(float(t)).alias("threshold")) for a, j, t in cells])
    rows = positives.select(cls, "n_pos", F.posexplode(names).alias("i", "c")).join(got, [cls, "i"], "left")
    n = F.col("n_pos")[F.col("c.j")]

    def recall(found: str) -> Column:
        return F.coalesce(F.try_divide(F.col(found), n), F.lit(0.0))

    ap = F.coalesce((F.col("step") + F.col("top")) / len(RECALL_LEVELS), F.lit(0.0))
    return rows.select(
        cls, "c.area", "c.threshold", n.alias("n_pos"), ap.alias("ap"),
        recall("found").alias("recall"), *[recall(f"found_{m}").alias(f"recall_{m}") for m in limits],
    ).where("n_pos > 0")


def coco_summary(aps: DataFrame) -> DataFrame:
    """Long rows (metric, value in percent)."""
    whole = F.col("area") == "all"

    def mean(cond: Column, column: str = "ap") -> Column:
        return F.avg(F.when(cond, F.col(column))) * 100

    one = aps.agg(
        mean(whole).alias("AP"),
        mean(whole & (F.col("threshold") == 0.5)).alias("AP50"),
        mean(whole & (F.col("threshold") == 0.75)).alias("AP75"),
        mean(F.col("area") == "small").alias("APs"),
        mean(F.col("area") == "medium").alias("APm"),
        mean(F.col("area") == "large").alias("APl"),
        *[mean(whole, c).alias(f"AR{c.removeprefix('recall_')}") for c in aps.columns if c.startswith("recall_")],
        mean(whole, "recall").alias("AR"),
        mean(F.col("area") == "small", "recall").alias("ARs"),
        mean(F.col("area") == "medium", "recall").alias("ARm"),
        mean(F.col("area") == "large", "recall").alias("ARl"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def category_ap(aps: DataFrame, cls: str) -> DataFrame:
    return aps.where("area = 'all'").groupBy(cls).agg((F.avg("ap") * 100).alias("ap"))


def frequency_group_ap(per_category: DataFrame, frequencies: DataFrame, cls: str) -> DataFrame:
    """Mean AP of rare, common and frequent categories (frequency r, c, f)."""
    return per_category.join(frequencies, cls).groupBy("frequency").agg(F.avg("ap").alias("ap"), F.count("*").alias("n"))


def frequency_group(n_images: Column) -> Column:
    """Rare up to 10 images, common up to 100."""
    return F.when(n_images <= 10, "r").when(n_images <= 100, "c").otherwise("f")


def average_recall(cover: DataFrame, keys: list[str]) -> DataFrame:
    """Recall at each IoU level and their mean."""
    levels = F.array(*[F.lit(t) for t in IOU_LEVELS])
    hits = F.size(F.filter(levels, lambda t: F.col("cover") >= t))
    return cover.groupBy(*keys).agg((F.sum(hits) / (F.count("*") * len(IOU_LEVELS))).alias("ar"), F.count("*").alias("n_pos"))


# ---- segmentation ---------------------------------------------------------------------------------------------------


def confusion_matrix(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.groupBy(predicted, truth).agg(F.count("*").alias("n"))


def class_scores(confusion: DataFrame, predicted: str, truth: str) -> DataFrame:
    """tp, truth and prediction totals with IoU and accuracy per class."""
    hit = F.when(F.col(predicted) == F.col(truth), F.col("n")).otherwise(0)
    by_truth = confusion.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("n_truth"), F.sum(hit).alias("tp"))
    by_pred = confusion.groupBy(F.col(predicted).alias("cls")).agg(F.sum("n").alias("n_pred"))
    both = by_truth.join(by_pred, "cls", "full").na.fill(0, ["n_truth", "tp", "n_pred"])
    in_truth = F.col("n_truth") > 0
    return both.select(
        "cls", "n_truth", "n_pred", "tp",
        F.when(in_truth, F.col("tp") / (F.col("n_truth") + F.col("n_pred") - F.col("tp"))).alias("iou"),
        F.when(in_truth, F.col("tp") / F.col("n_truth")).alias("acc"),
    )


def segmentation_metrics(scores: DataFrame) -> DataFrame:
    """mIoU divides by all classes seen but sums those with truth."""
    return scores.agg(
        (F.sum("iou") * 100 / F.count_if((F.col("n_truth") > 0) | (F.col("n_pred") > 0))).alias("mIoU"),
        (F.sum(F.col("iou") * F.col("n_truth")) * 100 / F.sum("n_truth")).alias("fwIoU"),
        (F.avg("acc") * 100).alias("mACC"),
        (F.sum("tp") * 100.0 / F.sum("n_truth")).alias("pACC"),
    )


def segment_rows(pixels: DataFrame, image: str, category: str) -> DataFrame:
    """One row per category present in an image with its size."""
    return pixels.groupBy(image, category).agg(F.count("*").alias("area"))


def panoptic_quality(segments: DataFrame, category: str, isthing: str) -> DataFrame:
    """PQ, SQ, RQ for All, Things and Stuff from segment rows with status tp / fp / fn and iou."""
    per = segments.groupBy(category, isthing).agg(
        F.coalesce(F.sum(F.when(F.col("status") == "tp", F.col("iou"))), F.lit(0.0)).alias("iou_sum"),
        F.count_if(F.col("status") == "tp").alias("tp"),
        F.count_if(F.col("status") == "fp").alias("fp"),
        F.count_if(F.col("status") == "fn").alias("fn"),
    )
    half = F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2
    rated = per.where(half > 0).select(
        isthing,
        (F.col("iou_sum") / half).alias("pq"),
        F.coalesce(F.try_divide("iou_sum", "tp"), F.lit(0.0)).alias("sq"),
        (F.col("tp") / half).alias("rq"),
    )
    named = rated.select("*", F.explode(F.array(F.lit("All"), F.when(F.col(isthing), "Things").otherwise("Stuff"))).alias("group"))
    return named.groupBy("group").agg(
        (F.avg("pq") * 100).alias("PQ"), (F.avg("sq") * 100).alias("SQ"), (F.avg("rq") * 100).alias("RQ"), F.count("*").alias("n")
    )


def grounding_accuracy(chosen: DataFrame, threshold: float = 0.5) -> DataFrame:
    return chosen.agg(F.count("*").alias("n"), F.avg((F.col("iou") > threshold).cast("int")).alias("accuracy"))
