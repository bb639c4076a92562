"""Suppression and matching of boxes inside one image.

An image holds a bounded number of boxes, so it is the unit that is packed into a row; a category or a class is not, and
is never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetally.functions.boxes import Box

CORNERS = ["x1", "y1", "x2", "y2"]


def _clash(a: np.ndarray, b: np.ndarray, iou: float, offset: float) -> np.ndarray:
    """Overlap of more than ``iou``; a missing corner overlaps nothing."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]) + offset
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]) + offset
    common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    size_a, size_b = ((c[:, 2] - c[:, 0] + offset) * (c[:, 3] - c[:, 1] + offset) for c in (a, b))
    union = size_a + size_b - common
    return np.divide(common, union, out=np.zeros_like(common), where=union != 0) > iou


def nms_groups(boxes: np.ndarray, sizes: np.ndarray, iou: float, offset: float) -> np.ndarray:
    """Boxes that stay in a greedy pass over each group, whose boxes are in score order; groups follow each other.

    A box that no undecided earlier one overlaps stays and takes out those it overlaps; all such boxes go in one round.
    """
    out = np.zeros(len(boxes), dtype=bool)
    if len(sizes) == 1 and sizes[0] ** 2 > PAIRS_AT_ONCE:
        for i in range(len(boxes) - 1):
            if not out[i]:
                out[i + 1 :] |= _clash(boxes[i : i + 1], boxes[i + 1 :], iou, offset)
        return ~out
    a, b = _group_pairs(sizes, sizes)
    a, b = a[a < b], b[a < b]
    near = _clash(boxes[a], boxes[b], iou, offset)
    a, b = a[near], b[near]
    while len(a):
        open_ = np.zeros(len(boxes), dtype=bool)
        open_[b] = True
        out[b[~open_[a]]] = True
        left = ~out[a] & ~out[b]
        a, b = a[left], b[left]
    return ~out


def _judged(boxes: DataFrame, image: str, cls: str, box: str, score: str, iou: float, offset: float) -> DataFrame:
    """Every box with ``_kept``, whether it stays after suppression inside its (image, class); _s is the negative score."""
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    entry = F.struct(F.col(cls).alias("_c"), (-F.col(score)).alias("_s"), F.col(box).alias("_b"), *corners)
    packed = boxes.groupBy(image).agg(F.array_sort(F.collect_list(entry)).alias("_boxes"))
    types = {f.name: f.dataType.simpleString() for f in packed.schema["_boxes"].dataType.elementType.fields}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for run in _runs(_sizes(whole.column("_boxes")) ** 2):
                batch = whole.slice(run.start, run.stop - run.start)
                sizes, flat = _sizes(batch.column("_boxes")), batch.column("_boxes").flatten()
                group = np.repeat(np.arange(len(sizes)), sizes)
                at = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in CORNERS], axis=1)
                # the boxes of an image come class by class
                code = pc.fill_null(flat.field("_c").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(code) != 0)))
                kept = pa.array(nms_groups(at, np.diff(np.append(starts, len(at))), iou, offset))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(image).take(pa.array(group)), *[flat.field(c) for c in types], kept], names=[image, *types, "_kept"]
                )

    key = f"{image} {boxes.schema[image].dataType.simpleString()}, "
    return packed.mapInArrow(judge, key + ", ".join(f"{c} {k}" for c, k in types.items()) + ", _kept boolean")


def class_nms(
    boxes: DataFrame, image: str, cls: str, box: str, score: str, iou: float, offset: float = 0.0
) -> DataFrame:
    """Boxes left after suppression inside each (image, class)."""
    kept = _judged(boxes, image, cls, box, score, iou, offset).where("_kept")
    return kept.select(image, F.col("_c").alias(cls), F.col("_b").alias(box), *CORNERS, (-F.col("_s")).alias(score))


def _bounded_pick(scored: DataFrame, image: str, box: str, conf: float, minimum: int, maximum: int) -> DataFrame:
    """Boxes at or above the confidence, but never fewer than ``minimum`` nor more than ``maximum`` per image, best first."""
    per = scored.groupBy(image).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("s"), F.col(box).alias("b")))).alias("_l"),
        F.count_if(F.col("conf") >= conf).cast("int").alias("_n"),
    )
    take = F.least(F.greatest(F.col("_n"), F.lit(minimum)), F.lit(maximum))
    return per.select(image, F.posexplode(F.slice("_l", 1, take)).alias("i", "k")).select(
        image, F.col("k.b").alias(box), (-F.col("k.s")).alias("conf"), (F.col("i") + 1).alias("rank")
    )


def select_boxes(
    scores: DataFrame, image: str, box: str, cls: str, score: str, conf: float, minimum: int, maximum: int,
    iou: float = 0.3, background: int | None = 0,
) -> DataFrame:
    """Suppression on each box's best foreground class, then the bounded pick. One input row per (box, class)."""
    fore = scores if background is None else scores.where(F.col(cls) != background)
    best = fore.groupBy(image, box).agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(cls).alias("c"), *CORNERS)).alias("_m")
    ).select(image, box, F.col("_m.c").alias(cls), (-F.col("_m.s")).alias(score), *[f"_m.{c}" for c in CORNERS])
    kept = class_nms(best, image, cls, box, score, iou)
    return _bounded_pick(kept.withColumnRenamed(score, "conf"), image, box, conf, minimum, maximum)


def select_boxes_all_classes(
    scores: DataFrame, image: str, box: str, cls: str, score: str, conf: float, minimum: int, maximum: int,
    iou: float = 0.3, background: int | None = 0,
) -> DataFrame:
    """Suppression under every class; a box counts with its best surviving confidence, 0 if it survives nowhere."""
    fore = scores if background is None else scores.where(F.col(cls) != background)
    judged = _judged(fore, image, cls, box, score, iou, 0.0)
    every = judged.select(image, F.col("_b").alias(box), F.when(F.col("_kept"), -F.col("_s")).alias("_conf"))
    if background is not None:
        every = every.unionByName(scores.select(image, box, F.lit(None).cast(every.schema["_conf"].dataType).alias("_conf")))
    best = every.groupBy(image, box).agg(F.coalesce(F.max("_conf"), F.lit(0.0)).alias("conf"))
    return _bounded_pick(best, image, box, conf, minimum, maximum)


def overlaps(
    dets: DataFrame, truths: DataFrame, keys: list[str], det_id: str, truth_id: str, offset: float = 0.0, keep: list[str] = ()
) -> DataFrame:
    """IoU of every detection with every truth of the same keys (image, or image and class)."""
    d = dets.select(*keys, det_id, *[F.col(c).alias(f"d_{c}") for c in CORNERS])
    g = truths.select(*keys, truth_id, *keep, *[F.col(c).alias(f"g_{c}") for c in CORNERS])
    joined = d.join(g, keys)
    return joined.select(*keys, det_id, truth_id, *keep, Box.of("d_").iou(Box.of("g_"), offset).alias("iou"))


def best_truth(pairs: DataFrame, keys: list[str], det_id: str, truth_id: str, keep: list[str] = ()) -> DataFrame:
    """Truth of largest overlap per detection, the lowest id on a tie."""
    best = pairs.groupBy(*keys, det_id).agg(F.min(F.struct((-F.col("iou")).alias("i"), truth_id, *keep)).alias("_m"))
    return best.select(*keys, det_id, (-F.col("_m.i")).alias("iou"), f"_m.{truth_id}", *[f"_m.{k}" for k in keep])


def voc_match_wide(
    dets: DataFrame, truths: DataFrame, image: str, cls: str, det_id: str, truth_id: str, score: str,
    thresholds: list[float], offset: float = 1.0, inclusive: bool = False,
) -> DataFrame:
    """One row per detection with tp and fp arrays over the IoU thresholds.

    A detection only ever tries its one best truth, so the greedy pass reduces to: the first detection of a truth in
    score order whose overlap passes hits, later ones miss, difficult truths count for nothing. Whether an earlier one
    passed a threshold follows from the best overlap so far, so one window serves all thresholds.
    """
    keys = [image, cls]
    flags = truths if "difficult" in truths.columns else truths.withColumn("difficult", F.lit(False))
    best = best_truth(overlaps(dets, flags, keys, det_id, truth_id, offset, ["difficult"]), keys, det_id, truth_id, ["difficult"])
    scored = dets.select(*keys, det_id, score).join(best, [*keys, det_id], "left")
    earlier = Window.partitionBy(*keys, truth_id).orderBy(F.col(score).desc(), det_id).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col(truth_id).isNotNull(), F.max("iou").over(earlier))
    placed = scored.withColumn("_before", F.coalesce(seen, F.lit(-1.0))).withColumn("iou", F.coalesce("iou", F.lit(-1.0)))
    easy = ~F.coalesce("difficult", F.lit(False))

    def passes(value: Column, level: Column) -> Column:
        return value >= level if inclusive else value > level

    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    own, before = F.col("iou"), F.col("_before")
    tp = F.transform(levels, lambda t: (passes(own, t) & easy & ~passes(before, t)).cast("int"))
    fp = F.transform(levels, lambda t: (~passes(own, t) | (easy & passes(before, t))).cast("int"))
    return placed.select(*keys, det_id, score, tp.alias("tp"), fp.alias("fp"))


def voc_match(
    dets: DataFrame, truths: DataFrame, image: str, cls: str, det_id: str, truth_id: str, score: str,
    thresholds: list[float], offset: float = 1.0, inclusive: bool = False,
) -> DataFrame:
    """The same flags with one row per detection and threshold."""
    wide = voc_match_wide(dets, truths, image, cls, det_id, truth_id, score, thresholds, offset, inclusive)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return wide.select(image, cls, det_id, score, F.explode(F.arrays_zip(levels.alias("threshold"), "tp", "fp")).alias("f")).select(
        image, cls, det_id, score, "f.threshold", "f.tp", "f.fp"
    )


def threshold_assignment(
    boxes: DataFrame, truths: DataFrame, image: str, box_id: str, truth_id: str,
    thresholds: list[float], labels: list[int], low_quality: bool = True, offset: float = 0.0,
) -> DataFrame:
    """Best truth and label of every box by overlap interval; optionally each truth's best boxes are positive."""
    return assign_labels(
        overlaps(boxes, truths, [image], box_id, truth_id, offset), boxes.select(image, box_id),
        image, box_id, truth_id, thresholds, labels, low_quality,
    )


def assign_labels(
    pairs: DataFrame, boxes: DataFrame, image: str, box_id: str, truth_id: str,
    thresholds: list[float], labels: list[int], low_quality: bool = True,
) -> DataFrame:
    """The same from ready qualities (image, box, truth, iou)."""
    peak = Window.partitionBy(image, truth_id)
    marked = pairs.withColumn("_top", (F.col("iou") == F.max("iou").over(peak)).cast("int"))
    per = marked.groupBy(image, box_id).agg(
        F.min(F.struct((-F.col("iou")).alias("i"), truth_id)).alias("_m"), F.max("_top").alias("_forced")
    )
    value = F.coalesce(-F.col("_m.i"), F.lit(0.0))
    label = F.lit(labels[0])
    for bound, name in zip(thresholds, labels[1:]):
        label = F.when(value >= bound, F.lit(name)).otherwise(label)
    if low_quality:
        label = F.when(F.col("_forced") == 1, F.lit(1)).otherwise(label)
    return boxes.join(per, [image, box_id], "left").select(
        image, box_id, F.col(f"_m.{truth_id}").alias(truth_id), value.alias("iou"), label.alias("label")
    )


# ---- order-dependent matching, one packed image at a time ----------------------------------------------------------


def _packed_images(
    dets: DataFrame, truths: DataFrame, keys: list[str], det_fields: list[Column], truth_fields: list[Column]
) -> DataFrame:
    d = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*det_fields))).alias("d"))
    g = truths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*truth_fields))).alias("g"))
    both = d.join(g, keys, "full")
    fields_d = [c for c in both.schema["d"].dataType.elementType.names]
    fields_g = [c for c in both.schema["g"].dataType.elementType.names]
    return both.select(
        *keys, *[F.col(f"d.{f}").alias(f"d_{f}") for f in fields_d], *[F.col(f"g.{f}").alias(f"g_{f}") for f in fields_g]
    )


PAIRS_AT_ONCE = 200_000


def _runs(cost: np.ndarray) -> Iterator[slice]:
    """Runs of consecutive groups of about ``PAIRS_AT_ONCE`` pairs; a larger group is a run of its own."""
    total, start = np.cumsum(cost), 0
    while start < len(cost):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        yield slice(start, end)
        start = end


def _group_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (left, right) of all pairs inside each group; the rows of the groups follow each other on both sides."""
    n = left * right
    group = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(group)) - (np.cumsum(n) - n)[group]
    width = right[group]
    return (np.cumsum(left) - left)[group] + inside // width, (np.cumsum(right) - right)[group] + inside % width


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _values(lists: pa.Array) -> np.ndarray:
    """All values of a list column one after the other, a missing one is NaN."""
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def _corners(batch: pa.RecordBatch, side: str) -> np.ndarray:
    return np.stack([_values(batch.column(f"{side}_{c}")) for c in CORNERS], axis=1)


def _pair_iou(a: np.ndarray, b: np.ndarray, crowd: np.ndarray | None = None) -> np.ndarray:
    """Continuous IoU of boxes in the last axis; against a crowd box the union is the detection alone."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    common = np.clip(w, 0, None) * np.clip(h, 0, None)
    size_a = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1])
    size_b = (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = size_a + size_b - common
    if crowd is not None:
        union = np.where(crowd, size_a, union)
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def iou_matrix(a: np.ndarray, b: np.ndarray, crowd: np.ndarray | None = None) -> np.ndarray:
    """Continuous IoU of (n, 4) and (m, 4)."""
    return _pair_iou(a[:, None, :], b[None, :, :], None if crowd is None else crowd[None, :])


def coco_match_groups(det, truth, iou, place, areas, crowd, truth_areas, thresholds, ranges):
    """Greedy match of many images and categories side by side, detections of each in score order.

    Pairs are (det, truth, iou) by row number, ``place`` is the place of a detection in its own group. Returns (matched,
    ignored) of shape (detections, ranges, thresholds). A detection takes the free truth of largest overlap at or above
    the threshold; truths in the area range go before ignored ones; a crowd can be taken again and again. The n-th
    detections of all groups, all ranges and all thresholds are matched at once.
    """
    low, high = np.array([r[0] for r in ranges]), np.array([r[1] for r in ranges])
    level = np.minimum(np.asarray(thresholds), 1 - 1e-10)
    outside = (areas[:, None] < low) | (areas[:, None] > high)
    matched = np.zeros((len(areas), len(ranges), len(thresholds)), dtype=bool)
    ignored = np.repeat(outside[:, :, None], len(thresholds), axis=2)
    near = iou >= level.min()
    det, truth, iou = det[near], truth[near], iou[near]
    # the pairs of a detection in rising worth: the larger overlap, then the later truth
    order = np.lexsort((truth, iou, det, place[det]))
    det, truth, iou = det[order], truth[order], iou[order]
    n = len(det)
    if n == 0:
        return matched, ignored
    wide = truth_areas[truth][:, None]
    counted = ~((wide < low) | (wide > high) | crowd[truth][:, None])
    # in-range truths go before ignored ones whatever their overlap
    worth = np.arange(n)[:, None] + n * counted
    allowed = iou[:, None] >= level
    free = np.ones((len(crowd), len(ranges), len(thresholds)), dtype=bool)
    turns = place[det]
    ends = np.flatnonzero(np.append(np.diff(turns), 1)) + 1
    start = 0
    for end in ends:
        here, these = det[start:end], truth[start:end]
        can = allowed[start:end, None, :] & (free[these] | crowd[these][:, None, None])
        first = np.flatnonzero(np.append(1, np.diff(here)))
        best = np.maximum.reduceat(np.where(can, worth[start:end, :, None], -1), first, axis=0)
        hit, rows = best >= 0, here[first]
        matched[rows] = hit
        ignored[rows] = np.where(hit, best < n, ignored[rows])
        _, r_ix, t_ix = np.nonzero(hit)
        free[truth[best[hit] % n], r_ix, t_ix] = False
        start = end
    return matched, ignored


def coco_match_one(iou, areas, crowd, truth_areas, thresholds, ranges):
    """The same for the overlaps of one image and category; (matched, ignored) have shape (ranges, thresholds, detections)."""
    n_d, n_g = iou.shape
    det, truth = np.repeat(np.arange(n_d), n_g), np.tile(np.arange(n_g), n_d)
    both = coco_match_groups(det, truth, iou.ravel(), np.arange(n_d), areas, crowd, truth_areas, thresholds, ranges)
    return tuple(np.moveaxis(x, 0, 2) for x in both)


def coco_match_wide(
    dets: DataFrame, truths: DataFrame, image: str, cls: str, det_id: str, score: str,
    thresholds: list[float], areas: dict[str, tuple[float, float]], max_dets: int = 100,
) -> DataFrame:
    """One row per detection with tp and fp arrays over (area range, threshold), ranges outermost.

    Truth columns: truth_id, corners, area, iscrowd.
    """
    w = Window.partitionBy(image, cls).orderBy(F.col(score).desc(), det_id)
    top = dets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_dets)
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    packed = _packed_images(
        top, truths, [image, cls],
        [F.col("_r"), F.col(det_id).alias("id"), F.col(score).alias("score"), *corners],
        [F.col("truth_id").alias("id"), *corners, F.col("area").cast("double").alias("area"), F.col("iscrowd").cast("boolean").alias("crowd")],
    ).where("d_id IS NOT NULL")
    ranges, levels = list(areas.values()), [float(t) for t in thresholds]
    fields = {f.name: f.dataType.simpleString() for f in dets.schema.fields}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for run in _runs(_sizes(whole.column("d_id")) * (1 + _sizes(whole.column("g_id")))):
                batch = whole.slice(run.start, run.stop - run.start)
                n_d, n_g = _sizes(batch.column("d_id")), _sizes(batch.column("g_id"))
                d, g = _corners(batch, "d"), _corners(batch, "g")
                crowd = pc.fill_null(batch.column("g_crowd").flatten(), False).to_numpy(zero_copy_only=False).astype(bool)
                det, truth = _group_pairs(n_d, n_g)
                place = np.arange(len(d)) - np.repeat(np.cumsum(n_d) - n_d, n_d)
                size = (d[:, 2] - d[:, 0]) * (d[:, 3] - d[:, 1])
                hit, skip = coco_match_groups(
                    det, truth, _pair_iou(d[det], g[truth], crowd[truth]), place, size, crowd, _values(batch.column("g_area")), levels, ranges
                )
                group = pa.array(np.repeat(np.arange(len(n_d)), n_d))
                ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * (len(ranges) * len(levels)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(image).take(group), batch.column(cls).take(group),
                        *[batch.column(f"d_{c}").flatten() for c in ("id", "score", "_r")],
                        *[pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.int8))) for x in (hit & ~skip, ~hit & ~skip)],
                    ],
                    names=[image, cls, det_id, score, "place", "tp", "fp"],
                )

    schema = (
        f"{image} {fields[image]}, {cls} {fields[cls]}, {det_id} {fields[det_id]}, {score} {fields[score]}, place int, "
        "tp array<tinyint>, fp array<tinyint>"
    )
    return packed.mapInArrow(match, schema)


def coco_match(
    dets: DataFrame, truths: DataFrame, image: str, cls: str, det_id: str, score: str,
    thresholds: list[float], areas: dict[str, tuple[float, float]], max_dets: int = 100,
) -> DataFrame:
    """The same flags with one row per (area range, threshold, detection)."""
    wide = coco_match_wide(dets, truths, image, cls, det_id, score, thresholds, areas, max_dets)
    cells = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(float(t)).alias("threshold")) for a in areas for t in thresholds])
    rows = wide.select(image, cls, det_id, score, "place", F.explode(F.arrays_zip(cells.alias("c"), "tp", "fp")).alias("f"))
    return rows.select(image, cls, "f.c.area", "f.c.threshold", det_id, score, "place", F.col("f.tp").cast("int").alias("tp"), F.col("f.fp").cast("int").alias("fp"))


def cover_groups(det: np.ndarray, truth: np.ndarray, iou: np.ndarray, n_truths: int) -> np.ndarray:
    """Overlap of each truth when the best pair of its image is taken and removed again and again, for many images at once.

    A pair that comes first for its detection and for its truth is taken by that order whatever else is left, so all such
    pairs are taken in one round. Pairs without overlap add nothing.
    """
    got = np.zeros(n_truths)
    near = iou > 0
    det, truth, iou = det[near], truth[near], iou[near]
    # equal overlaps: the earlier truth, then the earlier detection
    order = np.lexsort((det, truth, -iou))
    det, truth, iou = det[order], truth[order], iou[order]
    while len(det):
        _, first_d, of_d = np.unique(det, return_index=True, return_inverse=True)
        _, first_t, of_t = np.unique(truth, return_index=True, return_inverse=True)
        at = np.arange(len(det))
        taken = (first_d[of_d] == at) & (first_t[of_t] == at)
        got[truth[taken]] = iou[taken]
        left = ~(taken[first_d][of_d] | taken[first_t][of_t])
        det, truth, iou = det[left], truth[left], iou[left]
    return got


def optimal_cover(
    proposals: DataFrame, truths: DataFrame, image: str, det_id: str, score: str, limits: list[int]
) -> DataFrame:
    """(limit, truth, covered overlap) with the best ``limit`` proposals of an image taking part."""
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    w = Window.partitionBy(image).orderBy(F.col(score).desc(), det_id)
    top = proposals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(limits))
    packed = _packed_images(
        top, truths, [image], [F.col("_r"), *corners], [F.col("truth_id").alias("id"), *corners]
    ).where("g_id IS NOT NULL")
    i_type, t_type = truths.schema[image].dataType.simpleString(), truths.schema["truth_id"].dataType.simpleString()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for run in _runs((1 + _sizes(whole.column("d__r"))) * _sizes(whole.column("g_id"))):
                batch = whole.slice(run.start, run.stop - run.start)
                n_d, n_g = _sizes(batch.column("d__r")), _sizes(batch.column("g_id"))
                d, g = _corners(batch, "d"), _corners(batch, "g")
                det, truth = _group_pairs(n_d, n_g)
                iou = _pair_iou(d[det], g[truth])
                place = (np.arange(len(d)) - np.repeat(np.cumsum(n_d) - n_d, n_d))[det]
                images = batch.column(image).take(pa.array(np.repeat(np.arange(len(n_g)), n_g)))
                for limit in limits:
                    near = place < limit
                    got = cover_groups(det[near], truth[near], iou[near], len(g))
                    yield pa.RecordBatch.from_arrays(
                        [images, pa.array(np.full(len(g), limit, dtype=np.int32)), batch.column("g_id").flatten(), pa.array(got)],
                        names=[image, "limit", "truth_id", "cover"],
                    )

    return packed.mapInArrow(cover, f"{image} {i_type}, limit int, truth_id {t_type}, cover double")


# Per-keypoint spreads of the 17 body points, times ten.
KEYPOINT_SPREADS = [0.26, 0.25, 0.25, 0.35, 0.35, 0.79, 0.79, 0.72, 0.72, 0.62, 0.62, 1.07, 1.07, 0.87, 0.87, 0.89, 0.89]


def keypoint_similarity(
    dx: Column, dy: Column, gx: Column, gy: Column, gv: Column, box: tuple[Column, Column, Column, Column], area: Column,
    spreads: list[float] | None = None,
) -> Column:
    """Mean exp(-d^2 / (8 s^2 area)) over the visible points of a truth given as x, y and visibility arrays.

    Without visible points the distance to the box grown by its own size counts, over all points.
    """
    var = [(2 * s / 10.0) ** 2 for s in (spreads or KEYPOINT_SPREADS)]
    x, y, w, h = box
    scale = 2 * (area + F.lit(2.220446049250313e-16))

    def gap(value: Column, low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0.0), low - value) + F.greatest(F.lit(0.0), value - high)

    # the number of points is fixed, so the sum is written out and compiled instead of looped over
    seen, to_points, to_box = F.lit(0), F.lit(0.0), F.lit(0.0)
    for i, v in enumerate(var):
        shown = F.get(gv, i) > 0
        px, py = F.get(dx, i), F.get(dy, i)
        d2 = F.pow(px - F.get(gx, i), 2) + F.pow(py - F.get(gy, i), 2)
        b2 = F.pow(gap(px, x - w, x + 2 * w), 2) + F.pow(gap(py, y - h, y + 2 * h), 2)
        seen = seen + F.when(shown, 1).otherwise(0)
        to_points = to_points + F.when(shown, F.exp(-d2 / v / scale)).otherwise(0.0)
        to_box = to_box + F.exp(-b2 / v / scale)
    return F.when(seen > 0, to_points / seen).otherwise(to_box / len(var))
