"""Box, matching and detection queries on order lines seen as boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.functions.boxes import Box, aspect_bucket
from scenetally.operators import detection as de
from scenetally.operators import matching as ma
from scenetally.operators.ranking import best_choice
from scenetally.plans.registry import Tables, query, r
from scenetally.plans.views import DETECTIONS, det_and_truth, detections, iou_sql

D = DETECTIONS.rstrip(",")
PLAIN = "d.x1, d.y1, d.x2, d.y2"


@query(
    "box_geometry",
    f"""WITH {D} SELECT det_id, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, (x2 - x1 + 1) * (y2 - y1 + 1) AS pixel_area,
    (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, least(greatest(x2 * 1.5, 0), 120) - least(greatest(x1 * 1.5, 0), 120) AS clipped_w,
    x1 >= 0 AND y1 >= 0 AND x2 < 120 AND y2 < 60 AS inside, x2 - x1 >= 60 AND y2 - y1 >= 40 AS large,
    (CASE WHEN (y2 - y1) / (x2 - x1) >= 0.5 THEN 1 ELSE 0 END + CASE WHEN (y2 - y1) / (x2 - x1) >= 1 THEN 1 ELSE 0 END)::INT AS bucket FROM boxes""",
)
def _(t):
    b = Box.of()
    clipped = b.scaled(1.5, 1.0).clipped(F.lit(120.0), F.lit(60.0))
    x, y, w, h = b.to_xywh()
    return detections(t).select(
        "det_id", w.alias("w"), h.alias("h"), b.area().alias("area"), b.area(1.0).alias("pixel_area"),
        b.centre()[0].alias("cx"), b.centre()[1].alias("cy"), (clipped.x2 - clipped.x1).alias("clipped_w"),
        b.inside(F.lit(120.0), F.lit(60.0)).alias("inside"), b.sides_at_least(60.0, height=40.0).alias("large"), aspect_bucket(h, w, [0.5, 1.0]).alias("bucket"),
    )


@query(
    "rotated_box_bounds",
    f"""WITH {D}, c AS (SELECT det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, radians(x1) AS a FROM boxes)
    SELECT det_id, round(cx - (abs(cos(a)) * w + abs(sin(a)) * h) / 2, 6) AS x1, round(cy + (abs(cos(a)) * h + abs(sin(a)) * w) / 2, 6) AS y2 FROM c""",
)
def _(t):
    b = Box.of()
    x, y, w, h = b.to_xywh()
    cx, cy = b.centre()
    around = Box.from_rotated(cx, cy, w, h, F.col("x1"))
    return detections(t).select("det_id", F.round(around.x1, 6).alias("x1"), F.round(around.y2, 6).alias("y2"))


PAIRS = f"""{D}, pairs AS (SELECT d.image_id, d.category, d.det_id, d.score, g.det_id AS truth_id, {iou_sql('d', 'g', '1')} AS iou
  FROM dets d JOIN truths g ON d.image_id = g.image_id AND d.category = g.category)"""


@query("detection_truth_overlap", f"WITH {PAIRS} SELECT det_id, truth_id, round(iou, 8) AS iou FROM pairs")
def _(t):
    dets, truths = det_and_truth(t)
    return ma.overlaps(dets, truths, ["image_id", "category"], "det_id", "truth_id", 1.0).select("det_id", "truth_id", r("iou", 8))


NMS = f"""RECURSIVE {D}, arr AS (SELECT image_id, category, list(struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, score := score) ORDER BY score DESC, det_id) AS bs FROM boxes GROUP BY ALL),
st AS (SELECT image_id, category, bs, 1 AS i, bs[1:1] AS kept FROM arr UNION ALL
  SELECT image_id, category, bs, i + 1, CASE WHEN len(list_filter(kept, lambda k : {iou_sql('k', 'bs[i + 1]', '0')} > 0.3)) > 0 THEN kept ELSE list_append(kept, bs[i + 1]) END FROM st WHERE i < len(bs)),
nms AS (SELECT image_id, category, unnest(kept) AS k FROM st WHERE i = len(bs))"""


@query("class_nms", f"WITH {NMS} SELECT image_id, category, k.det_id AS det_id, k.score AS score FROM nms")
def _(t):
    kept = ma.class_nms(detections(t), "image_id", "category", "det_id", "score", 0.3)
    return kept.select("image_id", "category", "det_id", "score")


@query(
    "select_boxes",
    f"""WITH {NMS}, s AS (SELECT image_id, k.det_id AS det_id, k.score AS conf, count(*) FILTER (k.score >= 0.5) OVER (PARTITION BY image_id) AS n,
    row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, k.det_id) AS rank FROM nms)
    SELECT image_id, det_id, conf, rank::INT AS rank FROM s WHERE rank <= least(greatest(n, 2), 4)""",
)
def _(t):
    boxes = detections(t)
    return ma.select_boxes(boxes, "image_id", "det_id", "category", "score", 0.5, 2, 4, background=None)


ALL_CLASSES = NMS.replace(
    "arr AS",
    """sc AS (SELECT image_id, det_id, x1, y1, x2, y2, (CASE category WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + shift) % 3 AS category, score * share AS score
  FROM boxes, (VALUES (0, 1.0::DOUBLE), (1, 0.6::DOUBLE), (2, 0.3::DOUBLE)) AS v(shift, share)), arr AS""",
).replace("FROM boxes GROUP BY ALL", "FROM sc GROUP BY ALL")


@query(
    "select_boxes_all_classes",
    f"""WITH {ALL_CLASSES}, best AS (SELECT image_id, k.det_id AS det_id, max(k.score) AS c FROM nms GROUP BY ALL),
    ev AS (SELECT DISTINCT b.image_id, b.det_id, coalesce(c, 0) AS conf FROM boxes b LEFT JOIN best ON b.image_id = best.image_id AND b.det_id = best.det_id),
    s AS (SELECT *, count(*) FILTER (conf >= 0.5) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rank FROM ev)
    SELECT image_id, det_id, round(conf, 6) AS conf, rank::INT AS rank FROM s WHERE rank <= least(greatest(n, 2), 4)""",
)
def _(t):
    """Every box scored under all three categories: its own in full, the next ones at falling shares."""
    # an image is placed once, before its boxes are copied
    boxes = detections(t).repartition("image_id")
    own = F.when(F.col("category") == "A", 0).when(F.col("category") == "N", 1).otherwise(2)
    shares = F.array(*[F.struct(F.lit(i).alias("shift"), F.lit(v).alias("share")) for i, v in enumerate((1.0, 0.6, 0.3))])
    scored = boxes.select("image_id", "det_id", *ma.CORNERS, "score", own.alias("own"), F.explode(shares).alias("s"))
    scored = scored.withColumn("cls", F.pmod(F.col("own") + F.col("s.shift"), F.lit(3))).withColumn("score", F.col("score") * F.col("s.share"))
    out = ma.select_boxes_all_classes(scored, "image_id", "det_id", "cls", "score", 0.5, 2, 4, background=None)
    return out.select("image_id", "det_id", r("conf"), "rank")


MATCH = PAIRS + """,
best AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, truth_id) AS rn FROM pairs),
lv AS (SELECT unnest([{levels}]) AS threshold),
m AS (SELECT d.image_id, d.category, d.det_id, d.score, threshold, b.truth_id, coalesce(b.iou > threshold, false) AS hit
  FROM dets d CROSS JOIN lv LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON d.det_id = b.det_id),
t1 AS (SELECT *, row_number() OVER (PARTITION BY threshold, hit, truth_id ORDER BY score DESC, det_id) AS turn FROM m),
flags AS (SELECT image_id, category, det_id, score, threshold, (hit AND turn = 1)::INT AS tp, (NOT (hit AND turn = 1))::INT AS fp FROM t1),
np AS (SELECT category, count(*) AS n_pos FROM truths GROUP BY 1),
cum AS (SELECT *, row_number() OVER w AS pos, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM flags WINDOW w AS (PARTITION BY category, threshold ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT cum.*, n_pos, ct / (ct + cf) AS precision, ct / n_pos AS recall FROM cum JOIN np USING (category)),
curve AS (SELECT *, max(precision) OVER (PARTITION BY category, threshold ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM pr),
aps AS (SELECT category, threshold, coalesce(sum(envelope) FILTER (tp = 1), 0) / any_value(n_pos) AS ap, any_value(n_pos) AS n_pos FROM curve GROUP BY ALL)"""

ONE = MATCH.replace("{levels}", "0.5::DOUBLE")
TEN = MATCH.replace("{levels}", ", ".join(f"{v}::DOUBLE" for v in de.IOU_LEVELS))


def flags(t: Tables, levels: list[float]) -> tuple[DataFrame, DataFrame]:
    dets, truths = det_and_truth(t)
    return ma.voc_match(dets, truths, "image_id", "category", "det_id", "truth_id", "score", levels), truths


def curves(t: Tables, levels: list[float]) -> DataFrame:
    f, truths = flags(t, levels)
    keys = ["category", "threshold"]
    return de.precision_recall(f, keys, ["-score", "det_id"], de.count_positives(truths, ["category"]), ["category"])


@query("voc_truth_match", f"WITH {ONE} SELECT category, det_id, tp, fp FROM flags")
def _(t):
    return flags(t, [0.5])[0].select("category", "det_id", "tp", "fp")


@query(
    "precision_recall_curve",
    f"WITH {ONE} SELECT category, det_id, round(precision, 12) AS precision, round(recall, 12) AS recall, round(envelope, 12) AS envelope FROM curve",
)
def _(t):
    return curves(t, [0.5]).select("category", "det_id", r("precision", 12), r("recall", 12), r("envelope", 12))


@query("voc_ap_area", f"WITH {ONE} SELECT category, round(ap, 6) AS ap, n_pos FROM aps")
def _(t):
    return de.average_precision_area(curves(t, [0.5]), ["category"]).select("category", r("ap"), "n_pos")


@query(
    "voc_ap_11_point",
    f"""WITH {ONE}, lvl AS (SELECT unnest(list_transform(range(11), lambda i : 0.1::DOUBLE * i)) AS t),
    b AS (SELECT category, t, coalesce(max(precision) FILTER (recall >= t), 0) AS p FROM curve, lvl GROUP BY ALL)
    SELECT category, round(sum(p) / 11, 6) AS ap FROM b GROUP BY 1""",
)
def _(t):
    return de.average_precision_11(curves(t, [0.5]), ["category"]).select("category", r("ap"))


@query(
    "voc_map",
    f"""WITH {TEN}, p AS (SELECT threshold, avg(ap) AS m FROM aps GROUP BY 1)
    SELECT round(avg(m) * 100, 6) AS "AP", round(max(m) FILTER (threshold = 0.5) * 100, 6) AS "AP50", round(max(m) FILTER (threshold = 0.75) * 100, 6) AS "AP75" FROM p""",
)
def _(t):
    dets, truths = det_and_truth(t)
    wide = ma.voc_match_wide(dets, truths, "image_id", "category", "det_id", "truth_id", "score", de.IOU_LEVELS)
    aps = de.wide_area_ap(wide, "category", ["-score", "det_id"], de.IOU_LEVELS, de.count_positives(truths, ["category"]))
    return de.voc_map(aps).select(r("AP"), r("AP50"), r("AP75"))


@query(
    "class_thresholds",
    f"""WITH {ONE}, f AS (SELECT category, score, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN precision + recall > 0 THEN precision * recall / (precision + recall) ELSE 0 END DESC, pos) AS rn FROM curve)
    SELECT category, score AS threshold FROM f WHERE rn = 1""",
)
def _(t):
    return de.class_thresholds(curves(t, [0.5]), "category", "score")


@query(
    "weighted_map",
    f"WITH {ONE} SELECT round(avg(ap), 6) AS mean_ap, round(sum(ap * n_pos) / sum(n_pos), 6) AS weighted_ap FROM aps",
)
def _(t):
    return de.weighted_map(de.average_precision_area(curves(t, [0.5]), ["category"])).select(r("mean_ap"), r("weighted_ap"))


def coco_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    dets, truths = det_and_truth(t)
    area = Box.of().area()
    # a tenth of the truths, those of full discount, count as crowds
    return dets, truths.withColumn("area", area).withColumn("iscrowd", F.col("y1") >= 29)


# the greedy match, a detection of every image, category, area range and level at a time: in-range truths go first, then the
# larger overlap, then the later truth; crowds can be taken again
COCO = f"""RECURSIVE {D},
bx AS MATERIALIZED (SELECT image_id, det_id, ascii(category) AS category, ascii(side) AS side, x1, y1, x2, y2, score, (x2 - x1) * (y2 - y1) AS size FROM boxes),
cells AS (SELECT row_number() OVER () AS cell, * FROM (VALUES {", ".join(f"({k}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for k, (lo, hi) in enumerate(de.AREAS.values(), 1))}) AS v(area, lo, hi),
  (SELECT unnest([{", ".join(f"{x!r}::DOUBLE" for x in de.IOU_LEVELS)}]) AS threshold)),
groups AS (SELECT image_id, category, row_number() OVER () AS gid FROM (SELECT DISTINCT image_id, category FROM bx WHERE side = ascii('O'))),
tr AS (SELECT *, y1 >= 29 AS crowd, row_number() OVER (ORDER BY det_id) AS truth_no FROM bx WHERE side = ascii('F')),
dp AS (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, det_id) AS place FROM bx WHERE side = ascii('O')),
dc AS (SELECT gid, place, any_value(d.size) AS size, list(struct_pack(id := g.truth_no, size := g.size, crowd := g.crowd,
    iou := CASE WHEN g.crowd THEN greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) / d.size ELSE {iou_sql('d', 'g', '0')} END))
    FILTER (g.truth_no IS NOT NULL) AS c
  FROM dp d JOIN groups USING (image_id, category) LEFT JOIN tr g ON d.image_id = g.image_id AND d.category = g.category WHERE place <= 100 GROUP BY 1, 2),
walk AS (
  SELECT gid, cell, lo, hi, threshold, 0::BIGINT AS place, []::BIGINT[] AS taken, false AS hit, false AS skip FROM groups, cells
  UNION ALL
  SELECT gid, cell, lo, hi, threshold, place, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.id) END, b IS NOT NULL,
    CASE WHEN b IS NULL THEN size < lo OR size > hi ELSE NOT b.counts END
  FROM (SELECT w.gid, w.cell, w.lo, w.hi, w.threshold, d.place, w.taken, d.size,
      list_sort([struct_pack(counts := NOT (x.crowd OR x.size < w.lo OR x.size > w.hi), iou := x.iou, id := x.id) FOR x IN coalesce(d.c, [])
        IF x.iou >= least(w.threshold, 1 - 1e-10) AND (x.crowd OR NOT list_contains(w.taken, x.id))], 'DESC')[1] AS b
    FROM walk w JOIN dc d ON d.gid = w.gid AND d.place = w.place + 1)),
flags AS MATERIALIZED (SELECT image_id, category, area, w.threshold, det_id, score, place, (hit AND NOT skip)::INT AS tp, (NOT hit AND NOT skip)::INT AS fp
  FROM walk w JOIN groups USING (gid) JOIN cells USING (cell) JOIN dp USING (image_id, category, place))"""

COCO_AP = f"""{COCO}, npos AS (SELECT category, c.area, c.threshold, count(*) FILTER (NOT crowd AND size >= lo AND size <= hi) AS n_pos FROM tr, cells c GROUP BY ALL),
cum AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM flags WINDOW w AS (PARTITION BY category, area, threshold ORDER BY score DESC, image_id, place ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, max(CASE WHEN ct + cf > 0 THEN ct / (ct + cf) ELSE 0 END) OVER (PARTITION BY category, area, threshold ORDER BY score DESC, image_id, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM cum),
tps AS (SELECT category, area, threshold, n_pos, ct, e FROM env JOIN npos USING (category, area, threshold) WHERE tp = 1 AND n_pos > 0),
tops AS (SELECT category, area, threshold, max(e) AS top, max(ct) AS found, sum(tp) FILTER (place <= 1) AS found_1, sum(tp) FILTER (place <= 10) AS found_10 FROM env GROUP BY ALL),
read AS (SELECT category, area, threshold, sum(e * (100 * ct // n_pos - 100 * (ct - 1) // n_pos)) AS s FROM tps GROUP BY ALL),
aps AS (SELECT category, area, threshold, n_pos, (coalesce(s, 0) + coalesce(top, 0)) / 101 AS ap, coalesce(found, 0) / n_pos AS recall,
    coalesce(found_1, 0) / n_pos AS recall_1, coalesce(found_10, 0) / n_pos AS recall_10
  FROM npos LEFT JOIN tops USING (category, area, threshold) LEFT JOIN read USING (category, area, threshold) WHERE n_pos > 0),
cat AS (SELECT category, avg(ap) * 100 AS ap FROM aps WHERE area = 1 GROUP BY 1)"""


AREA_NAME = f"{list(de.AREAS)!r}[area]"


def coco_flags(t: Tables) -> DataFrame:
    dets, truths = coco_inputs(t)
    return ma.coco_match(dets, truths, "image_id", "category", "det_id", "score", de.IOU_LEVELS, de.AREAS)


@query("coco_truth_match", f"WITH {COCO} SELECT image_id, chr(category) AS category, {AREA_NAME} AS area, threshold, det_id, tp, fp FROM flags")
def _(t):
    return coco_flags(t).select("image_id", "category", "area", "threshold", "det_id", "tp", "fp")


def coco_aps(t: Tables) -> DataFrame:
    dets, truths = coco_inputs(t)
    flags_ = ma.coco_match_wide(dets, truths, "image_id", "category", "det_id", "score", de.IOU_LEVELS, de.AREAS)
    return de.coco_ap(flags_, truths, "image_id", "category", "score", de.AREAS)


@query(
    "coco_ap",
    f"""WITH {COCO_AP} SELECT chr(category) AS category, {AREA_NAME} AS area, threshold, n_pos, round(ap, 6) AS ap, round(recall, 6) AS recall,
    round(recall_1, 6) AS recall_1, round(recall_10, 6) AS recall_10 FROM aps""",
)
def _(t):
    return coco_aps(t).select("category", "area", "threshold", "n_pos", r("ap"), r("recall"), r("recall_1"), r("recall_10"))


METRICS = {
    "AP": "avg(ap) FILTER (area = 1)", "AP50": "avg(ap) FILTER (area = 1 AND threshold = 0.5)",
    "AP75": "avg(ap) FILTER (area = 1 AND threshold = 0.75)", "APs": "avg(ap) FILTER (area = 2)",
    "APm": "avg(ap) FILTER (area = 3)", "APl": "avg(ap) FILTER (area = 4)",
    "AR1": "avg(recall_1) FILTER (area = 1)", "AR10": "avg(recall_10) FILTER (area = 1)",
    "AR": "avg(recall) FILTER (area = 1)", "ARs": "avg(recall) FILTER (area = 2)",
    "ARm": "avg(recall) FILTER (area = 3)", "ARl": "avg(recall) FILTER (area = 4)",
}


@query("coco_summary", f"WITH {COCO_AP} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(({v}) * 100, 6) AS value FROM aps" for k, v in METRICS.items()))
def _(t):
    return de.coco_summary(coco_aps(t)).select("metric", r("value"))


@query("category_ap", f"WITH {COCO_AP} SELECT chr(category) AS category, round(ap, 6) AS ap FROM cat")
def _(t):
    return de.category_ap(coco_aps(t), "category").select("category", r("ap"))


@query(
    "frequency_group_ap",
    f"""WITH {COCO_AP}, freq AS (SELECT category, count(DISTINCT image_id) AS n FROM tr GROUP BY 1),
    g AS (SELECT CASE WHEN n <= 10 THEN 'r' WHEN n <= 100 THEN 'c' ELSE 'f' END AS frequency, ap FROM freq JOIN cat USING (category))
    SELECT frequency, round(avg(ap), 6) AS ap, count(*) AS n FROM g GROUP BY 1""",
)
def _(t):
    _, truths = coco_inputs(t)
    freq = truths.groupBy("category").agg(F.count_distinct("image_id").alias("n")).select("category", de.frequency_group(F.col("n")).alias("frequency"))
    return de.frequency_group_ap(de.category_ap(coco_aps(t), "category"), freq, "category").select("frequency", r("ap"), "n")


@query("optimal_cover")
def _(t):
    dets, truths = det_and_truth(t)
    return ma.optimal_cover(dets, truths, "image_id", "det_id", "score", [2, 100]).select("image_id", "limit", "truth_id", r("cover", 8))


@query("proposal_recall")
def _(t):
    dets, truths = det_and_truth(t)
    size = Box.of().area()
    named = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in de.AREAS.items()]),
        lambda a: (size >= a["lo"]) & (size <= a["hi"]),
    )
    # the cover is found once per area range, over the truths of that range
    spread = truths.select("*", F.explode(named).alias("a")).select(
        F.concat_ws("|", "image_id", "a.n").alias("image"), F.col("a.n").alias("area"), "image_id", "truth_id", *ma.CORNERS
    )
    areas = spread.select("image", "image_id").distinct()
    proposals = dets.join(areas, "image_id").select("image", "det_id", "score", *ma.CORNERS)
    cover = ma.optimal_cover(proposals, spread.select("image", "truth_id", *ma.CORNERS), "image", "det_id", "score", [2, 100])
    out = de.average_recall(cover.withColumn("area", F.split("image", r"\|")[1]), ["area", "limit"])
    return out.select("area", "limit", r("ar"), "n_pos")


@query(
    "threshold_assignment",
    f"""WITH {D}, p AS (SELECT d.image_id, d.det_id, g.det_id AS truth_id, {iou_sql('d', 'g', '0')} AS iou FROM dets d JOIN truths g ON d.image_id = g.image_id),
    q AS (SELECT *, iou = max(iou) OVER (PARTITION BY truth_id) AS top FROM p),
    b AS (SELECT det_id, arg_min(truth_id, struct_pack(i := -iou, t := truth_id)) AS truth_id, max(iou) AS iou, bool_or(top) AS forced FROM q GROUP BY 1)
    SELECT d.image_id, d.det_id, b.truth_id, round(coalesce(iou, 0), 8) AS iou,
    CASE WHEN forced THEN 1 WHEN coalesce(iou, 0) >= 0.7 THEN 1 WHEN coalesce(iou, 0) >= 0.3 THEN -1 ELSE 0 END::INT AS label FROM dets d LEFT JOIN b USING (det_id)""",
)
def _(t):
    dets, truths = det_and_truth(t)
    out = ma.threshold_assignment(dets, truths, "image_id", "det_id", "truth_id", [0.3, 0.7], [0, -1, 1])
    return out.select("image_id", "det_id", "truth_id", r("iou", 8), "label")


VARIANCES = ", ".join(f"{(2 * s / 10.0) ** 2!r}::DOUBLE" for s in ma.KEYPOINT_SPREADS)


@query(
    "keypoint_similarity",
    f"""WITH {D}, k AS (SELECT d.det_id, g.det_id AS truth_id, d.x1 AS dx, d.y1 AS dy, d.x2 - d.x1 AS dw, d.y2 - d.y1 AS dh,
    g.x1 AS gx, g.y1 AS gy, g.x2 - g.x1 AS w, g.y2 - g.y1 AS h, unnest(range(17)) AS i FROM dets d JOIN truths g ON d.image_id = g.image_id AND d.category = g.category),
    p AS (SELECT *, i * 3 < gy AS seen, dx + dw * i / 16 AS px, dy + dh * i / 16 AS py, 2 * w * h * [{VARIANCES}][i + 1] AS v FROM k),
    e AS (SELECT det_id, truth_id, seen, exp(-((px - gx - w * i / 16) ** 2 + (py - gy - h * i / 16) ** 2) / v) AS near,
    exp(-((greatest(0, gx - w - px) + greatest(0, px - gx - 2 * w)) ** 2 + (greatest(0, gy - h - py) + greatest(0, py - gy - 2 * h)) ** 2) / v) AS outside FROM p)
    SELECT det_id, truth_id, round(coalesce(avg(near) FILTER (seen), avg(outside)), 8) AS oks FROM e GROUP BY ALL""",
)
def _(t):
    """Lines of an order as a 17-point pose: the points lie on the box diagonal, detections against truths of the image."""
    dets, truths = det_and_truth(t)

    def points(lo: str, hi: str):
        a, b = F.col(lo), F.col(hi)
        return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: a + (b - a) * i / 16.0)

    d = dets.select("image_id", "category", "det_id", points("x1", "x2").alias("dx"), points("y1", "y2").alias("dy"))
    visible = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.when(i * 3 < F.col("y1"), 2).otherwise(0))
    g = truths.select(
        "image_id", "category", "truth_id", *ma.CORNERS, points("x1", "x2").alias("gx"), points("y1", "y2").alias("gy"), visible.alias("gv")
    )
    b = Box.of()
    oks = ma.keypoint_similarity(
        F.col("dx"), F.col("dy"), F.col("gx"), F.col("gy"), F.col("gv"), b.to_xywh(), b.area()
    )
    return d.join(g, ["image_id", "category"]).select("det_id", "truth_id", F.round(oks, 8).alias("oks"))


@query(
    "grounding_accuracy",
    f"""WITH {D}, ch AS (SELECT image_id, arg_min(det_id, struct_pack(s := -score, d := det_id)) AS det_id FROM dets GROUP BY 1),
    tr AS (SELECT image_id, min(det_id) AS det_id FROM truths GROUP BY 1),
    j AS (SELECT {iou_sql('d', 'g', '1')} AS iou FROM ch JOIN dets d USING (det_id) JOIN tr ON ch.image_id = tr.image_id JOIN truths g ON g.det_id = tr.det_id)
    SELECT count(*) AS n, round(avg((iou > 0.3)::INT), 8) AS accuracy FROM j""",
)
def _(t):
    dets, truths = det_and_truth(t)
    box = F.struct("det_id", *ma.CORNERS)
    best = dets.groupBy("image_id").agg(F.min(F.struct((-F.col("score")).alias("s"), box.alias("b"))).alias("m")).select("image_id", "m.b.*")
    ref = truths.groupBy("image_id").agg(F.min(F.struct("truth_id", *ma.CORNERS)).alias("m")).select("image_id", "m.*")
    return de.grounding_accuracy(ma.overlaps(best, ref, ["image_id"], "det_id", "truth_id", 1.0), 0.3).select("n", r("accuracy", 8))


# ---- segmentation -----------------------------------------------------------------------------------------------------

CONF = """px AS (SELECT d.doc_id, l.quality * 2 + l.toxic AS truth, CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 700 THEN 3 WHEN n_chars > 300 THEN 0 ELSE 1 END AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
conf AS (SELECT pred, truth, count(*) AS n FROM px GROUP BY ALL),
ct AS (SELECT truth AS cls, sum(n) AS n_truth, coalesce(sum(n) FILTER (truth = pred), 0) AS tp FROM conf GROUP BY 1), cp AS (SELECT pred AS cls, sum(n) AS n_pred FROM conf GROUP BY 1),
sc AS (SELECT coalesce(ct.cls, cp.cls) AS cls, coalesce(n_truth, 0) AS n_truth, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM ct FULL JOIN cp ON ct.cls = cp.cls),
rs AS (SELECT *, CASE WHEN n_truth > 0 THEN tp / (n_truth + n_pred - tp) END AS iou, CASE WHEN n_truth > 0 THEN tp / n_truth END AS acc FROM sc)"""


def pixels(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    pred = F.when(n > 2000, 2).when(n > 700, 3).when(n > 300, 0).otherwise(1)
    truth = F.col("quality") * 2 + F.col("toxic")
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select("doc_id", pred.alias("pred"), truth.alias("truth"))


@query("confusion_matrix", f"WITH {CONF} SELECT pred, truth, n FROM conf")
def _(t):
    return de.confusion_matrix(pixels(t), "pred", "truth")


@query(
    "segmentation_class_scores",
    f"WITH {CONF} SELECT cls, n_truth::BIGINT AS n_truth, n_pred::BIGINT AS n_pred, tp::BIGINT AS tp, round(iou, 8) AS iou, round(acc, 8) AS acc FROM rs",
)
def _(t):
    s = de.class_scores(de.confusion_matrix(pixels(t), "pred", "truth"), "pred", "truth")
    return s.select("cls", "n_truth", "n_pred", "tp", r("iou", 8), r("acc", 8))


@query(
    "segmentation_metrics",
    f"""WITH {CONF} SELECT round(sum(iou) * 100 / count(*), 6) AS "mIoU", round(sum(iou * n_truth) * 100 / sum(n_truth), 6) AS "fwIoU",
    round(avg(acc) * 100, 6) AS "mACC", round(sum(tp) * 100.0 / sum(n_truth), 6) AS "pACC" FROM rs""",
)
def _(t):
    m = de.segmentation_metrics(de.class_scores(de.confusion_matrix(pixels(t), "pred", "truth"), "pred", "truth"))
    return m.select(r("mIoU"), r("fwIoU"), r("mACC"), r("pACC"))


@query("segment_rows", f"WITH {D} SELECT image_id, category, count(*) AS area FROM boxes GROUP BY ALL")
def _(t):
    return de.segment_rows(detections(t), "image_id", "category")


@query(
    "panoptic_quality",
    f"""WITH {ONE}, un AS (SELECT g.category, CASE WHEN b.truth_id IS NULL THEN 'fn' END AS status FROM truths g LEFT JOIN (SELECT DISTINCT truth_id FROM t1 WHERE hit) b ON g.det_id = b.truth_id),
    seg AS (SELECT f.category, CASE WHEN tp = 1 THEN 'tp' ELSE 'fp' END AS status, b.iou FROM flags f LEFT JOIN (SELECT det_id, iou FROM best WHERE rn = 1) b USING (det_id)
      UNION ALL SELECT category, status, NULL FROM un WHERE status IS NOT NULL),
    per AS (SELECT category, coalesce(sum(iou) FILTER (status = 'tp'), 0) AS s, count(*) FILTER (status = 'tp') AS tp, count(*) FILTER (status = 'fp') AS fp, count(*) FILTER (status = 'fn') AS fn FROM seg GROUP BY 1),
    rt AS (SELECT category, s / (tp + fp / 2 + fn / 2) AS pq, CASE WHEN tp > 0 THEN s / tp ELSE 0 END AS sq, tp / (tp + fp / 2 + fn / 2) AS rq FROM per),
    gr AS (SELECT 'All' AS grp, * FROM rt UNION ALL SELECT CASE WHEN category = 'A' THEN 'Things' ELSE 'Stuff' END, * FROM rt)
    SELECT grp AS "group", round(avg(pq) * 100, 6) AS "PQ", round(avg(sq) * 100, 6) AS "SQ", round(avg(rq) * 100, 6) AS "RQ", count(*) AS n FROM gr GROUP BY 1""",
)
def _(t):
    dets, truths = det_and_truth(t)
    matched = flags(t, [0.5])[0]
    pairs = ma.overlaps(dets, truths, ["image_id", "category"], "det_id", "truth_id", 1.0)
    best = ma.best_truth(pairs, ["image_id", "category"], "det_id", "truth_id").select("det_id", "iou", "truth_id")
    found = matched.join(best, "det_id", "left")
    status = F.when(F.col("tp") == 1, "tp").otherwise("fp")
    hits = found.where("tp = 1").select("truth_id")
    missed = truths.join(hits, "truth_id", "left_anti").select("category", F.lit("fn").alias("status"), F.lit(None).cast("double").alias("iou"))
    segments = found.select("category", status.alias("status"), "iou").unionByName(missed)
    out = de.panoptic_quality(segments.withColumn("isthing", F.col("category") == "A"), "category", "isthing")
    return out.select("group", r("PQ"), r("SQ"), r("RQ"), "n")
