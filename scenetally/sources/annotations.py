"""Readers of annotation files into per-image records.

A legacy annotation file is one JSON document and cannot be split, so reading it (``json_tables``) is kept apart from the
joins that build records; at scale the three tables come from JSON lines or Parquet and only the second step is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetally.operators.ordered import positions

IMAGES = "array<struct<id: long, file_name: string, coco_url: string, height: int, width: int, neg_category_ids: array<int>, not_exhaustive_category_ids: array<int>>>"
ANNOTATIONS = (
    "array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, area: double, iscrowd: int, "
    "segmentation: array<array<double>>, keypoints: array<double>>>"
)
CATEGORIES = "array<struct<id: int, name: string, frequency: string>>"
REFS = (
    "ref_id long, ann_id long, category_id int, image_id long, split string, "
    "sentences array<struct<sent_id: long, raw: string, sent: string, tokens: array<string>>>"
)


# a large-vocabulary file has no keypoints
LVIS_ANNOTATIONS = "array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, segmentation: array<array<double>>>>"


def json_tables(spark: SparkSession, path: str, annotations: str = ANNOTATIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of annotation files."""
    raw = spark.read.schema(f"images {IMAGES}, annotations {annotations}, categories {CATEGORIES}").json(path, multiLine=True)
    return tuple(raw.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def contiguous_categories(categories: DataFrame) -> DataFrame:
    """Category ids in rising order numbered from 0."""
    return positions(categories.select("id", "name"), [], ["id"], "_pos").select("id", "name", (F.col("_pos") - 1).cast("int").alias("contiguous_id"))


def duplicate_ids(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def _check_unique(annotations: DataFrame) -> None:
    bad = duplicate_ids(annotations).take(1)
    if bad:
        raise ValueError(f"annotation id {bad[0]['id']} is not unique")


def valid_polygons(segmentation: Column) -> Column:
    """Polygons of at least three points with whole coordinate pairs."""
    return F.filter(segmentation, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


def shifted_keypoints(keypoints: Column, by: float) -> Column:
    return F.transform(keypoints, lambda v, i: F.when(i % 3 == 2, v).otherwise(v + by))


def _with_annotations(images: DataFrame, rows: DataFrame, entry: Column) -> DataFrame:
    per = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("annotations"))
    joined = images.withColumnRenamed("id", "image_id").join(per, "image_id", "left")
    element = per.schema["annotations"].dataType.simpleString()
    return joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(element)))


def coco_records(images: DataFrame, annotations: DataFrame, categories: DataFrame, check: bool = True) -> DataFrame:
    """One row per image with its annotations; instances whose polygons are all broken are dropped.

    Every image is kept, also without annotations. Boxes stay x, y, width, height; keypoints move by half a pixel.
    """
    if check:
        _check_unique(annotations)
    ids = contiguous_categories(categories).select(F.col("id").alias("category_id"), "contiguous_id")
    polygons = F.when(F.size("segmentation") > 0, valid_polygons(F.col("segmentation")))
    kept = annotations.withColumn("_p", polygons).where("_p IS NULL OR size(_p) > 0").join(ids, "category_id")
    entry = F.struct(
        F.col("id"), F.col("contiguous_id").alias("category_id"), "bbox", "iscrowd",
        F.col("_p").alias("segmentation"), shifted_keypoints(F.col("keypoints"), 0.5).alias("keypoints"),
    )
    return _with_annotations(images.select("id", "file_name", "height", "width"), kept, entry)


def lvis_records(images: DataFrame, annotations: DataFrame, root: str, check: bool = True) -> DataFrame:
    """As above with category ids moved from 1 to 0, path from the URL's last two parts, and the two category lists."""
    if check:
        # both checks in one pass over the files
        broken = (F.size(valid_polygons(F.col("segmentation"))) != F.size("segmentation")) | (F.size("segmentation") <= 0)
        per = annotations.groupBy("id").agg(F.count("*").alias("n"), F.max(F.coalesce(broken, F.lit(False))).alias("bad"))
        found = per.agg(F.count_if(F.col("n") > 1).alias("twice"), F.min(F.when(F.col("n") > 1, F.col("id"))).alias("id"), F.count_if("bad").alias("bad"), F.min(F.when(F.col("bad"), F.col("id"))).alias("bad_id")).first()
        if found["twice"]:
            raise ValueError(f"annotation id {found['id']} is not unique")
        if found["bad"]:
            raise ValueError(f"annotation {found['bad_id']} has a broken polygon")
    parts = F.split("coco_url", "/")
    path = F.concat(F.lit(root), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))
    empty = F.array().cast("array<int>")
    head = images.select(
        "id", path.alias("file_name"), "height", "width",
        F.coalesce("neg_category_ids", empty).alias("neg_category_ids"),
        F.coalesce("not_exhaustive_category_ids", empty).alias("not_exhaustive_category_ids"),
    )
    entry = F.struct("id", (F.col("category_id") - 1).alias("category_id"), "bbox", "segmentation")
    return _with_annotations(head, annotations, entry)


VOC = (
    "filename string, size struct<width: int, height: int>, "
    "object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
)


def voc_xml(spark: SparkSession, path: str, pixel_shift: float = 1.0) -> DataFrame:
    """XML annotation files, one row per object; 1-based first corners become 0-based."""
    raw = spark.read.format("xml").schema(VOC).option("rowTag", "annotation").load(path)
    stem = F.split("filename", r"\.")[0]
    rows = raw.select(stem.alias("image_id"), "size.width", "size.height", F.explode("object").alias("o"))
    return rows.select(
        "image_id", "width", "height", F.col("o.name").alias("category"), (F.coalesce("o.difficult", F.lit(0)) == 1).alias("difficult"),
        (F.col("o.bndbox.xmin") - pixel_shift).alias("x1"), (F.col("o.bndbox.ymin") - pixel_shift).alias("y1"),
        F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"),
    )


def paired_files(spark: SparkSession, images: str, labels: str, image_ext: str, label_ext: str, suffix: str = "") -> DataFrame:
    """Image and label files of the same stem; only names are listed, no content is read."""

    def listed(folder: str, ext: str, tail: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{tail}{ext}").option("recursiveFileLookup", "true").load(folder)
        name = F.element_at(F.split("path", "/"), -1)
        return files.select("path", F.substring(name, 1, F.length(name) - len(tail + ext)).alias("stem"))

    a = listed(images, image_ext, "").withColumnRenamed("path", "image_path")
    return a.join(listed(labels, label_ext, suffix).withColumnRenamed("path", "label_path"), "stem")


# The instance categories kept from polygon files.
INSTANCE_CATEGORIES = ["person", "rider", "car", "truck", "bus", "train", "motorcycle", "bicycle"]


def polygon_files(spark: SparkSession, path: str, suffix: str = "_polygons.json") -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of polygon files: ids in file-name order from 0, box and area from the polygon."""
    raw = spark.read.schema(
        "imgWidth int, imgHeight int, objects array<struct<label: string, polygon: array<array<double>>>>"
    ).json(path, multiLine=True)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    named = raw.select(F.replace(name, F.lit(suffix), F.lit("")).alias("file_name"), "imgWidth", "imgHeight", "objects")
    placed = positions(named, [], ["file_name"], "_pos").withColumn("id", F.col("_pos") - 1).drop("_pos")
    images = placed.select("id", "file_name", F.col("imgWidth").alias("width"), F.col("imgHeight").alias("height"))
    rows = placed.select(F.col("id").alias("image_id"), F.posexplode("objects").alias("_i", "o"))
    rows = rows.where(F.col("o.label").isin(INSTANCE_CATEGORIES) & (F.size("o.polygon") >= 3))
    xs, ys = F.transform("o.polygon", lambda p: p[0]), F.transform("o.polygon", lambda p: p[1])
    shaped = rows.select("image_id", "_i", F.col("o.label").alias("category"), xs.alias("xs"), ys.alias("ys"))
    x1, y1 = F.array_min("xs"), F.array_min("ys")
    cross = F.aggregate(
        F.sequence(F.lit(0), F.size("xs") - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get("xs", i) * F.get("ys", (i + 1) % F.size("xs")) - F.get("xs", (i + 1) % F.size("xs")) * F.get("ys", i),
    )
    out = positions(shaped, [], ["image_id", "_i"], "_pos").select(
        (F.col("_pos") - 1).alias("id"), "image_id", "category",
        F.array(x1, y1, F.array_max("xs") - x1, F.array_max("ys") - y1).alias("bbox"),
        (F.abs(cross) / 2).alias("area"),
        F.flatten(F.zip_with("xs", "ys", lambda x, y: F.array(x, y))).alias("segmentation"),
    )
    return images, out


def referring_tables(spark: SparkSession, refs_path: str, instances_path: str) -> dict[str, DataFrame]:
    """refs, anns, imgs, cats and sents as tables; joins take the place of the dictionary indexes."""
    refs = spark.read.schema(REFS).json(refs_path)
    images, annotations, categories = json_tables(spark, instances_path)
    sents = refs.select("ref_id", "image_id", F.explode("sentences").alias("s")).select("ref_id", "image_id", "s.*")
    return {"refs": refs.drop("sentences"), "anns": annotations, "imgs": images, "cats": categories, "sents": sents}


def select_refs(
    refs: DataFrame, images: list[int] | None = None, categories: list[int] | None = None, ids: list[int] | None = None, split: str | None = None
) -> DataFrame:
    from scenetally.operators.annotations import ref_split

    out = refs
    for column, wanted in (("image_id", images), ("category_id", categories), ("ref_id", ids)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    return out.where(ref_split("split", split)) if split else out


def select_annotations(anns: DataFrame, refs: DataFrame, images: list[int] | None = None, categories: list[int] | None = None, ref_ids: list[int] | None = None) -> DataFrame:
    """Annotations of all given images, categories and references at once."""
    out = anns
    if images:
        out = out.where(F.col("image_id").isin(images))
    if categories:
        out = out.where(F.col("category_id").isin(categories))
    if ref_ids:
        wanted = refs.where(F.col("ref_id").isin(ref_ids)).select(F.col("ann_id").alias("id"))
        out = out.join(wanted, "id", "left_semi")
    return out
