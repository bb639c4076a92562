"""Sinks: sharded records, tab files, annotation exports, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetally.functions.boxes import Box
from scenetally.operators.ordered import positions


def sharded_write(df: DataFrame, path: str, n: int, order: list[str] | None = None) -> None:
    """n files; with an order the records of a file follow it and the files follow each other."""
    if order:
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    else:
        df.repartition(n).write.mode("overwrite").parquet(path)


def tsv_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, lineSep="\r\n")


def matrix_write(pairs: DataFrame, path: str) -> None:
    """A pair matrix in long form."""
    pairs.write.mode("overwrite").parquet(path)


def coco_rows(records: DataFrame, image: str, annotations: str) -> DataFrame:
    """Annotation rows with ids from 1, boxes as rounded x, y, w, h, areas and keypoints moved by -0.5.

    Annotation structs have category, corners, iscrowd and optionally keypoints and polygon_area.
    """
    rows = records.select(image, F.posexplode(annotations).alias("_i", "a"))
    names = records.schema[annotations].dataType.elementType.names
    x, y, w, h = Box.field(F.col("a")).to_xywh()
    area = Box.field(F.col("a")).area()
    if "polygon_area" in names:
        area = F.coalesce("a.polygon_area", area)
    out = positions(rows, [], [image, "_i"], "id").select(
        "id",
        F.col(image).alias("image_id"),
        F.col("a.category").alias("category_id"),
        F.transform(F.array(x, y, w, h), lambda v: F.round(v, 3)).alias("bbox"),
        area.alias("area"),
        F.coalesce("a.iscrowd", F.lit(0)).alias("iscrowd"),
        *(
            [F.transform("a.keypoints", lambda v, i: F.when(i % 3 == 2, v).otherwise(v - 0.5)).alias("keypoints")]
            if "keypoints" in names
            else []
        ),
    )
    return out


def coco_export(records: DataFrame, image: str, annotations: str, path: str) -> None:
    coco_rows(records, image, annotations).write.mode("overwrite").json(path)


def remaining_work(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items without a finished key."""
    return todo.join(done.select(key), key, "left_anti")


def per_class_detections(dets: DataFrame, image: str, cls: str, score: str, path: str) -> None:
    """One folder per class with lines 'image score x1 y1 x2 y2'; corners are counted from 1."""
    line = F.format_string(
        "%s %.3f %.1f %.1f %.1f %.1f", F.col(image).cast("string"), F.col(score).cast("double"),
        *[F.col(c).cast("double") + 1 for c in ("x1", "y1", "x2", "y2")],
    )
    dets.select(line.alias("value"), F.col(cls).alias("class")).write.mode("overwrite").partitionBy("class").text(path)


def predictions_json(df: DataFrame, question: str, path: str, fields: list[str]) -> None:
    df.select(F.col(question).alias("question_id"), *fields).write.mode("overwrite").json(path)


def top_predictions_json(df: DataFrame, question: str, answer: str, score: str, path: str, k: int = 8) -> None:
    """One JSON line per question: its k answers of largest score in order, with their softmax share over all its answers."""
    peak = df.groupBy(question).agg(F.max(score).alias("_top"))
    weighed = df.join(peak, question).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    whole = weighed.groupBy(question).agg(F.sum("_e").alias("_sum"))
    order = Window.partitionBy(question).orderBy(F.desc(score), answer)
    best = weighed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).join(whole, question)
    entry = F.struct(F.col("_r").alias("rank"), F.col(answer).alias("answer"), (F.col("_e") / F.col("_sum")).alias("probability"))
    lines = best.groupBy(F.col(question).alias("question_id")).agg(F.array_sort(F.collect_list(entry)).alias("answers"))
    lines.write.mode("overwrite").json(path)


def caption_references(df: DataFrame, image: str, split: str, sentences: str) -> DataFrame:
    """Non-training images: one row per sentence, tokens joined by a space, running id."""
    rows = df.where(F.col(split) != "train").select(image, F.posexplode(sentences).alias("_i", "_tokens"))
    placed = positions(rows, [], [image, "_i"], "_pos")
    return placed.select((F.col("_pos") - 1).alias("id"), F.col(image).alias("image_id"), F.array_join("_tokens", " ").alias("caption"))
