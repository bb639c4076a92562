"""Readers of image-caption records, question sets, word lists and keyed stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

REGION_FIELDS = "image_id string, image_w string, image_h string, num_boxes string, boxes string, features string, cls_prob string"
REGION_RECORD = (
    "image_id string, height int, width int, num_boxes int, caption string, "
    "regions array<struct<x1: float, y1: float, x2: float, y2: float, feat: array<float>, cls_prob: array<float>>>"
)


def captions_tsv(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Headerless tab file of caption and URL, with the folder it belongs to."""
    return spark.read.csv(path, sep="\t", schema="caption string, url string", quote="").withColumn("folder", F.lit(folder))


def url_image_id(url: Column) -> Column:
    """Unsigned crc32 of the URL."""
    return F.crc32(url.cast("binary"))


@F.pandas_udf(ArrayType(FloatType()))
def float_blob(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


def rows_of(flat: Column, n: Column) -> Column:
    """A flat array cut into n equal rows."""
    width = F.when(n > 0, (F.size(flat) / n).cast("int")).otherwise(1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(flat, i * width + 1, width))


def region_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab rows with base64 float32 blobs to boxes, features and class probabilities per region."""
    raw = spark.read.csv(paths, sep="\t", schema=REGION_FIELDS, quote="", maxCharsPerColumn=-1)
    decoded = raw.select(
        "image_id",
        F.col("image_w").cast("int").alias("width"),
        F.col("image_h").cast("int").alias("height"),
        F.col("num_boxes").cast("int").alias("num_boxes"),
        *[float_blob(F.unbase64(c)).alias(c) for c in ("boxes", "features", "cls_prob")],
    )
    n = F.col("num_boxes")
    return decoded.select(
        "image_id", "width", "height", "num_boxes", *[rows_of(F.col(c), n).alias(c) for c in ("boxes", "features", "cls_prob")]
    )


def sharded_records(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All shards as one table; the file tells the shard."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths).withColumn("shard_file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def caption_jsonl(spark: SparkSession, path: str, id_from_stem: bool = False) -> DataFrame:
    """One caption per row; the image id is the id field or the stem of the image path."""
    raw = spark.read.schema("id long, img_path string, sentences array<string>").json(path)
    stem = F.split(F.element_at(F.split("img_path", "/"), -1), r"\.")[0].cast("long")
    image = stem if id_from_stem else F.col("id")
    return raw.select(image.alias("image_id"), F.posexplode("sentences").alias("caption_no", "caption"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(
        "questions array<struct<question_id: long, image_id: long, question: string>>"
    ).json(path, multiLine=True)
    return raw.select(F.inline("questions"))


def question_answers(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions with their targets; a question without one fails the read instead of shifting the rest."""
    joined = questions.join(targets.withColumn("_hit", F.lit(True)), ["question_id", "image_id"], "left")
    checked = F.when(F.col("_hit"), F.col("question_id")).otherwise(
        F.raise_error(F.concat(F.lit("question without target: "), F.col("question_id").cast("string")))
    )
    return joined.withColumn("question_id", checked).drop("_hit")


VCR = (
    "img_id string, annot_id string, question array<string>, answer_choices array<array<string>>, answer_label int, "
    "rationale_choices array<array<string>>, rationale_label int"
)


def vcr_questions(spark: SparkSession, path: str, mode: str, test: bool = False) -> DataFrame:
    """mode 'answer': question to answers. mode 'rationale': question [SEP] answer to rationales.

    The test set has no label, so the second mode gives one row per possible answer.
    """
    raw = spark.read.schema(VCR).json(path)
    if mode == "answer":
        return raw.select("img_id", "annot_id", "question", F.col("answer_choices").alias("answers"), F.col("answer_label").alias("target"))

    def asked(answer: Column) -> Column:
        return F.concat(F.col("question"), F.array(F.lit("[SEP]")), answer)

    if not test:
        return raw.select(
            "img_id", "annot_id", asked(F.get("answer_choices", F.col("answer_label"))).alias("question"),
            F.col("rationale_choices").alias("answers"), F.col("rationale_label").alias("target"),
        )
    spread = raw.select("*", F.posexplode("answer_choices").alias("choice", "_answer"))
    return spread.select(
        "img_id", F.concat_ws("-", "annot_id", "choice").alias("annot_id"), asked(F.col("_answer")).alias("question"),
        F.col("rationale_choices").alias("answers"), F.lit(None).cast("int").alias("target"),
    )


def proposals_into_images(proposals: DataFrame, images: DataFrame, image_key: str, image: str) -> DataFrame:
    """Proposals of the listed images only; ids meet as text, as files carry them either way."""
    p = proposals.withColumn(image, F.col(image_key).cast("string"))
    return p.join(images.select(F.col(image).cast("string").alias(image)).distinct(), image, "left_semi")


def proposal_records(proposals: DataFrame, images: DataFrame, image_key: str, image: str, box: list[str], logit: str) -> DataFrame:
    """Each listed image with the boxes and logits of its proposals, best first (ties by box); empty lists where it has none."""
    entry = F.struct((-F.col(logit)).alias("order"), F.array(*box).alias("box"), F.col(logit).alias("logit"))
    kept = proposals_into_images(proposals, images, image_key, image)
    per = kept.groupBy(image).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    joined = images.select(F.col(image).cast("string").alias(image)).distinct().join(per, image, "left")
    listed = F.coalesce("_e", F.array().cast(per.schema["_e"].dataType.simpleString()))
    return joined.select(image, listed["box"].alias("proposal_boxes"), listed["logit"].alias("proposal_logits"))


def word_list(spark: SparkSession, path: str, background: str | None = None) -> DataFrame:
    """One class per line, commas list synonyms of the same id; a background name takes id 0.

    Ids follow the line order of one small file read in one piece.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    kept = lines.where(F.trim("line") != "")
    first = 0 if background is None else 1
    rows = kept.select((F.col("i") + first).alias("word_id"), F.posexplode(F.split("line", ",")).alias("synonym", "word"))
    rows = rows.select(F.lower(F.trim("word")).alias("word"), "word_id", "synonym")
    if background is not None:
        head = spark.range(1).select(F.lit(background).alias("word"), F.lit(0).alias("word_id"), F.lit(0).alias("synonym"))
        rows = head.unionByName(rows)
    return rows


def literal_list(text: Column) -> Column:
    """A list written as a Python literal to array<string>; apostrophes inside words survive, None is null."""
    marked = F.regexp_replace(text, r"(?<=\w)'(?=\w)", "\u0001")
    quoted = F.replace(F.replace(marked, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null"))
    return F.from_json(F.replace(quoted, F.lit("\u0001"), F.lit("'")), "array<string>")


def crowd_responses(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """Tab file whose first column is the pair and whose listed columns hold Python list literals."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    raw = raw.withColumnRenamed(raw.columns[0], "pair")
    return raw.withColumns({c: literal_list(F.col(c)) for c in lists})


def register(spark: SparkSession, name: str, df: DataFrame, **properties: str) -> None:
    """Name a data set in the session; its properties can be read back with ``properties_of``."""
    meta = {k: str(v) for k, v in properties.items()}
    head, *rest = df.columns
    df.select(F.col(head).alias(head, metadata={"dataset": meta}), *rest).createOrReplaceTempView(name)


def properties_of(spark: SparkSession, name: str) -> dict[str, str]:
    return dict(spark.table(name).schema.fields[0].metadata.get("dataset", {}))
