"""Readers of run results, training logs and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetally.operators.ordered import positions


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): block and line give the order inside a file, however the reader splits it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


ORDER = ["block", "line"]


def run_results(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """(run, metric, value) from result files under <run>/...: kind 'csv' or 'json' (one object of numbers)."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    if kind == "csv":
        wide = spark.read.csv(pattern, header=True).withColumn("run", run)
        names = [c for c in wide.columns if c != "run"]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).try_cast("double").alias("value")) for c in names])
        return wide.select("run", F.explode(pairs).alias("m")).select("run", "m.*").where("value IS NOT NULL")
    if kind == "json":
        raw = spark.read.text(pattern, wholetext=True).withColumn("run", run)
        return raw.select("run", F.explode(F.from_json("value", "map<string, double>")).alias("metric", "value"))
    raise ValueError(f"unknown result kind {kind!r}")


def nested_results(cells: DataFrame, run: str, cell: str) -> DataFrame:
    """(run, metric, value) from a JSON list of objects kept inside a table cell."""
    parsed = F.from_json(cell, "array<map<string, map<string, double>>>")
    outer = cells.select(run, F.explode(parsed).alias("o")).select(run, F.explode("o").alias("part", "m"))
    return outer.select(run, "part", F.explode("m").alias("metric", "value")).select(
        run, F.concat_ws(" ", "part", "metric").alias("metric"), "value"
    )


def run_log(lines: DataFrame) -> dict[str, DataFrame]:
    """World size per file, checkpoint lines and validation scores of log lines."""
    world = F.regexp_extract("value", r"'--world_size', '([0-9]+)'", 1)
    worlds = lines.where(world != "").groupBy("file").agg(F.min_by(world.cast("int"), F.struct(*ORDER)).alias("world"))
    saved = F.regexp_extract("value", r"Saving fine - tuned model on .* in (.+?) \*\* \*\* \*", 1)
    checkpoints = positions(lines.where(saved != "").select("file", *ORDER, saved.alias("path")), ["file"], ORDER, "_pos")
    score = F.regexp_extract("value", r"Validation \[.* score ([-+0-9.eE]+)", 1)
    scores = lines.where(score != "").select("file", *ORDER, score.try_cast("double").alias("score"))
    return {
        "worlds": worlds,
        "checkpoints": checkpoints.select("file", (F.col("_pos") - 1).alias("checkpoint"), "path"),
        "scores": scores.join(worlds, "file"),
    }


def result_log(lines: DataFrame) -> DataFrame:
    """Training and inference seconds per step and peak memory, each from its last line."""
    train = F.regexp_extract("value", r"Overall training.*\(([0-9.]+)", 1)
    infer = F.regexp_extract("value", r"Total inference pure.*\(([0-9.]+)", 1)
    memory = F.regexp_extract("value", r"max[_ ]mem: ([0-9]+)", 1)

    def last(column):
        return F.max_by(column, F.when(column != "", F.struct(*ORDER)))

    return lines.groupBy("file").agg(
        last(train).cast("double").alias("train_s_per_it"), last(infer).cast("double").alias("inference_s_per_it"), last(memory).cast("long").alias("memory_mb")
    )


def result_log_metrics(lines: DataFrame) -> DataFrame:
    """(file, task, metric, value): the last block of name and value lines of each task."""
    text = F.regexp_extract("value", r"copypaste: (.*)$", 1)
    rows = positions(lines.where(text != "").select("file", *ORDER, text.alias("t")), ["file"], ORDER, "_pos")
    task = rows.where(F.col("t").startswith("Task: ")).select("file", "_pos", F.expr("substring(t, 7)").alias("task"))
    newest = task.groupBy("file", "task").agg(F.max("_pos").alias("_pos"))
    names = newest.join(rows.select("file", (F.col("_pos") - 1).alias("_pos"), F.split("t", ",").alias("names")), ["file", "_pos"])
    both = names.join(rows.select("file", (F.col("_pos") - 2).alias("_pos"), F.split("t", ",").alias("values")), ["file", "_pos"])
    pairs = F.arrays_zip("names", "values")
    return both.select("file", "task", F.explode(pairs).alias("p")).select("file", "task", F.col("p.names").alias("metric"), F.col("p.values").cast("double").alias("value"))


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """Path of the file changed last; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, name string, iteration long, value double").json(path)
