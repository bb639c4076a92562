"""Queries on the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetally.session import tune


class Tables:
    """Lazy readers of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


FEW_PARTS = 32


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of a few parts, dealt out to all cores before costly text work.

    A scan of ``FEW_PARTS`` parts or more is left as it is, however many cores there are: at 128 MB a part, at most 4 GB
    of text are ever shuffled here. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_PARTS) else df


START_PARTS = 192
_START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def widen(spark: SparkSession) -> SparkSession:
    """A shuffle starts in at least ``START_PARTS`` parts and the adaptive planner merges the small ones.

    So the part of one task grows with a large table only beyond that, while small shuffles end in as few as before.
    """
    given = [int(spark.conf.get(key, None) or 0) for key in ("spark.sql.shuffle.partitions", _START)]
    spark.conf.set(_START, str(max(START_PARTS, *given)))
    return spark


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(widen(tune(spark)), folder))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(column: str, digits: int = 6):
    """Rounded output column under its own name."""
    return F.round(F.col(column), digits).alias(column)
