"""Class means and priors of feature vectors, attention over a class dictionary, blocked similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetally.functions import arrays
from scenetally.session import pin


def class_mean_vector(df: DataFrame, cls: str, vector: str, part: list[str] = ()) -> DataFrame:
    """(class, n, mean array). Vector sums are combined map-side, so a hot class costs one buffer per task."""
    v = array_to_vector(F.col(vector))
    return df.groupBy(cls, *part).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(v)).alias("mean"))


def merge_class_means(parts: DataFrame, cls: str) -> DataFrame:
    """Means of partial results (class, n, mean) weighted by their counts."""
    v, w = array_to_vector(F.col("mean")), F.col("n").cast("double")
    return parts.where("n > 0").groupBy(cls).agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.mean(v, w)).alias("mean")
    )


def class_prior(df: DataFrame, cls: str) -> DataFrame:
    total = df.agg(F.count("*").alias("t"))
    per = df.groupBy(cls).agg(F.count("*").alias("n"))
    return per.select(cls, "n", (F.col("n") / total.scalar()).alias("prior"))


def dependent_prior(classes: DataFrame, conditional: DataFrame, given, n_classes: int) -> DataFrame:
    """P(class | given) over the class list normalised to 1; the constant prior when ``given`` was never seen."""
    column = conditional.where(F.col("cond") == F.lit(given)).select("item", "p")
    mass = column.agg(F.sum("p").alias("s"))
    return (
        classes.join(column, "item", "left")
        .withColumn("_mass", mass.scalar())
        .select(
            "item",
            F.when(F.coalesce("_mass", F.lit(0.0)) > 0, F.coalesce("p", F.lit(0.0)) / F.col("_mass"))
            .otherwise(F.lit(1.0 / n_classes))
            .alias("prior"),
        )
    )


def class_average_table(classes: DataFrame, scores: DataFrame, cls: str, column: str, value: str, absent=-1.0) -> DataFrame:
    """Average value per (class, column); listed classes that never occur carry ``absent``."""
    avg = scores.groupBy(cls, column).agg(F.avg(value).alias("avg_value"), F.count("*").alias("n"))
    return classes.join(avg, cls, "left").select(
        cls, column, F.coalesce("avg_value", F.lit(absent)).alias("avg_value"), F.coalesce("n", F.lit(0)).alias("n")
    )


# ---- blocked scoring ---------------------------------------------------------------------------------------------


LEFT_PARTS = 256  # parts of the left blocks at most; each right block is read once for every one of them
RIGHT_BLOCKS = 256  # right blocks that a task holds for its left ones; a row's partial result covers as many


def _block_count(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _packed(df: DataFrame, key: str, vector: str, n_blocks: int, prefix: str, extra: list[str] = ()) -> DataFrame:
    """Blocks of about ``rows`` vectors in one flat array each."""
    fields = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"), *extra)))
    packed = df.groupBy(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias(f"{prefix}_block")).agg(fields.alias("_m"))
    return packed.select(
        f"{prefix}_block",
        F.col("_m.k").alias(f"{prefix}_keys"),
        F.flatten("_m.v").alias(f"{prefix}_flat"),
        *[F.col(f"_m.{e}").alias(f"{prefix}_{e}") for e in extra],
    )


def score_grid(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str, rows: int, extra: list[str] = ()
) -> DataFrame:
    """Every block of left rows next to every block of right rows; the score matrix is never stored as rows."""
    n_left, n_right = _block_count(left, rows), _block_count(right, rows)
    a = _packed(left, left_key, vector, n_left, "l", list(extra))
    b = _packed(right, right_key, vector, n_right, "r")
    # the blocks are written once and read by the tasks that need them, for a shuffle would hold every block of one side
    # once for each block of the other; a task goes through its right blocks with one left block after the other
    salts = min(n_left, LEFT_PARTS)
    a = pin(a.withColumn("_salt", F.pmod("l_block", F.lit(salts))).repartitionByRange(salts, "_salt"))
    b = pin(b.repartitionByRange(-(-n_right // RIGHT_BLOCKS), "r_block"))
    return a.hint("shuffle_replicate_nl").crossJoin(b).drop("_salt")


def _matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)


def rank_of_target(
    queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, target: str, rows: int = 500
) -> DataFrame:
    """Rank of each query's target among all items by dot product (ties by item key).

    The target's score comes from an equi-join; the grid's tasks then only count the items that beat it.
    """
    goal = items.select(F.col(item_key).alias(target), F.col(vector).alias("_goal"))
    scored = queries.join(goal, target).select(
        query_key, target, vector, F.round(arrays.dot(vector, "_goal"), 9).alias("goal_score")
    )
    grid = score_grid(scored, items, query_key, item_key, vector, rows, [target, "goal_score"])

    def count_better(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, keys, better = None, None, None
        for cell in _cells(batches):
            if cell.l_block != block:
                if block is not None:
                    yield pd.DataFrame({query_key: keys, "better": better})
                block, keys = cell.l_block, np.asarray(cell.l_keys)
                better, matrix = np.zeros(len(keys), dtype="int64"), _matrix(cell.l_flat, len(keys))
                targets = np.asarray(getattr(cell, "l__target"))[:, None]
                goal_scores = np.asarray(getattr(cell, "l__goal_score"))[:, None]
            items_ = np.asarray(cell.r_keys)
            scores = np.round(matrix @ _matrix(cell.r_flat, len(items_)).T, 9)
            beats = (scores > goal_scores) | ((scores == goal_scores) & (items_[None, :] < targets))
            beats &= items_[None, :] != targets
            better += beats.sum(axis=1)
        if block is not None:
            yield pd.DataFrame({query_key: keys, "better": better})

    grid = grid.withColumnsRenamed({f"l_{target}": "l__target", "l_goal_score": "l__goal_score"})
    key_type = queries.schema[query_key].dataType.simpleString()
    partial = grid.select("l_block", "l_keys", "l_flat", "l__target", "l__goal_score", "r_keys", "r_flat").mapInPandas(
        count_better, f"{query_key} {key_type}, better long"
    )
    return partial.groupBy(query_key).agg((F.sum("better") + 1).alias("rank"))


def top_matches(
    queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, k: int, rows: int = 500
) -> DataFrame:
    """Best k items per query by dot product; a task of the grid gives its own best k only."""
    grid = score_grid(queries, items, query_key, item_key, vector, rows)
    q_type = queries.schema[query_key].dataType.simpleString()
    i_type = items.schema[item_key].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None

        def told() -> pd.DataFrame:
            width = top_scores.shape[1]
            return pd.DataFrame({query_key: np.repeat(keys, width), "item": top_items.ravel(), "score": top_scores.ravel()})

        for cell in _cells(batches):
            if cell.l_block != block:
                if block is not None:
                    yield told()
                block, keys = cell.l_block, np.asarray(cell.l_keys)
                matrix, top_scores, top_items = _matrix(cell.l_flat, len(keys)), None, None
            items_ = np.asarray(cell.r_keys)
            scores = np.round(matrix @ _matrix(cell.r_flat, len(items_)).T, 9)
            if top_scores is None or top_scores.shape[1] < k:
                rows_, names = np.arange(len(keys)), np.broadcast_to(items_, scores.shape)
            else:
                # only queries with an item that may take the last place or a place before it
                rows_ = np.flatnonzero(~(scores.max(axis=1) < top_scores[:, -1]))
                names, scores = np.broadcast_to(items_, (len(rows_), len(items_))), scores[rows_]
            if top_scores is not None:
                scores, names = np.hstack([top_scores[rows_], scores]), np.hstack([top_items[rows_], names])
            order = np.lexsort((names, -scores), axis=1)[:, :k]
            scores, names = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)
            if len(rows_) == len(keys):
                top_scores, top_items = scores, names
            else:
                top_scores[rows_], top_items[rows_] = scores, names
        if block is not None:
            yield told()

    cells = grid.select("l_block", "l_keys", "l_flat", "r_keys", "r_flat").mapInPandas(
        best, f"{query_key} {q_type}, item {i_type}, score double"
    )
    # per-partition top k before the shuffle, so a query never gathers all its candidates
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), "item")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attention_over_dictionary(
    items: DataFrame, dictionary: DataFrame, item_key: str, class_key: str, vector: str, rows: int = 500
) -> DataFrame:
    """softmax(item . class / sqrt(d)) over the dictionary rows, per item."""
    grid = score_grid(items, dictionary, item_key, class_key, vector, rows)
    i_type = items.schema[item_key].dataType.simpleString()
    c_type = dictionary.schema[class_key].dataType.simpleString()

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                keys, classes = np.asarray(cell.l_keys), np.asarray(cell.r_keys)
                a, b = _matrix(cell.l_flat, len(keys)), _matrix(cell.r_flat, len(classes))
                yield pd.DataFrame(
                    {
                        item_key: np.repeat(keys, len(classes)),
                        class_key: np.tile(classes, len(keys)),
                        "logit": (a @ b.T / np.sqrt(a.shape[1])).ravel(),
                    }
                )

    raw = grid.select("l_keys", "l_flat", "r_keys", "r_flat").mapInPandas(
        logits, f"{item_key} {i_type}, {class_key} {c_type}, logit double"
    )
    # one row per item holds its scores over the class list, which is a closed list
    per = raw.groupBy(item_key).agg(F.collect_list(F.struct(class_key, "logit")).alias("_s"))
    top = F.array_max(F.transform("_s", lambda s: s["logit"]))
    mass = F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + F.exp(s["logit"] - F.col("_top")))
    per = per.withColumn("_top", top).withColumn("_mass", mass)
    return per.select(item_key, "_top", "_mass", F.explode("_s").alias("s")).select(
        item_key, F.col(f"s.{class_key}").alias(class_key), (F.exp(F.col("s.logit") - F.col("_top")) / F.col("_mass")).alias("score")
    )


def pairwise_similarity(regions: DataFrame, image: str, region: str, vector: str) -> DataFrame:
    """Cosine and L2 between the regions of one image (an image holds a bounded number of regions)."""
    lengths = regions.select(
        F.col(image), F.col(region).alias("a"), F.col(vector).alias("va"), arrays.norm(vector).alias("na")
    )
    other = lengths.withColumnsRenamed({"a": "b", "va": "vb", "na": "nb"})
    pairs = lengths.join(other, image).where("a < b")
    return pairs.select(
        image,
        "a",
        "b",
        (arrays.dot("va", "vb") / F.greatest(F.col("na") * F.col("nb"), F.lit(1e-8))).alias("cosine"),
        arrays.l2_distance("va", "vb").alias("l2"),
    )


def normalise_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """(x1/w, y1/h, x2/w, y2/h, area fraction) for an array of box structs."""
    return F.transform(
        boxes,
        lambda b: F.array(
            b["x1"] / width,
            b["y1"] / height,
            b["x2"] / width,
            b["y2"] / height,
            (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / (width * height),
        ),
    )


def global_region(features: Column, locations: Column, width: int) -> tuple[Column, Column]:
    """Mean feature and the whole-image box put in front of the regions."""
    mean = F.array(arrays.mean_vector(features, width))
    whole = F.array(F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0, 1.0)]))
    as_double = F.transform(features, lambda f: F.transform(f, lambda v: v.cast("double")))
    return F.concat(mean, as_double), F.concat(whole, locations)


def merge_region_sets(
    detected: Column, truth: Column, n_detected: Column, n_truth: Column, cap: int
) -> Column:
    """Global row as the count-weighted mean of both, then the regions of both sets, at most ``cap`` rows.

    The first entry of either array is its global row.
    """
    head = arrays.weighted_mean_vectors(detected[0], n_detected, truth[0], n_truth)
    rest = F.concat(F.slice(detected, 2, F.size(detected)), F.slice(truth, 2, F.size(truth)))
    return F.slice(F.concat(F.array(head), rest), 1, cap)
