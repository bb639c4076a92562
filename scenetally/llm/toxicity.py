"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present-or-absent: single words, pairs of neighbours, and pairs with one or two words between them, hashed
to ``2**BITS`` places. Per-coordinate learning rates and the L1 term leave a sparse table of weights, which is what is
broadcast; it can't exceed ``2**BITS`` entries of 12 bytes. Training takes a sample of labelled rows whose size is
bounded by ``train_rows`` (by a hash of the id, the same on every run) and by ``TRAIN_BYTES`` of features (in the order of
their hash, which Spark sorts); features are built in Spark, the bounded sample is fitted in one task, so an executor's
loss only repeats that task. Scoring reads every whole text and shuffles none.

Defined results: null or empty text has only the bias; a label that is null is no label; repeated labelled rows count
each; without a row of either class every score is 0.5 (no evidence); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import ALNUM, LOWER, Words, batch_of, chosen, frugal, ngrams, pieces, texts

BITS = 20
TRAIN_ROWS = 20_000
TRAIN_BYTES = 128 << 20
SHAPES = ((0,), (0, 1), (0, 2), (0, 3))


def held_out(id_col: str) -> Column:
    """Rows that may not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(docs: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature places of each text."""
    words = Words([d.translate(LOWER) for d in docs], ALNUM)
    h = words.hashes()
    out = []
    places = []
    for k, shape in enumerate(SHAPES):
        places.append((ngrams(h, shape, salt=k + 1) >> np.uint64(64 - BITS)).astype(np.int32))
    for d in range(len(docs)):
        a, b = words.first[d], words.first[d + 1]
        parts = [p[a : max(a, b - shape[-1])] for p, shape in zip(places, SHAPES)]
        out.append(np.unique(np.concatenate(parts)))
    return out


def ftrl(
    rows: list[tuple[np.ndarray, int]],
    size: int,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.005,
    epochs: int = 4,
) -> tuple[np.ndarray, float]:
    """Weights and bias. The bias is a coordinate without L1."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    def bias() -> float:
        return -z[size] / ((beta + np.sqrt(n[size])) / alpha)

    for _ in range(epochs):
        for at, label in rows:
            w, b = weight(at), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            for place, old in ((at, w), (size, b)):
                root = np.sqrt(n[place])
                n[place] += g * g
                z[place] += g - (np.sqrt(n[place]) - root) / alpha * old
    return weight(np.arange(size)), bias()


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the non-zero weights, learned from at most about ``train_rows`` rows outside the fold."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")
    )
    usable = usable.where(chosen(F.xxhash64("_id", F.lit(11)), train_rows, usable.count()))
    joined = usable.join(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "_id")
    made = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_ = texts(b.column(1))
            at = [f.tobytes() for i, j in pieces(docs_) for f in features(docs_[i:j])]
            yield batch_of(made, [b.column(0), at])

    weights = T.StructType(
        [T.StructField("place", T.IntegerType()), T.StructField("weight", T.DoubleType())]
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, used = [], 0
        for b in batches:
            for label, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if used + len(at) <= TRAIN_BYTES:
                    rows.append((np.frombuffer(at, dtype=np.int32), label))
                    used += len(at)
        if len({label for _, label in rows}) == 2:
            w, bias = ftrl(rows, 1 << BITS)
            used = np.flatnonzero(w)
            yield batch_of(weights, [np.append(used, -1).astype(np.int32), np.append(w[used], bias)])

    built = joined.select("_label", "_text").mapInArrow(frugal(build), made)
    # an order of no meaning, the same on every run
    ordered = built.repartition(1).sortWithinPartitions(F.xxhash64("at"), "at", "label")
    rows = ordered.mapInArrow(frugal(fit), weights).collect()
    table = {r.place: r.weight for r in rows}
    bias = table.pop(-1, 0.0)
    return np.array(list(table), dtype=np.int32), np.array(list(table.values())), bias


def _scorer(shared, at_text: int, schema: T.StructType, keep_columns: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = shared.value
        table = np.zeros(1 << BITS)
        table[at] = weight
        used = table != 0
        for b in batches:
            every = texts(b.column(at_text))
            sums = np.zeros(len(every))
            for i, j in pieces(every):
                words = Words([d.translate(LOWER) for d in every[i:j]], ALNUM)
                h = words.hashes()
                owner = np.repeat(np.arange(j - i), words.counts)
                seen = []
                for k, shape in enumerate(SHAPES):
                    place = (ngrams(h, shape, salt=k + 1) >> np.uint64(64 - BITS)).astype(np.int64)
                    whole = used[place] & (owner[: len(place)] == owner[shape[-1] :])
                    seen.append(owner[: len(place)][whole] << BITS | place[whole])
                pair = np.unique(np.concatenate(seen))  # each feature once a text
                np.add.at(sums, i + (pair >> BITS), table[pair & ((1 << BITS) - 1)])
            scores = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))
            yield batch_of(schema, [*[b.column(k) for k in keep_columns], pa.array(scores)])

    return run


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "score",
) -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(out, T.DoubleType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(frugal(_scorer(shared, 1, schema, [0])), schema)


def with_score(docs: DataFrame, model, out: str = "score", text_col: str = "text") -> DataFrame:
    """All columns and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    every = list(range(len(docs.columns)))
    return docs.mapInArrow(frugal(_scorer(shared, docs.columns.index(text_col), schema, every)), schema)
