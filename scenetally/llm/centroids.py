"""Centroid clustering whose bounds are loosened by geometric drift.

Vectors become integers and centroids stay integers (floored means), so every decision is exact. A vector carries its
cluster, an upper bound on the distance to its centroid and one lower bound on the distance to every other centroid.
When centroids move, all vectors of a cluster lie in a sphere around its old centroid. How much nearer a moved centroid
can get to any point of that sphere is a problem in the plane through the sphere's centre and the line of the move: along
that line the gain is the cosine of the angle under which the point is seen, and the largest cosine over the sphere
follows from the angle to its centre and the angle the sphere fills. The gain summed over pieces of the way is at most
the full drift, mostly far less, and below zero where the centroid moves away. Lower bounds are loosened by it instead of
the drift. A vector whose bounds still part stays; the others are compared with all centroids exactly.

State is a table in the shared folder that each round writes anew (the one before is deleted), so a lost executor costs
the round's tasks only. What reaches the driver is bounded by clusters times components.

Defined results: vectors that are null, have another number of components, or a null, NaN or infinite component are left
out; an id that is null counts as the empty string in the starting order; rows of one id are vectors of their own, in the
starting order by id hash, then components; ties go to the smaller cluster; an empty cluster keeps its centroid; fewer
vectors than clusters give fewer clusters; an empty table gives no rows; other columns are ignored. A component beyond
``LARGEST`` after scaling has no distance in 64 bits and is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import batch_of, discard, frugal, keep_at

LARGEST = 1 << 26
PIECES = 16
SLACK = 1e-9  # of bounds kept in floating point


class Clustering(NamedTuple):
    """assigned: (id, cluster, distance) in the shared folder; centroids: integers, a row for each cluster."""

    assigned: DataFrame
    centroids: np.ndarray
    scanned: list[int]  # vectors compared with all centroids, by round


def scaled(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, x) of the vectors that count: components as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall(v, lambda x: F.abs(x) * scale <= LARGEST)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    wrong = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<int>")
    return df.where((F.size(v) == dims) & usable).select(F.col(id_col).alias("id"), F.when(fits, whole).otherwise(wrong).alias("x"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; sums may wrap on the way, the results fit."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bound of each vector, by comparison with all centroids."""
    d = squared(x, centroids)
    best, row = d.argmin(1), np.arange(len(x))
    upper = np.sqrt(d[row, best].astype(float)) * (1 + SLACK)
    d[row, best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float)) * (1 - SLACK) if len(centroids) > 1 else np.full(len(x), np.inf)
    return best, upper, lower


def gains(old: np.ndarray, new: np.ndarray, radius: np.ndarray, pieces: int = PIECES) -> np.ndarray:
    """[a, j]: no point within radius[a] of old[a] gets nearer to centroid j by more than this as it moves."""
    old, move = old.astype(float), (new - old).astype(float)
    length = np.sqrt((move * move).sum(1))
    out = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(length):
        to = old - old[j]
        along = to @ (move[j] / length[j])
        aside = np.sqrt(np.maximum((to * to).sum(1) - along * along, 0))
        for p in range(pieces):  # the angle only opens on the way, so the start of a piece bounds the piece
            ahead = along - length[j] * p / pieces
            far = np.hypot(ahead, aside)
            outside = far > radius
            half = np.arcsin(np.where(outside, radius, 0) / np.where(outside, far, 1))
            cosine = np.cos(np.maximum(np.arctan2(aside, ahead) - half, 0))
            out[:, j] += np.where(outside, cosine, 1) * length[j] / pieces
        out[:, j] += SLACK * (1 + length[j] + np.sqrt((to * to).sum(1)) + radius)
    return out


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster adds to upper bounds and takes from lower bounds."""
    move = (new - old).astype(float)
    own = np.sqrt((move * move).sum(1)) * (1 + SLACK)
    g = gains(old, new, radius)
    np.fill_diagonal(g, -np.inf)
    return own, g.max(1) if len(old) > 1 else np.zeros(1)


def reassigned(x, cluster, upper, lower, centroids, own, others):
    """New cluster and bounds, and the number of vectors that were compared with all centroids."""
    cluster = cluster.astype(np.int64)
    upper = (upper + own[cluster]) * (1 + SLACK)
    lower = np.where(np.isinf(lower), lower, lower - others[cluster] - SLACK * (1 + np.abs(np.where(np.isinf(lower), 0, lower))))
    at = np.flatnonzero(upper >= lower)
    gap = x[at] - centroids[cluster[at]]
    upper[at] = np.sqrt((gap * gap).sum(1).astype(float)) * (1 + SLACK)
    at = at[upper[at] >= lower[at]]
    if len(at):
        cluster[at], upper[at], lower[at] = nearest(x[at], centroids)
    return cluster, upper, lower, len(at)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moments(state: DataFrame, k: int, dims: int):
    """Component sums, rows and radius of each cluster; exact, from one partial sum a task."""
    schema = T.StructType(
        [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("radius", T.DoubleType()),
            T.StructField("totals", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n, radius = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k)
        for b in batches:
            x, cluster = _matrix(b.column(0), dims), b.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            if len(order):
                which, first = np.unique(cluster[order], return_index=True)
                totals[which] += np.add.reduceat(x[order], first)
                n += np.bincount(cluster, minlength=k)
                np.maximum.at(radius, cluster, b.column(2).to_numpy())
        used = np.flatnonzero(n)
        if len(used):
            yield batch_of(schema, [used, n[used], radius[used], totals[used].tolist()])

    parts = state.select("x", "cluster", "upper").mapInArrow(frugal(run), schema)
    places = parts.select("cluster", "n", "radius", F.posexplode("totals").alias("place", "total"))
    rows = places.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius")
    )
    sums, count, radius = np.zeros((k, dims), dtype=object), [0] * k, np.zeros(k)
    for r in rows.collect():
        sums[r.cluster, r.place], count[r.cluster], radius[r.cluster] = int(r.total), r.n, r.radius
    return sums, count, radius


def clustered(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    clusters: int = 40,
    rounds: int = 5,
    scale: int = 256,
    seed: int = 2,
) -> Clustering:
    """Rounds of assignment and update, then one more assignment."""
    spark = df.sparkSession
    kept = scaled(df, id_col, vector_col, dims, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select("x", hashed.alias("hash")).orderBy("hash", "x").limit(clusters).collect()
    centroids = np.array([r.x for r in first], dtype=np.int64).reshape(-1, dims)
    k = len(centroids)
    id_field = T.StructField("id", kept.schema["id"].dataType)
    assigned = T.StructType([id_field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not k:
        return Clustering(spark.createDataFrame([], assigned), centroids, [])
    carried = T.StructType(
        [
            id_field,
            T.StructField("x", T.ArrayType(T.IntegerType())),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("upper", T.DoubleType()),
            T.StructField("lower", T.DoubleType()),
        ]
    )
    scanned = []
    state, folder, shift = None, None, None
    for round_ in range(rounds + 1):
        count = spark.sparkContext.accumulator(0)  # a figure for reports only

        def step(batches, last=round_ == rounds, centroids=centroids, shift=shift, count=count):
            for b in batches:
                x = _matrix(b.column(1), dims)
                if shift is None:
                    cluster, upper, lower = nearest(x, centroids)
                    n = len(x)
                else:
                    bounds = [b.column(i).to_numpy() for i in (2, 3, 4)]
                    cluster, upper, lower, n = reassigned(x, *bounds, centroids, *shift)
                count.add(n)
                if last:
                    gap = x - centroids[cluster]
                    yield batch_of(assigned, [b.column(0), cluster.astype(np.int32), (gap * gap).sum(1)])
                else:
                    yield batch_of(carried, [b.column(0), b.column(1), cluster.astype(np.int32), upper, lower])

        made = (kept if state is None else state).mapInArrow(frugal(step), assigned if round_ == rounds else carried)
        before = folder
        state, folder = keep_at(made)
        if before:
            discard(spark, before)
        scanned.append(count.value)
        if round_ < rounds:
            sums, n, radius = _moments(state, k, dims)
            moved = centroids.copy()
            for c in range(k):
                if n[c]:
                    moved[c] = [int(s) // n[c] for s in sums[c]]
            shift, centroids = loosened(centroids, moved, radius), moved
    return Clustering(state, centroids, scanned)


def report(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """Every vector with its cluster, the sums of its cluster and of all, and the digest of its centroid."""
    k = len(found.centroids)
    sums = {r.cluster: int(r.s) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]

    def of_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values or [None]]), F.col("cluster") + 1)

    return found.assigned.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of_cluster([sums.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )
