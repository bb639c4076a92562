"""Drift-bounded clustering against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from scenetally.llm import centroids
from scenetally.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, id int, x string, cluster string, distance long"


def plain(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [x for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(cs)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *reversed(near(x))) for i, x in kept]
    return sorted(out, key=str), cs


def vectors(n, dims, seed, spots=6):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(spots)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(middle)]) for i in range(n)]
    rows += [(None, middle[0]), (7, middle[1]), (7, middle[1]), (n, [float("nan")] * dims), (n + 1, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(n + 2, None), (n + 3, [None] * dims), (n + 4, [0.5] * (dims + 1)), (n + 5, []), (n + 6, [-0.001] * dims)]
    return rows


@pytest.mark.parametrize("dims,k,rounds", [(8, 7, 5), (2, 3, 1), (4, 500, 2), (3, 1, 2)])
def test_equals_plain_rounds(spark, dims, k, rounds):
    prepare(spark)
    rows = vectors(300, dims, dims)
    df = spark.createDataFrame([(*r, 1, "x", "c", 2) for r in rows], SCHEMA).repartition(5)
    found = centroids.clustered(df, dims=dims, clusters=k, rounds=rounds)
    want, cs = plain(rows, k, rounds, dims)
    got = sorted(((r.id, r.cluster, r.distance) for r in found.assigned.collect()), key=str)
    assert got == want
    assert found.centroids.tolist() == cs
    by = {c: sum(d for _, o, d in want if o == c) for c in range(len(cs))}
    for r in centroids.report(found).collect():
        assert (r.cluster_inertia, r.inertia) == (by[r.cluster], sum(by.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_bounds_spare_most_comparisons(spark):
    rows = vectors(3000, 8, 1)
    found = centroids.clustered(spark.createDataFrame([(*r, 1, "x", "c", 2) for r in rows], SCHEMA), dims=8, clusters=6)
    assert found.scanned[0] > 3000 and sum(found.scanned[2:]) < 3000


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([(1, [1.0, 2e9], 1, "x", "c", 2)], SCHEMA)
    assert centroids.report(centroids.clustered(df.limit(0), dims=2)).count() == 0
    with pytest.raises(Exception, match="after scaling"):
        centroids.clustered(df, dims=2)


def test_gain_holds_for_every_point_of_the_sphere_and_is_below_the_drift():
    rng = np.random.default_rng(5)
    for _ in range(200):
        old, new = rng.normal(0, 50, (4, 6)), rng.normal(0, 50, (4, 6))
        new = old + (new - old) * rng.uniform(0, 0.4)
        radius = rng.uniform(0, 60, 4)
        g = centroids.gains(old, new, radius)
        for a in range(4):
            way = rng.normal(size=(400, 6))
            x = old[a] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[a] * rng.uniform(0.9, 1, (400, 1))
            for j in range(4):
                real = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert real.max() <= g[a, j] <= np.linalg.norm(new[j] - old[j]) + 1e-5
