"""Ordered scans over several slices and blocks, one group holding most rows."""

import random

from pyspark.sql import functions as F

from scenetally.operators import batching as ba
from scenetally.operators import ordered


def skewed(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 50) / 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i long, v double").repartition(6)


def by_group(rows):
    groups = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((i, v))
    return groups


def test_running_kinds(spark, many_slices):
    rows, df = skewed(spark)
    scans = {"pos": ("count", None), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "ahead": ("max_after", "v")}
    parts = ordered.sliced(df, ["g"], ["i"])
    assert parts.where("g = 'hot'").select("_slice").distinct().count() > 1
    got = {(r.g, r.i): r for r in ordered.scan_slices(parts, ["g"], ["i"], scans).collect()}
    assert len(got) == len(rows)
    for g, items in by_group(rows).items():
        values = [v for _, v in items]
        for k, (i, _) in enumerate(items):
            r = got[(g, i)]
            assert (r.pos, r.s, r.hi, r.lo) == (k + 1, sum(values[: k + 1]), max(values[: k + 1]), min(values[: k + 1]))
            assert r.ahead == max(values[k:])


def test_descending_and_null_group(spark, many_slices):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("x", i) for i in range(50)], "g string, i long")
    got = {(r.g, r.i): r.pos for r in ordered.positions(df, ["g"], ["-i"], "pos").collect()}
    assert got == {(g, i): 50 - i for g in (None, "x") for i in range(50)}


def test_global_positions(spark, many_slices):
    df = spark.range(0, 1000).repartition(7)
    got = {r.id: r.pos for r in ordered.positions(df, [], ["id"], "pos").collect()}
    assert got == {i: i + 1 for i in range(1000)}


def test_framed_blocks_agree_with_one_window(spark, many_slices):
    rows, df = skewed(spark)
    placed = ordered.positions(df, ["g"], ["i"], "pos")

    def build(spec):
        return {"prev": F.lag("v").over(spec), "m": F.sum("v").over(spec.rowsBetween(-4, 0))}

    got = {(r.g, r.i): (r.prev, r.m) for r in ordered.framed(placed, ["g"], "pos", 4, build, block_rows=7).collect()}
    assert len(got) == len(rows)
    for g, items in by_group(rows).items():
        values = [v for _, v in items]
        for k, (i, _) in enumerate(items):
            assert got[(g, i)] == (values[k - 1] if k else None, sum(values[max(0, k - 4) : k + 1]))


def test_lower_median_of_ten(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "g string, i long, v double")
    last = ba.windowed_history(df, ["g"], ["i"], "v", 20).where("i = 9").first()
    assert (last["median"], last["window_mean"], last["global_mean"]) == (4.0, 4.5, 4.5)


def batches(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.batch, {})[r.slot] = r.i
    return [[b[s] for s in sorted(b)] for _, b in sorted(out.items())]


def test_grouped_batches(spark, many_slices):
    groups = [0, 0, 1, 0, 1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame(list(enumerate(groups)), "i long, g int")
    assert batches(ba.grouped_batch(df, "g", ["i"], 3)) == [[0, 1, 3], [2, 4, 5], [6, 9], [7, 8]]
    assert batches(ba.grouped_batch(df, "g", ["i"], 3, drop_uneven=True)) == [[0, 1, 3], [2, 4, 5]]
    assert batches(ba.grouped_batch(df, "g", ["i"], 4)) == [[0, 1, 3, 6], [2, 4, 5, 7], [8], [9]]


def test_sub_sequence(spark, many_slices):
    df = spark.createDataFrame(list(enumerate("aabbbacc")), "i long, op string").withColumn("g", F.lit(1))
    got = [r["sub"] for r in ba.sub_sequence_number(df, ["g"], ["i"], ["op"]).orderBy("i").collect()]
    assert got == [0, 1, 0, 1, 2, 0, 0, 1]


def test_even_shard_of_few_rows(spark):
    df = spark.range(0, 3)
    got = ba.even_shard(df, ["id"], 8)
    assert got.count() == 8 and {r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {1}
