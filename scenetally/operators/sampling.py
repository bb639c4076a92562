"""Sampling, masking and mixing, fixed by a seed and row keys rather than by partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetally.functions.arrays import let
from scenetally.functions.hashing import hash_number, hash_pick, hash_unit
from scenetally.operators.ordered import positions


def _other_place(pos: Column, count: Column, seed: int, key: str, tag: str) -> Column:
    """1-based place of another row, never the row's own (of one row only, the row itself)."""
    return F.pmod(pos + hash_pick(F.greatest(count - 1, F.lit(1)), seed, F.lit(tag), key), count) + 1


def mismatch_captions(df: DataFrame, key: str, caption: str, seed: int, share: float = 0.5) -> DataFrame:
    """A share of the records gets another record's caption and label 1."""
    # only keys are placed and drawn; the captions are shuffled once, to the rows that take them
    placed = positions(df.select(key), [], [key], "_pos")
    flip = hash_unit(seed, F.lit("coin"), key) < share
    wanted = placed.withColumn("_n", df.agg(F.count("*").alias("n")).scalar()).withColumn("label", flip.cast("int"))
    drawn = wanted.where("label = 1").select(
        key, "label", _other_place(F.col("_pos"), F.col("_n"), seed, key, "pick").alias("_take")
    )
    donors = placed.select(F.col("_pos").alias("_take"), F.col(key).alias("_from"))
    takes = drawn.join(donors, "_take").select(key, "label", "_from").unionByName(
        wanted.where("label = 0").select(key, "label", F.col(key).alias("_from"))
    )
    out = takes.join(df.select(F.col(key).alias("_from"), caption), "_from")
    rest = [c for c in df.columns if c not in (key, caption)]
    if rest:
        out = out.join(df.select(key, *rest), key)
    return out.select(*df.columns, "label")


def mask_tokens(
    tokens: Column, key: str, seed: int, vocabulary: Column, counted: Column | None = None, rate: float = 0.15, mask: str = "[MASK]"
) -> Column:
    """Struct array (token, label, causal) per position.

    Of the chosen positions 80 % become the mask, 10 % a vocabulary word, 10 % stay. label is the true token where a
    position was chosen; causal is the true token where it is a counted word and still in place. ``vocabulary`` and
    ``counted`` are arrays of closed word lists.
    """

    def outcome(t: Column, i: Column, coin: Column) -> Column:
        chosen, part = coin < rate, coin / rate
        drawn = hash_pick(F.size(vocabulary), seed, F.lit("word"), F.col(key), i).cast("int")
        out = F.when(~chosen, t).when(part < 0.8, F.lit(mask)).when(part < 0.9, F.get(vocabulary, drawn)).otherwise(t)
        is_counted = F.lit(True) if counted is None else F.array_contains(counted, t)
        in_place = ~chosen | (part >= 0.9)
        return F.struct(
            out.alias("token"), F.when(chosen, t).alias("label"), F.when(in_place & is_counted, t).alias("causal")
        )

    def at(t: Column, i: Column) -> Column:
        return let(hash_unit(seed, F.lit("mask"), F.col(key), i), lambda coin: outcome(t, i, coin))

    return F.transform(tokens, at)


def mask_regions(features: Column, key: str, seed: int, rate: float = 0.15, zero_share: float = 0.9) -> Column:
    """Struct array (feature, label, causal): chosen regions are zeroed nine times in ten; -1 marks 'no label'."""

    def at(f: Column, i: Column) -> Column:
        coin = hash_unit(seed, F.lit("region"), F.col(key), i)
        chosen = coin < rate
        zeroed = chosen & (coin / rate < zero_share)
        return F.struct(
            F.when(zeroed, F.transform(f, lambda v: v * 0)).otherwise(f).alias("feature"),
            F.when(chosen, 1).otherwise(-1).alias("label"),
            F.when(zeroed, -1).otherwise(1).alias("causal"),
        )

    return F.transform(features, at)


def negative_samples(entries: DataFrame, pool: DataFrame, key: str, image: str, caption: str, seed: int) -> DataFrame:
    """Four rows per entry: the true pair, another image's caption, another image, a caption of a hard image.

    ``pool`` gives each image its list of near images, itself first; the hard image is drawn from the second on.
    """
    images = positions(entries.select(image).distinct(), [], [image], "_pos")
    count = images.agg(F.count("*").alias("n")).scalar()
    per_image = entries.groupBy(image).agg(F.min(F.struct(hash_number(seed, F.lit("cap"), key).alias("h"), F.col(caption).alias("c"))).alias("_p"))
    captions = per_image.select(F.col(image).alias("_img"), F.col("_p.c").alias("_cap"))
    base = entries.join(images, image).withColumn("_n", count).join(pool.select(image, "pool"), image, "left")
    draws = base.select(
        key,
        image,
        caption,
        _other_place(F.col("_pos"), F.col("_n"), seed, key, "text").alias("_text_pos"),
        _other_place(F.col("_pos"), F.col("_n"), seed, key, "image").alias("_image_pos"),
        F.get("pool", (hash_pick(F.greatest(F.size("pool") - 1, F.lit(1)), seed, F.lit("hard"), key) + 1).cast("int")).alias("_hard"),
    )
    named = images.select(F.col("_pos").alias("_p"), F.col(image).alias("_img"))

    def at(place: str, out: str, frame: DataFrame) -> DataFrame:
        found = named.withColumnsRenamed({"_p": place, "_img": out})
        return frame.join(found, place)

    drawn = at("_image_pos", "_other_image", at("_text_pos", "_text_image", draws))
    drawn = drawn.join(captions.withColumnsRenamed({"_img": "_text_image", "_cap": "_text"}), "_text_image")
    drawn = drawn.join(captions.withColumnsRenamed({"_img": "_hard", "_cap": "_hard_text"}), "_hard", "left")
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), img.alias("image"), text.alias("caption"))
            for kind, img, text in (
                (0, F.col(image), F.col(caption)),
                (1, F.col(image), F.col("_text")),
                (2, F.col("_other_image"), F.col(caption)),
                (3, F.col(image), F.coalesce("_hard_text", "_text")),
            )
        ]
    )
    return drawn.select(key, F.explode(rows).alias("r")).select(key, "r.*", (F.col("r.kind") == 0).cast("int").alias("target"))


def repeat_factor_sample(df: DataFrame, key: str, factor: str, seed: int, epoch: int = 0) -> DataFrame:
    """Each row floor(factor) times, once more with the chance of the fraction."""
    whole = F.floor(factor)
    times = whole + F.when(hash_unit(seed, F.lit(epoch), key) < F.col(factor) - whole, 1).otherwise(0)
    return df.select("*", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy"))


def mixture(streams: list[tuple[DataFrame, float]], key: str, seed: int) -> DataFrame:
    """Streams thinned to the given ratios (the largest ratio is kept whole) and tagged by their number."""
    top = max(ratio for _, ratio in streams)
    parts = [
        df.where(hash_unit(seed, F.lit(i), key) < ratio / top).withColumn("source_no", F.lit(i))
        for i, (df, ratio) in enumerate(streams)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def uniform_sample(df: DataFrame, cls: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows per class; each partition keeps at most k per class before the shuffle."""
    w = Window.partitionBy(cls).orderBy("_h", key)
    drawn = df.withColumn("_h", hash_number(seed, key))
    return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_h", "_r")


def confidence_sample(
    df: DataFrame, part: str, key: str, spread: str, k: int, seed: int,
    multiplier: float | None = None, proportion: float | None = None,
) -> DataFrame:
    """k rows per part drawn evenly from its most certain rows (smallest spread).

    The pool is k * multiplier rows, or a proportion of the part but at least k. Places inside a part are exact and
    found without gathering the part.
    """
    sizes = df.groupBy(part).agg(F.count("*").alias("_n"))
    if multiplier is not None:
        pool = F.floor(F.lit(k * multiplier))
    elif proportion is not None:
        pool = F.greatest(F.floor(F.col("_n") * proportion), F.lit(k))
    else:
        pool = F.lit(k)
    best = positions(df, [part], [spread, key], "_pos").join(sizes, part).where(F.col("_pos") <= F.least(pool, F.col("_n")))
    return uniform_sample(best.drop("_n", "_pos"), part, key, k, seed)


def balanced_label_sample(
    df: DataFrame, image: str, key: str, label: str, n: int, fraction: float, seed: int, background: int = 0
) -> DataFrame:
    """Up to n labelled rows per image: positives up to the fraction, the rest background; -1 is never drawn."""
    marked = df.where(F.col(label) != -1).withColumn("_pos", (F.col(label) != background).cast("int")).withColumn("_h", hash_number(seed, key))
    w = Window.partitionBy(image, "_pos").orderBy("_h", key)
    ranked = marked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    most = int(n * fraction)
    positives = df.where((F.col(label) != -1) & (F.col(label) != background)).groupBy(image).agg(F.count("*").alias("_np"))
    taken = F.least(F.coalesce("_np", F.lit(0)), F.lit(most))
    limit = F.when(F.col("_pos") == 1, taken).otherwise(n - taken)
    return ranked.join(positives, image, "left").where(F.col("_r") <= limit).drop("_h", "_r", "_np", "_pos")


def caption_subsample(captions: Column, key: str, k: int, seed: int) -> Column:
    """k consecutive captions from a drawn start, or k draws with replacement where there are fewer."""
    n = F.size(captions)
    start = hash_pick(F.greatest(n - k + 1, F.lit(1)), seed, F.lit("start"), key).cast("int") + 1
    draws = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.get(captions, hash_pick(n, seed, F.lit("again"), key, i).cast("int")))
    return F.when(n >= k, F.slice(captions, start, k)).otherwise(draws)


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Permutation of an epoch as an order column; sort by it where the order itself is needed."""
    return df.withColumn("shuffle_key", hash_number(seed, F.lit(epoch), key))


def random_fallback(df: DataFrame, key: str, ok: str, seed: int) -> DataFrame:
    """Failed rows replaced by a drawn good row; origin says whose row it is."""
    good = positions(df.where(F.col(ok)).select(key), [], [key], "_pos")
    count = df.where(F.col(ok)).agg(F.count("*").alias("n")).scalar()
    payload = [c for c in df.columns if c != key]
    own = df.where(F.col(ok)).withColumn("origin", F.col(key))
    lost = df.where(~F.col(ok)).select(key).withColumn("_n", count)
    lost = lost.select(key, (hash_pick(F.col("_n"), seed, key) + 1).alias("_pos"))
    drawn = lost.join(good.withColumnRenamed(key, "origin"), "_pos").select(key, "origin")
    filled = drawn.join(df.where(F.col(ok)).withColumnRenamed(key, "origin"), "origin")
    return own.select(key, *payload, "origin").unionByName(filled.select(key, *payload, "origin"))


def epoch_replay(df: DataFrame, order: list[str], iterations: int) -> DataFrame:
    """The first ``iterations`` batches of a sampler that starts over until enough are drawn."""
    count = df.agg(F.count("*").alias("n")).scalar()
    placed = positions(df, [], order, "_pos").withColumn("_n", count)
    rounds = F.ceil(F.lit(iterations) / F.col("_n"))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)).alias("epoch"))
    return spread.withColumn("iteration", F.col("epoch") * F.col("_n") + F.col("_pos") - 1).where(
        F.col("iteration") < iterations
    ).drop("_n", "_pos")


def selected_frames(df: DataFrame, film: str, frame: str, strategy: str, k: int, seed: int = 0) -> DataFrame:
    """k frames per film: the 'first', the 'last', 'random' ones fixed by the seed, or 'all' of them.

    Frame numbers are unique in a film. Spark keeps the best k of every part before the shuffle, so a long film is no
    hot group; a film of fewer frames gives all it has.
    """
    if strategy == "all":
        return df
    orders = {"first": [F.col(frame)], "last": [F.col(frame).desc()], "random": [hash_number(seed, film, frame), F.col(frame)]}
    if strategy not in orders:
        raise ValueError(f"unknown frame strategy {strategy!r}")
    place = F.row_number().over(Window.partitionBy(film).orderBy(*orders[strategy]))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
