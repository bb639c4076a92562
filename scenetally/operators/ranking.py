"""Average precision, its random expectation, retrieval and choice metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.functions.hashing import hash_number
from scenetally.operators.ordered import running

EULER_GAMMA = 0.5772156649015329


def average_precision(df: DataFrame, query: list[str], score: str, item: str, positive: str) -> DataFrame:
    """Mean over the positives of the precision at their rank, ranked by falling score then item."""
    ranked = running(
        df.withColumn("_hit", F.col(positive).cast("long")),
        query,
        [f"-{score}", item],
        {"_pos": ("count", None), "_hits": ("sum", "_hit")},
    )
    return ranked.groupBy(*query).agg(
        F.count("*").alias("n_items"),
        F.sum("_hit").alias("n_positive"),
        F.avg(F.when(F.col("_hit") == 1, F.col("_hits") / F.col("_pos"))).alias("ap"),
    )


def listed_average_precision(df: DataFrame, query: list[str], score: str, item: str, positive: str) -> DataFrame:
    """The same for queries whose items come from a closed list: each list is ranked inside its row."""
    entry = F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"), F.col(positive).alias("hit"))
    lists = df.groupBy(*query).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    places = F.filter(F.transform("_l", lambda e, i: F.when(e["hit"], i + 1).otherwise(0)), lambda p: p > 0)
    placed = lists.select(*query, F.size("_l").cast("long").alias("n_items"), places.alias("_p"))
    total = F.aggregate(F.transform("_p", lambda p, j: (j + 1) / p), F.lit(0.0), lambda acc, v: acc + v)
    return placed.select(
        *query, "n_items", F.size("_p").cast("long").alias("n_positive"), F.try_divide(total, F.size("_p")).alias("ap")
    )


def shuffled_average_precision(df: DataFrame, query: list[str], item: str, positive: str, seed: int) -> DataFrame:
    """AP of a random order fixed by the seed."""
    mixed = df.withColumn("_mix", hash_number(seed, *query, item))
    return average_precision(mixed, query, "_mix", item, positive)


def harmonic(n: Column) -> Column:
    """H(n): summed up to 512, then ln n + gamma + 1/2n - 1/12n^2 + 1/120n^4 (error below 1e-17)."""
    x = n.cast("double")
    summed = F.aggregate(
        F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(512)).cast("int")),
        F.lit(0.0),
        lambda acc, k: acc + 1.0 / k,
    )
    tail = F.ln(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 512, summed).otherwise(tail)


def expected_random_ap(n: Column, r: Column) -> Column:
    """Expected AP of a random order of n items, r of them positive.

    The hits X among the first m items are hypergeometric, and the sum over m of E[X^2] / m^2, divided by r, has the
    closed form below, so neither a table nor a double loop is needed.
    """
    nd, rd = n.cast("double"), r.cast("double")
    spread = F.coalesce(F.try_divide((nd - rd) * (harmonic(n) - 1), nd * (nd - 1)), F.lit(0.0))
    return F.when((r >= 1) & (n >= r), spread + rd / nd)


def cause_ranking(scores: DataFrame, labels: DataFrame, item: str, effect: str, candidate: str, score: str, seed: int) -> DataFrame:
    """AP of the causes per scored item against chance; items without a known cause drop out."""
    known = scores.join(
        labels.select(F.col("effect").alias(effect), F.col("candidate").alias(candidate), "label"), [effect, candidate]
    ).withColumn("is_cause", F.col("label") == "cause")
    # candidates are classes, so an item has at most the class list of them
    ap = listed_average_precision(known, [item, effect], score, candidate, "is_cause")
    mixed = listed_average_precision(
        known.withColumn("_mix", hash_number(seed, item, effect, candidate)), [item, effect], "_mix", candidate, "is_cause"
    )
    return (
        ap.where("n_positive > 0")
        .join(mixed.select(item, effect, F.col("ap").alias("ap_shuffled")), [item, effect])
        .withColumn("ap_expected", expected_random_ap(F.col("n_items"), F.col("n_positive")))
    )


def class_then_macro(df: DataFrame, cls: str, values: list[str]) -> DataFrame:
    """Mean per class with its count, and the mean over classes (class NULL) in the same table."""
    per = df.groupBy(cls).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    macro = per.agg(F.sum("n").alias("n"), *[F.avg(v).alias(v) for v in values])
    return per.unionByName(macro.withColumn(cls, F.lit(None).cast(df.schema[cls].dataType)))


def retrieval_recall(ranks: DataFrame, rank: str, ks: tuple[int, ...] = (1, 5, 10), unranked: int = 1000) -> DataFrame:
    """R@k in percent, floor(median)+1 and mean+1 of the 0-based rank; a missing rank counts as ``unranked``."""
    zero = F.coalesce(F.col(rank) - 1, F.lit(unranked)).cast("long")
    counts = ranks.groupBy(zero.alias("_z")).agg(F.count("*").alias("_n"))
    # the middle by a running count of the ranks: no buffer holds all of them
    upto = running(counts, [], ["_z"], {"_upto": ("sum", "_n")})
    placed = upto.withColumn("_all", upto.agg(F.max("_upto").alias("m")).scalar())
    z, n = F.col("_z"), F.coalesce(F.sum("_n"), F.lit(0))
    low, high = F.min(F.when(2 * F.col("_upto") >= F.col("_all"), z)), F.min(F.when(2 * F.col("_upto") > F.col("_all"), z))
    return placed.agg(
        *[F.try_divide(F.sum(F.when(z < k, F.col("_n")).otherwise(0)) * 100.0, n).alias(f"r{k}") for k in ks],
        (F.floor((low + high) / 2) + 1).alias("median_rank"),
        (F.try_divide(F.sum(z * F.col("_n")), n) + 1).alias("mean_rank"),
        n.alias("n"),
    )


def soft_answer_score(agreeing: Column) -> Column:
    """0, .3, .6, .9 for 0 to 3 agreeing annotators, 1 beyond."""
    return (
        F.when(agreeing <= 0, 0.0).when(agreeing == 1, 0.3).when(agreeing == 2, 0.6).when(agreeing == 3, 0.9).otherwise(1.0)
    )


def answer_scores(answers: DataFrame, question: str, answer: str) -> DataFrame:
    return answers.groupBy(question, answer).agg(F.count("*").alias("n")).withColumn("score", soft_answer_score(F.col("n")))


def vqa_accuracy(predictions: DataFrame, scores: DataFrame, question: str, answer: str) -> DataFrame:
    """Mean soft score of the predicted answers; an answer nobody gave scores 0."""
    joined = predictions.join(scores.select(question, answer, "score"), [question, answer], "left")
    return joined.agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("accuracy"))


def best_choice(scores: DataFrame, question: list[str], choice: str, score: str) -> DataFrame:
    """Choice of the highest score, the lowest choice on a tie."""
    return scores.groupBy(*question).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c"))).alias("_b")).select(
        *question, (-F.col("_b.c")).alias(choice), F.col("_b.s").alias(score)
    )


def joint_accuracy(first: DataFrame, second: DataFrame, key: str, hit: str) -> DataFrame:
    """Accuracy of two tables of hits and of both at once, over the items in both."""
    both = first.select(key, F.col(hit).cast("int").alias("a")).join(
        second.select(key, F.col(hit).cast("int").alias("b")), key
    )
    return both.agg(
        F.count("*").alias("n"),
        F.avg("a").alias("first"),
        F.avg("b").alias("second"),
        F.avg(F.col("a") * F.col("b")).alias("joint"),
    )


def top_k_labels(df: DataFrame, key: str, label: str, score: str, k: int = 8) -> DataFrame:
    """Best k labels per key; bounded per key and per task."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(label))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def validation_average(df: DataFrame, task: str, loss: str, score: str, items: str) -> DataFrame:
    """Loss per step and score per item of each task, plus the mean score over tasks (task NULL)."""
    per = df.groupBy(task).agg(
        (F.sum(loss) / F.count("*")).alias("loss"), F.try_divide(F.sum(score), F.sum(items)).alias("score")
    )
    mean = per.agg(F.avg("loss").alias("loss"), F.avg("score").alias("score"))
    return per.unionByName(mean.withColumn(task, F.lit(None).cast(df.schema[task].dataType)))
