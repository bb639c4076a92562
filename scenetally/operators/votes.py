"""Crowd answers: weighted majority, agreement, causal pairs and confounder triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.operators.ordered import positions

# Weight of confidence levels 1, 2, 3 under each setting, and the agreement levels of the vote grid.
CONFIDENCE_WEIGHTS = {
    "no_cfdnce_weight": (1.0, 1.0, 1.0),
    "half_cfdnce_weight": (0.5, 0.75, 1.0),
    "full_cfdnce_weight": (1 / 3, 2 / 3, 3 / 3),
}
MIN_AGREEMENT = (0.6, 0.8, 1.0)
CAUSAL = ("x-to-y", "y-to-x")
SAME_THING = "x-is-y"
MIN_ANSWERS = 5


def pair_key(x: Column, y: Column) -> Column:
    return F.concat_ws(" // ", x, y)


def split_pair(pair: Column) -> tuple[Column, Column]:
    parts = F.split(pair, " // ")
    return parts[0], parts[1]


def votes_long(rows: DataFrame, pair: str, answers: str, confidences: str) -> DataFrame:
    """List cells to one row per answer; seq keeps the list order."""
    return rows.select(
        pair, F.posexplode(F.arrays_zip(F.col(answers).alias("a"), F.col(confidences).alias("c"))).alias("seq", "v")
    ).select(pair, "seq", F.col("v.a").alias("answer"), F.col("v.c").alias("confidence"))


def level_weight(confidence: Column, weights: tuple[float, float, float]) -> Column:
    """Weight of 'confidence_1'..'confidence_3'; a missing confidence weighs nothing."""
    w = F.lit(0.0)
    for i, value in enumerate(weights, start=1):
        w = F.when(confidence == f"confidence_{i}", F.lit(value)).otherwise(w)
    return F.coalesce(w, F.lit(0.0))


def weighted_majority(
    votes: DataFrame,
    pair: str,
    answer: str,
    confidence: str,
    seq: str,
    settings: dict[str, tuple[float, float, float]] | None = None,
) -> DataFrame:
    """Top answer per pair and weight setting; the answer seen first wins a tie.

    All settings are summed in the one pass over the votes; pairs see one row per distinct answer afterwards.
    """
    settings = settings or CONFIDENCE_WEIGHTS
    per_answer = votes.groupBy(pair, answer).agg(
        F.count("*").alias("_n"),
        F.min(seq).alias("_first"),
        *[F.sum(level_weight(F.col(confidence), w)).alias(f"_w_{name}") for name, w in settings.items()],
    )
    best = {
        name: F.max(
            # sums of thirds differ by summation order, so they are compared at 9 decimals
            F.struct(F.round(F.col(f"_w_{name}"), 9).alias("w"), (-F.col("_first")).alias("f"), F.col(answer).alias("a"))
        )
        for name in settings
    }
    top = per_answer.groupBy(pair).agg(
        F.sum("_n").alias("n_answers"), *[b.alias(f"_b_{name}") for name, b in best.items()]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("setting"),
                F.col(f"_b_{name}.a").alias("max_resp"),
                F.col(f"_b_{name}.w").alias("max_resp_count"),
                F.round(F.col(f"_b_{name}.w") / F.col("n_answers"), 9).alias("max_resp_fraction"),
            )
            for name in settings
        ]
    )
    return top.select(pair, "n_answers", F.explode(entries).alias("e")).select(pair, "n_answers", "e.*")


def agreement_filter(majority: DataFrame, min_agreement: float | Column, min_answers: int = MIN_ANSWERS) -> DataFrame:
    return majority.where(
        (F.col("max_resp_fraction") >= min_agreement)
        & (F.col("max_resp") != SAME_THING)
        & (F.col("n_answers") >= min_answers)
    )


def vote_grid(majority: DataFrame, levels: tuple[float, ...] = MIN_AGREEMENT) -> DataFrame:
    """All agreement levels at once: every majority row is kept for each level it reaches."""
    reached = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: F.col("max_resp_fraction") >= v)
    kept = agreement_filter(majority, 0.0)
    return kept.select("*", F.explode(reached).alias("min_agreement"))


def cause_effect(majority: DataFrame, pair: str, keep: list[str] = ()) -> DataFrame:
    """(cause, effect) of the pairs answered with a direction."""
    x, y = split_pair(F.col(pair))
    forward = F.col("max_resp") == CAUSAL[0]
    return majority.where(F.col("max_resp").isin(*CAUSAL)).select(
        *keep, pair, F.when(forward, x).otherwise(y).alias("cause"), F.when(forward, y).otherwise(x).alias("effect")
    )


def effects_per_cause(pairs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Effects of every cause, in word order."""
    return pairs.groupBy(*keep, "cause").agg(F.array_sort(F.collect_list("effect")).alias("effects"))


def confounder_triples(pairs: DataFrame, order: str, keep: list[str] = ()) -> DataFrame:
    """Two effects of one cause, earlier pair first: 'e1 <- c -> e2' written with arrows.

    Effects are words of the closed class list, so a cause meets at most that many.
    """
    a = pairs.select(*keep, "cause", F.col("effect").alias("e1"), F.col(order).alias("_o1"))
    b = pairs.select(*keep, "cause", F.col("effect").alias("e2"), F.col(order).alias("_o2"))
    both = a.join(b, [*keep, "cause"]).where("_o1 < _o2")
    text = F.concat(F.col("e1"), F.lit("⬅"), F.col("cause"), F.lit("➡"), F.col("e2"))
    return both.select(*keep, "cause", "e1", "e2", text.alias("triple"))


def pair_triangles(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Word triples all of whose three pairs are listed (a < b < c)."""
    edges = pairs.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where("lo < hi").distinct()
    ab = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    bc = edges.select(F.col("lo").alias("b"), F.col("hi").alias("c"))
    ac = edges.select(F.col("lo").alias("a"), F.col("hi").alias("c"))
    return ab.join(bc, "b").join(ac, ["a", "c"], "left_semi").select("a", "b", "c")


def known_labels(labels: DataFrame, x: str, y: str, response: str, compat: bool = False) -> DataFrame:
    """Both orientations of each labelled pair as (effect, candidate, label).

    The OR condition of a lookup by effect becomes a union, so the later join is an equi-join. With ``compat`` a
    'y-to-x' candidate stays an 'effect' (only x-to-y causes count).
    """
    r = F.col(response)
    if compat:
        cause_if_y = F.lit(False)
    else:
        cause_if_y = r == "y-to-x"

    def label(is_cause: Column) -> Column:
        return F.when(is_cause, "cause").when(r == "z-to-xy", "mere_correlate").otherwise("effect")

    candidate_x = labels.select(F.col(y).alias("effect"), F.col(x).alias("candidate"), label(r == "x-to-y").alias("label"))
    candidate_y = labels.where(F.col(x) != F.col(y)).select(
        F.col(x).alias("effect"), F.col(y).alias("candidate"), label(cause_if_y).alias("label")
    )
    return candidate_x.unionByName(candidate_y)


def gather_assignments(votes: DataFrame, pair: str, order: list[str], fields: list[str]) -> DataFrame:
    """Answers per pair in submission order, one row each with its 1-based position, so no list grows with the answers."""
    return positions(votes, [pair], order, "position").select(pair, "position", *fields)


def submissions_by_hour(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(
        F.date_format(at, "yyyy-MM-dd").alias("day"), F.hour(at).alias("hour")
    ).agg(F.count("*").alias("n"))


def worker_share(df: DataFrame, worker: str) -> DataFrame:
    total = df.agg(F.count("*").alias("t"))
    per = df.groupBy(worker).agg(F.count("*").alias("n"))
    return per.select(worker, "n", (F.col("n") * 100.0 / total.scalar()).alias("percent"))


def remaining_assignments(wanted: DataFrame, done: DataFrame, pair: str, maximum: str) -> DataFrame:
    counts = done.groupBy(pair).agg(F.count("*").alias("n_done"))
    return wanted.join(counts, pair, "left").select(
        pair, F.greatest(F.col(maximum) - F.coalesce("n_done", F.lit(0)), F.lit(0)).alias("remaining")
    )


def split_by_answers(df: DataFrame, n_answers: str, needed: int = MIN_ANSWERS) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete) pairs."""
    full = F.coalesce(F.col(n_answers), F.lit(0)) >= needed
    return df.where(full), df.where(~full)


def picked_member(df: DataFrame, group: str, member: str, seed: int) -> DataFrame:
    """One member per group chosen by hash; a running minimum, so nothing is collected."""
    from scenetally.functions.hashing import hash_number

    return df.groupBy(group).agg(F.min(F.struct(hash_number(seed, group, member).alias("h"), F.col(member).alias("m"))).alias("_p")).select(
        group, F.col("_p.m").alias(member)
    )


def picked_with_url(df: DataFrame, group: str, member: str, urls: DataFrame, url: str, seed: int) -> DataFrame:
    """One member per group with its address; a member without one keeps a null."""
    return picked_member(df, group, member, seed).join(urls.select(member, url), member, "left").select(group, member, url)
