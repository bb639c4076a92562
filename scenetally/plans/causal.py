"""Vectors by class, crowd answers and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.functions import arrays
from scenetally.operators import cooccurrence as co
from scenetally.operators import ranking as ra
from scenetally.operators import vectors as ve
from scenetally.operators import votes as vt
from scenetally.plans.records import h
from scenetally.plans.registry import Tables, query, r
from scenetally.plans.views import BALLOTS, BASKETS, ballots, baskets

EMB = """e AS (SELECT vec_id, label, list_transform(embedding, lambda v : v::DOUBLE) AS v FROM embeddings),
long AS (SELECT vec_id, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e),
means AS (SELECT label, dim, avg(x) AS m FROM long GROUP BY ALL),
dict AS (SELECT label, list(m ORDER BY dim) AS mv FROM means GROUP BY 1)"""


@query(
    "class_mean_vector",
    f"WITH {EMB}, c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, dim::INT AS dim, round(m, 6) AS value FROM means JOIN c USING (label)",
)
def _(t):
    means = ve.class_mean_vector(t.embeddings, "label", "embedding")
    return means.select("label", "n", F.posexplode("mean").alias("dim", "value")).select("label", "n", "dim", r("value"))


@query(
    "merged_class_means",
    f"WITH {EMB}, c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, dim::INT AS dim, round(m, 6) AS value FROM means JOIN c USING (label)",
)
def _(t):
    # shards are counted apart, then merged by their counts
    sharded = t.embeddings.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    merged = ve.merge_class_means(ve.class_mean_vector(sharded, "label", "embedding", ["shard"]), "label")
    return merged.select("label", "n", F.posexplode("mean").alias("dim", "value")).select("label", "n", "dim", r("value"))


@query(
    "class_prior",
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS prior FROM embeddings GROUP BY label",
)
def _(t):
    return ve.class_prior(t.embeddings, "label").select("label", "n", r("prior", 8))


@query(
    "dependent_prior",
    f"""WITH {BASKETS}, sets AS (SELECT DISTINCT record, item FROM baskets),
    g AS (SELECT record FROM sets WHERE item = 'Brand#3'),
    c AS (SELECT item, count(*) AS n FROM sets SEMI JOIN g USING (record) GROUP BY item)
    SELECT b.item, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 8) AS prior FROM (SELECT DISTINCT p_brand AS item FROM part) b LEFT JOIN c USING (item)""",
)
def _(t):
    cond = co.conditional_probability(co.set_cooccurrence(baskets(t), "record", "item"))
    classes = t.part.select(F.col("p_brand").alias("item")).distinct()
    return ve.dependent_prior(classes, cond, "Brand#3", classes.count()).select("item", r("prior", 8))


ATT = f"""WITH {EMB}, logits AS (SELECT e.vec_id, e.label AS own, d.label AS cls, exp(list_dot_product(e.v, d.mv) / 8.0) AS x FROM e, dict d),
att AS (SELECT vec_id, own, cls, x / sum(x) OVER (PARTITION BY vec_id) AS score FROM logits)"""


def attention(t: Tables) -> DataFrame:
    means = ve.class_mean_vector(t.embeddings, "label", "embedding").select("label", F.col("mean").alias("embedding"))
    return ve.attention_over_dictionary(t.embeddings.select("vec_id", "embedding"), means, "vec_id", "label", "embedding")


@query("attention_over_dictionary", ATT + " SELECT vec_id, cls AS label, round(score, 6) AS score FROM att")
def _(t):
    return attention(t).select("vec_id", "label", r("score"))


@query(
    "class_attention_average",
    ATT + """, avgs AS (SELECT own, cls, avg(score) AS a, count(*) AS n FROM att GROUP BY ALL), listed AS (SELECT n_nationkey AS own FROM nation)
    SELECT own::INT AS own, cls::INT AS cls, round(coalesce(a, -1), 6) AS avg_value, coalesce(n, 0) AS n FROM listed LEFT JOIN avgs USING (own)""",
)
def _(t):
    own = t.embeddings.select("vec_id", F.col("label").alias("own"))
    scored = attention(t).withColumnRenamed("label", "cls").join(own, "vec_id")
    listed = t.nation.select(F.col("n_nationkey").alias("own"))
    return ve.class_average_table(listed, scored, "own", "cls", "score").select("own", "cls", r("avg_value"), "n")


@query(
    "pairwise_similarity",
    """WITH e AS (SELECT vec_id, vec_id // 8 AS image, list_transform(embedding, lambda v : v::DOUBLE) AS v FROM embeddings)
    SELECT a.image, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS l2
    FROM e a JOIN e b ON a.image = b.image AND a.vec_id < b.vec_id""",
)
def _(t):
    regions = t.embeddings.select(F.floor(F.col("vec_id") / 8).alias("image"), "vec_id", "embedding")
    return ve.pairwise_similarity(regions, "image", "vec_id", "embedding").select("image", "a", "b", r("cosine"), r("l2"))


@query(
    "argmax_class",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS top FROM embeddings",
)
def _(t):
    return t.embeddings.select("vec_id", arrays.argmax("embedding").alias("top"))


@query(
    "global_region",
    f"""WITH {EMB}, g AS (SELECT vec_id // 8 AS image, dim, avg(x) AS m, count(*) AS n FROM long GROUP BY ALL)
    SELECT image, dim::INT AS dim, round(m, 6) AS value, n FROM g""",
)
def _(t):
    images = t.embeddings.groupBy(F.floor(F.col("vec_id") / 8).alias("image")).agg(
        F.collect_list("embedding").alias("feats"),
        F.collect_list(F.array(*[F.lit(x) for x in (0.1, 0.1, 0.4, 0.4, 0.09)])).alias("locs"),
    )
    feats, locs = ve.global_region(F.col("feats"), F.col("locs"), 64)
    both = images.select("image", feats.alias("feats"), locs.alias("locs"))
    head = both.select("image", F.posexplode(F.col("feats")[0]).alias("dim", "value"), (F.size("locs") - 1).cast("long").alias("n"))
    return head.select("image", "dim", r("value"), "n")


# ---- crowd answers -----------------------------------------------------------------------------------------------

MAJORITY = BALLOTS + """,
w AS (SELECT pair, answer, event_id, s.setting, CASE confidence WHEN 'confidence_1' THEN s.c1 WHEN 'confidence_2' THEN s.c2 WHEN 'confidence_3' THEN s.c3 ELSE 0 END AS w
  FROM ballots, (VALUES ('no_cfdnce_weight', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('half_cfdnce_weight', 0.5, 0.75, 1.0), ('full_cfdnce_weight', 1.0::DOUBLE / 3, 2.0::DOUBLE / 3, 1.0)) s(setting, c1, c2, c3)),
pa AS (SELECT setting, pair, answer, count(*) AS n, round(sum(w), 9) AS w, min(event_id) AS f FROM w GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY setting, pair ORDER BY w DESC, f) AS rn, sum(n) OVER (PARTITION BY setting, pair)::BIGINT AS n_answers FROM pa),
maj AS (SELECT pair, n_answers, setting, answer AS max_resp, w AS max_resp_count, round(w / n_answers, 9) AS max_resp_fraction FROM rk WHERE rn = 1)"""


def majority(t: Tables) -> DataFrame:
    return vt.weighted_majority(ballots(t), "pair", "answer", "confidence", "event_id")


def cause_pairs(t: Tables) -> DataFrame:
    """Pairs with a directed plain majority of at least 30 %."""
    kept = vt.agreement_filter(majority(t).where("setting = 'no_cfdnce_weight'"), 0.3)
    return vt.cause_effect(kept, "pair")


CAUSE_PAIRS = MAJORITY + """,
cp AS (SELECT pair, CASE WHEN max_resp = 'x-to-y' THEN string_split(pair, ' // ')[1] ELSE string_split(pair, ' // ')[2] END AS cause,
  CASE WHEN max_resp = 'x-to-y' THEN string_split(pair, ' // ')[2] ELSE string_split(pair, ' // ')[1] END AS effect
  FROM maj WHERE setting = 'no_cfdnce_weight' AND max_resp_fraction >= 0.3 AND n_answers >= 5 AND max_resp IN ('x-to-y', 'y-to-x'))"""


@query("weighted_majority", f"WITH {MAJORITY} SELECT * FROM maj")
def _(t):
    return majority(t)


@query(
    "vote_grid",
    f"""WITH {MAJORITY} SELECT maj.*, lv AS min_agreement FROM maj, (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) l(lv)
    WHERE max_resp_fraction >= lv AND max_resp <> 'x-is-y' AND n_answers >= 5""",
)
def _(t):
    # levels suited to the spread of the table's answers; the published levels are the operator's default
    return vt.vote_grid(majority(t), (0.2, 0.3, 0.4))


@query("cause_effect_pairs", f"WITH {CAUSE_PAIRS} SELECT pair, cause, effect FROM cp")
def _(t):
    return cause_pairs(t)


@query(
    "effects_per_cause",
    f"WITH {CAUSE_PAIRS} SELECT cause, string_agg(effect, ',' ORDER BY effect) AS effects FROM cp GROUP BY cause",
)
def _(t):
    return vt.effects_per_cause(cause_pairs(t)).select("cause", F.array_join("effects", ",").alias("effects"))


@query(
    "confounder_triples",
    f"WITH {CAUSE_PAIRS} SELECT a.cause, a.effect AS e1, b.effect AS e2, a.effect || '⬅' || a.cause || '➡' || b.effect AS triple FROM cp a JOIN cp b ON a.cause = b.cause AND a.pair < b.pair",
)
def _(t):
    return vt.confounder_triples(cause_pairs(t), "pair")


@query(
    "pair_triangles",
    f"""WITH {BASKETS}, sets AS (SELECT DISTINCT record, item FROM baskets),
    pc AS (SELECT a.item AS lo, b.item AS hi, count(*) AS n FROM sets a JOIN sets b ON a.record = b.record AND a.item < b.item GROUP BY ALL),
    e AS (SELECT lo, hi FROM pc WHERE n > (SELECT avg(n) FROM pc))
    SELECT x.lo AS a, x.hi AS b, y.hi AS c FROM e x JOIN e y ON x.hi = y.lo JOIN e z ON z.lo = x.lo AND z.hi = y.hi""",
)
def _(t):
    pairs = co.set_cooccurrence(baskets(t), "record", "item").where("hi <> lo")
    mean = pairs.agg(F.avg("n").alias("m")).scalar()
    return vt.pair_triangles(pairs.withColumn("_m", mean).where("n > _m"), "hi", "lo")


KNOWN = MAJORITY + """,
lab AS (SELECT string_split(pair, ' // ')[1] AS x, string_split(pair, ' // ')[2] AS y, max_resp FROM maj WHERE setting = 'no_cfdnce_weight'),
known AS (SELECT y AS effect, x AS candidate, CASE WHEN max_resp = 'x-to-y' THEN 'cause' WHEN max_resp = 'z-to-xy' THEN 'mere_correlate' ELSE 'effect' END AS label FROM lab
  UNION ALL SELECT x, y, CASE WHEN max_resp = 'y-to-x' THEN 'cause' WHEN max_resp = 'z-to-xy' THEN 'mere_correlate' ELSE 'effect' END FROM lab)"""


def known(t: Tables) -> DataFrame:
    x, y = vt.split_pair(F.col("pair"))
    lab = majority(t).where("setting = 'no_cfdnce_weight'").select(x.alias("x"), y.alias("y"), "max_resp")
    return vt.known_labels(lab, "x", "y", "max_resp")


@query("known_labels", f"WITH {KNOWN} SELECT effect, candidate, label FROM known")
def _(t):
    return known(t)


CAUSE_RANKING = KNOWN + """,
sc AS (SELECT event_id, 'w' || (10 + CAST(json_extract_string(props, '$.k') AS INT) // 10) AS effect, value FROM events),
ranked AS (SELECT event_id, effect, candidate, label = 'cause' AS hit,
  row_number() OVER (PARTITION BY event_id ORDER BY (event_id * 7 + CAST(substr(candidate, 2) AS INT) * 13) % 101 DESC, candidate) AS pos FROM sc JOIN known USING (effect)),
cum AS (SELECT *, sum(hit::INT) OVER (PARTITION BY event_id ORDER BY pos) AS hits FROM ranked),
aps AS (SELECT event_id, effect, count(*) AS n_items, sum(hit::INT)::BIGINT AS n_positive, avg(hits / pos) FILTER (hit) AS ap FROM cum GROUP BY ALL),
exps AS (SELECT *, (n_items - n_positive) * (list_sum(list_transform(range(1, n_items + 1), lambda k : 1.0::DOUBLE / k)) - 1) / (n_items * (n_items - 1)) + n_positive / n_items AS ap_expected FROM aps WHERE n_positive > 0)"""


def ranking_frame(t: Tables) -> DataFrame:
    """Each event scores the candidate causes of its effect word by a fixed rule."""
    labels = known(t)
    k = F.get_json_object("props", "$.k").cast("int")
    items = t.events.select("event_id", F.concat(F.lit("w"), 10 + F.floor(k / 10)).alias("effect"))
    score = F.pmod(F.col("event_id") * 7 + F.substring("candidate", 2, 9).cast("int") * 13, F.lit(101))
    candidates = labels.select("effect", "candidate").distinct()
    scored = items.join(candidates, "effect").select("event_id", "effect", "candidate", score.alias("score"))
    return ra.cause_ranking(scored, labels, "event_id", "effect", "candidate", "score", seed=7)


@query(
    "cause_ranking_map",
    f"WITH {CAUSE_RANKING} SELECT event_id, effect, n_items, n_positive, round(ap, 8) AS ap, round(ap_expected, 8) AS ap_expected FROM exps",
)
def _(t):
    return ranking_frame(t).select("event_id", "effect", "n_items", "n_positive", r("ap", 8), r("ap_expected", 8))


@query(
    "cause_ranking_per_class",
    f"""WITH {CAUSE_RANKING}, pc AS (SELECT effect, count(*) AS n, avg(ap) AS ap, avg(ap_expected) AS ap_expected FROM exps GROUP BY 1),
    al AS (SELECT * FROM pc UNION ALL SELECT NULL, sum(n)::BIGINT, avg(ap), avg(ap_expected) FROM pc)
    SELECT effect, n, round(ap, 6) AS ap, round(ap_expected, 6) AS ap_expected, round(ap - ap_expected, 6) AS excess FROM al""",
)
def _(t):
    out = ra.class_then_macro(ranking_frame(t), "effect", ["ap", "ap_expected"])
    return out.withColumn("excess", F.col("ap") - F.col("ap_expected")).select(
        "effect", "n", r("ap"), r("ap_expected"), r("excess")
    )


@query(
    "shuffled_average_precision",
    f"""WITH {CAUSE_RANKING}, mixed AS (SELECT event_id, effect, label = 'cause' AS hit,
    row_number() OVER (PARTITION BY event_id, effect ORDER BY {h(7, "event_id", "effect", "candidate")} DESC, candidate) AS pos FROM sc JOIN known USING (effect)),
    up AS (SELECT *, sum(hit::INT) OVER (PARTITION BY event_id, effect ORDER BY pos) AS hits FROM mixed)
    SELECT event_id, effect, count(*) AS n_items, sum(hit::INT)::BIGINT AS n_positive, round(avg(hits / pos) FILTER (hit), 8) AS ap_shuffled
    FROM up GROUP BY ALL HAVING sum(hit::INT) > 0""",
)
def _(t):
    return ranking_frame(t).select("event_id", "effect", "n_items", "n_positive", r("ap_shuffled", 8))


@query(
    "assignments_per_pair",
    f"""WITH {BALLOTS} SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY ts, event_id) AS position, user_id, answer FROM ballots""",
)
def _(t):
    return vt.gather_assignments(ballots(t), "pair", ["ts", "event_id"], ["user_id", "answer"])


@query(
    "submissions_by_hour",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL",
)
def _(t):
    return vt.submissions_by_hour(t.events, "ts")


@query(
    "submission_day_display",
    """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL)
    SELECT CASE WHEN day = lag(day) OVER (ORDER BY day, hour) THEN '' ELSE day END AS shown, day, hour, n FROM c""",
)
def _(t):
    from scenetally.operators.batching import shown_on_change

    counts = vt.submissions_by_hour(t.events, "ts")
    return shown_on_change(counts, ["day", "hour"], "day").select("shown", "day", "hour", "n")


@query(
    "worker_share",
    "SELECT user_id, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY 1",
)
def _(t):
    return vt.worker_share(t.events, "user_id").select("user_id", "n", r("percent"))


@query(
    "remaining_assignments",
    f"""WITH {BALLOTS}, d AS (SELECT pair, count(*) AS n FROM ballots WHERE confidence = 'confidence_3' GROUP BY 1)
    SELECT p.pair, greatest(40 - coalesce(n, 0), 0)::BIGINT AS remaining FROM (SELECT DISTINCT pair FROM ballots) p LEFT JOIN d USING (pair)""",
)
def _(t):
    b = ballots(t)
    wanted = b.select("pair").distinct().withColumn("maximum", F.lit(40).cast("long"))
    return vt.remaining_assignments(wanted, b.where("confidence = 'confidence_3'"), "pair", "maximum")


@query(
    "complete_and_incomplete_pairs",
    f"""WITH {BALLOTS}, d AS (SELECT pair, user_id, count(*) AS n FROM ballots GROUP BY ALL)
    SELECT n >= 2 AS complete, count(*) AS n_pairs, sum(n)::BIGINT AS n_answers FROM d GROUP BY 1""",
)
def _(t):
    per = ballots(t).groupBy("pair", "user_id").agg(F.count("*").alias("n"))
    full, part = vt.split_by_answers(per, "n", 2)
    both = full.withColumn("complete", F.lit(True)).unionByName(part.withColumn("complete", F.lit(False)))
    return both.groupBy("complete").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_answers"))


@query(
    "member_per_pair",
    f"""WITH {BALLOTS}, h AS (SELECT DISTINCT pair, event_id, ('0x' || substr(md5('11|' || pair || '|' || event_id), 1, 13))::BIGINT AS h FROM ballots)
    SELECT pair, arg_min(event_id, h) AS event_id FROM h GROUP BY pair""",
)
def _(t):
    return vt.picked_member(ballots(t), "pair", "event_id", seed=11)


# ---- retrieval ---------------------------------------------------------------------------------------------------

RANKS = f"""WITH {EMB}, tgt AS (SELECT a.vec_id, a.v, min(b.vec_id) AS target FROM e a JOIN e b ON a.label = b.label AND b.vec_id > a.vec_id GROUP BY a.vec_id, a.v),
s AS (SELECT q.vec_id, q.target, i.vec_id AS item, round(list_dot_product(q.v, i.v), 9) AS score FROM tgt q, e i),
g AS (SELECT vec_id, score AS goal FROM s WHERE item = target),
ranks AS (SELECT s.vec_id, count(*) FILTER (item <> target AND (score > goal OR (score = goal AND item < target))) + 1 AS rank FROM s JOIN g USING (vec_id) GROUP BY s.vec_id)"""


def target_ranks(t: Tables) -> DataFrame:
    """Target of a vector: the next vector of its label."""
    from scenetally.operators.ordered import positions

    placed = positions(t.embeddings, ["label"], ["vec_id"], "_pos")
    follower = placed.select("label", (F.col("_pos") - 1).alias("_pos"), F.col("vec_id").alias("target"))
    queries = placed.join(follower, ["label", "_pos"]).select("vec_id", "target", "embedding")
    return ve.rank_of_target(queries, t.embeddings, "vec_id", "vec_id", "embedding", "target")


@query("rank_of_target", RANKS + " SELECT vec_id, rank FROM ranks")
def _(t):
    return target_ranks(t)


@query(
    "retrieval_recall",
    RANKS + """ SELECT round(count(*) FILTER (rank - 1 < 1) * 100.0 / count(*), 6) AS r1, round(count(*) FILTER (rank - 1 < 5) * 100.0 / count(*), 6) AS r5,
    round(count(*) FILTER (rank - 1 < 10) * 100.0 / count(*), 6) AS r10, (floor(median(rank - 1)) + 1)::BIGINT AS median_rank, round(avg(rank - 1) + 1, 6) AS mean_rank, count(*) AS n FROM ranks""",
)
def _(t):
    out = ra.retrieval_recall(target_ranks(t), "rank")
    return out.select(r("r1"), r("r5"), r("r10"), F.col("median_rank").cast("long"), r("mean_rank"), "n")


@query(
    "top_matches",
    f"""WITH {EMB}, s AS (SELECT a.vec_id, b.vec_id AS item, round(list_dot_product(a.v, b.v), 9) AS score FROM e a, e b),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS rank FROM s)
    SELECT vec_id, rank::INT AS rank, item, score FROM k WHERE rank <= 10""",
)
def _(t):
    m = ve.top_matches(t.embeddings, t.embeddings, "vec_id", "vec_id", "embedding", 10)
    return m.select("vec_id", "rank", "item", "score")


@query(
    "average_precision",
    """WITH q AS (SELECT l_suppkey, l_quantity * l_extendedprice AS score, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS item, l_returnflag = 'R' AS pos FROM lineitem),
    k AS (SELECT l_suppkey, pos, row_number() OVER w AS i, sum(pos::INT) OVER w AS h FROM q WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING))
    SELECT l_suppkey, count(*) AS n_items, sum(pos::INT)::BIGINT AS n_positive, round(avg(h / i) FILTER (pos), 6) AS ap FROM k GROUP BY 1""",
)
def _(t):
    lines = t.lineitem.select(
        "l_suppkey",
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("score"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("item"),
        (F.col("l_returnflag") == "R").alias("pos"),
    )
    return ra.average_precision(lines, ["l_suppkey"], "score", "item", "pos").select("l_suppkey", "n_items", "n_positive", r("ap"))


# ---- answers and choices -----------------------------------------------------------------------------------------

ANSWERS = """ans AS (SELECT user_id, event_type AS answer, count(*) AS n, CASE count(*) WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 WHEN 3 THEN 0.9 ELSE 1.0 END::DOUBLE AS score
  FROM events GROUP BY ALL)"""


@query("soft_answer_score", f"WITH {ANSWERS} SELECT user_id, answer, n, score FROM ans")
def _(t):
    return ra.answer_scores(t.events.withColumnRenamed("event_type", "answer"), "user_id", "answer")


@query(
    "vqa_accuracy",
    f"""WITH {ANSWERS}, pred AS (SELECT user_id, arg_max(event_type, struct_pack(v := value, e := event_id)) AS answer FROM events GROUP BY 1)
    SELECT count(*) AS n, round(avg(coalesce(score, 0)), 8) AS accuracy FROM pred LEFT JOIN ans USING (user_id, answer)""",
)
def _(t):
    ev = t.events.withColumnRenamed("event_type", "answer")
    pred = ev.groupBy("user_id").agg(F.max_by("answer", F.struct("value", "event_id")).alias("answer"))
    return ra.vqa_accuracy(pred, ra.answer_scores(ev, "user_id", "answer"), "user_id", "answer").select("n", r("accuracy", 8))


CHOICES = """c1 AS (SELECT l_orderkey, arg_max(l_linenumber, struct_pack(s := l_extendedprice, c := -l_linenumber)) AS choice FROM lineitem GROUP BY 1),
c2 AS (SELECT l_orderkey, arg_max(l_linenumber, struct_pack(s := l_quantity, c := -l_linenumber)) AS choice FROM lineitem GROUP BY 1),
truth AS (SELECT l_orderkey, arg_max(l_linenumber, struct_pack(s := l_discount, c := -l_linenumber)) AS choice FROM lineitem GROUP BY 1)"""


@query(
    "joint_choice_accuracy",
    f"""WITH {CHOICES} SELECT count(*) AS n, round(avg((c1.choice = t.choice)::INT), 8) AS first, round(avg((c2.choice = t.choice)::INT), 8) AS second,
    round(avg((c1.choice = t.choice AND c2.choice = t.choice)::INT), 8) AS joint FROM truth t JOIN c1 USING (l_orderkey) JOIN c2 USING (l_orderkey)""",
)
def _(t):
    def picks(score: str, name: str) -> DataFrame:
        best = ra.best_choice(t.lineitem, ["l_orderkey"], "l_linenumber", score)
        return best.select("l_orderkey", F.col("l_linenumber").alias(name))

    truth = picks("l_discount", "truth")
    first = picks("l_extendedprice", "c").join(truth, "l_orderkey").withColumn("hit", F.expr("c = truth"))
    second = picks("l_quantity", "c").join(truth, "l_orderkey").withColumn("hit", F.expr("c = truth"))
    out = ra.joint_accuracy(first, second, "l_orderkey", "hit")
    return out.select("n", r("first", 8), r("second", 8), r("joint", 8))


@query(
    "top_k_answers",
    """WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS s FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS rank FROM s)
    SELECT user_id, event_type, round(s, 4) AS score, rank::INT AS rank FROM k WHERE rank <= 3""",
)
def _(t):
    sums = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("score"))
    return ra.top_k_labels(sums, "user_id", "event_type", "score", 3).select("user_id", "event_type", r("score", 4), "rank")


@query(
    "validation_average",
    """WITH p AS (SELECT l_shipmode AS task, sum(loss) / count(*) AS loss, sum(score) / sum(items) AS score FROM (SELECT l_returnflag AS l_shipmode, l_tax AS loss, l_discount AS score, l_quantity AS items FROM lineitem) GROUP BY 1)
    SELECT task, round(loss, 8) AS loss, round(score, 8) AS score FROM (SELECT * FROM p UNION ALL SELECT NULL, avg(loss), avg(score) FROM p)""",
)
def _(t):
    return ra.validation_average(t.lineitem, "l_returnflag", "l_tax", "l_discount", "l_quantity").select(
        F.col("l_returnflag").alias("task"), r("loss", 8), r("score", 8)
    )
