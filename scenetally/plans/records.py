"""Sampling, batching, annotation, trace, series and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.operators import annotations as an
from scenetally.operators import batching as ba
from scenetally.operators import runs as ru
from scenetally.operators import sampling as sa
from scenetally.operators import traces as tr
from scenetally.operators import vectors as ve
from scenetally.operators import vocabulary as vo
from scenetally.plans.pairs import CUT, noun_table
from scenetally.plans.registry import Tables, query, r
from scenetally.plans.views import DETECTIONS, det_and_truth, detections

D = DETECTIONS.rstrip(",")


def h(seed, *parts: str) -> str:
    """SQL of the seeded hash number."""
    return f"('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 13))::BIGINT"


UNIT = 2**52

# ---- batching ---------------------------------------------------------------------------------------------------------


@query("round_robin_shard", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 7)::INT AS shard FROM orders")
def _(t):
    return ba.round_robin_shard(t.orders.select("o_orderkey"), ["o_orderkey"], 7).withColumn("shard", F.col("shard").cast("int"))


@query(
    "fixed_batch",
    """WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS batch, count(*) OVER () // 64 AS w FROM orders)
    SELECT o_orderkey, batch FROM b WHERE batch < w""",
)
def _(t):
    return ba.fixed_batch(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 64, keep_remainder=False).select("o_orderkey", "batch")


GROUPED = """WITH a AS (SELECT o_orderkey, o_orderpriority AS g, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS at FROM orders),
b AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY at) - 1) AS i FROM a),
hd AS (SELECT g, i // 16 AS b, min(at) AS f, count(*) AS n FROM b GROUP BY ALL HAVING count(*) = 16),
nb AS (SELECT g, b, row_number() OVER (ORDER BY f) - 1 AS batch FROM hd)
SELECT o_orderkey, batch, i % 16 + 1 AS slot FROM b JOIN nb ON b.g = nb.g AND b.i // 16 = nb.b""".replace(" AS at", " AS att").replace("ORDER BY at", "ORDER BY att").replace("min(at)", "min(att)")


@query("grouped_batch", GROUPED)
def _(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    return ba.grouped_batch(o, "o_orderpriority", ["o_orderdate", "o_orderkey"], 16, drop_uneven=True).select("o_orderkey", "batch", "slot")


@query(
    "contiguous_shard",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // ceil(count(*) OVER () / 7)::BIGINT AS shard FROM orders",
)
def _(t):
    return ba.contiguous_shard(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "even_shard",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    z AS (SELECT *, ceil(n / 7)::BIGINT AS s FROM p), w AS (SELECT o_orderkey, i, s FROM z UNION ALL SELECT o_orderkey, i + n, s FROM z WHERE i + n < s * 7)
    SELECT o_orderkey, i // s AS shard FROM w""",
)
def _(t):
    return ba.even_shard(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "tail_split",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN i > n - 300 THEN 'minival' ELSE 'train' END AS split, count(*) AS n, min(o_orderkey) AS first FROM p GROUP BY 1""",
)
def _(t):
    out = ba.tail_split(t.orders.select("o_orderkey"), ["o_orderkey"], 300)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("head_subset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return ba.head_subset(t.orders, ["o_orderdate", "o_orderkey"], 100).select("o_orderkey")


@query(
    "epoch_replay",
    """WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    e AS (SELECT s_suppkey, e, e * n + i AS iteration FROM p, (SELECT unnest(range(100)) AS e))
    SELECT s_suppkey, e AS epoch, iteration FROM e WHERE iteration < (SELECT count(*) FROM customer)""",
)
def _(t):
    # as many draws as there are customers
    n = t.customer.count()
    return sa.epoch_replay(t.supplier.select("s_suppkey"), ["s_suppkey"], n)


# ---- series -----------------------------------------------------------------------------------------------------------


@query(
    "windowed_history",
    """WITH w AS (SELECT event_id, event_type, value, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l,
    avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
    SELECT event_id, event_type, list_sort(l)[(len(l) + 1) // 2] AS median, round(list_avg(l), 9) AS window_mean, round(g + 2.7e-8, 6) AS global_mean FROM w""",
)
def _(t):
    out = ba.windowed_history(t.events.select("event_id", "event_type", "value"), ["event_type"], ["event_id"], "value")
    # the values have two decimals, so means fall on exact rounding halves; the shift keeps float noise from deciding them
    mean = F.round(F.col("global_mean") + 2.7e-8, 6).alias("global_mean")
    return out.select("event_id", "event_type", "median", r("window_mean", 9), mean)


@query(
    "remaining_time",
    """WITH w AS (SELECT event_id, event_type, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM events)
    SELECT event_id, round(list_sort(l)[(len(l) + 1) // 2] * (1000000 - event_id - 1), 4) AS eta FROM w""",
)
def _(t):
    out = ba.windowed_history(t.events.select("event_id", "event_type", "value"), ["event_type"], ["event_id"], "value")
    eta = ba.remaining_time(F.col("median"), F.col("event_id"), F.lit(1000000))
    return out.select("event_id", F.round(eta, 4).alias("eta"))


@query("latest_value", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(t):
    return ba.latest_value(t.events, ["user_id", "event_type"], ["event_id"], "value")


@query(
    "sub_sequence_number",
    """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    g AS (SELECT *, sum((p IS NULL OR p <> event_type)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM l)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, isl ORDER BY event_id) - 1 AS sub FROM g""",
)
def _(t):
    return ba.sub_sequence_number(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], ["event_type"]).select("event_id", "sub")


@query(
    "log_group_average",
    """WITH p AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS c FROM events),
    a AS (SELECT user_id, c, avg(value) AS s, count(*) AS n FROM p GROUP BY ALL)
    SELECT user_id, c AS checkpoint, round(s, 6) AS score, n FROM a""",
)
def _(t):
    e = t.events.select("user_id", "event_id", "value").withColumn("world", F.lit(4))
    return ba.log_group_average(e, "user_id", ["event_id"], "value", "world").select("user_id", "checkpoint", r("score"), "n")


@query(
    "best_checkpoint",
    """WITH p AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS c FROM events),
    a AS (SELECT user_id, c, avg(value) AS s FROM p GROUP BY ALL)
    SELECT user_id, arg_max(c, s) AS checkpoint, round(max(s), 6) AS score FROM a GROUP BY 1""",
)
def _(t):
    e = t.events.select("user_id", "event_id", "value").withColumn("world", F.lit(4))
    return ba.best_checkpoint(ba.log_group_average(e, "user_id", ["event_id"], "value", "world"), "user_id").select("user_id", "checkpoint", r("score"))


# ---- sampling ---------------------------------------------------------------------------------------------------------


@query(
    "mismatch_captions",
    f"""WITH p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM documents),
    w AS (SELECT *, {h(5, "'coin'", 'doc_id')} / {UNIT} < 0.5 AS f, (pos + {h(5, "'pick'", 'doc_id')} % (n - 1)) % n + 1 AS o FROM p)
    SELECT w.doc_id, md5(q.text) AS digest, f::INT AS label FROM w JOIN p q ON q.pos = CASE WHEN f THEN o ELSE w.pos END""",
)
def _(t):
    out = sa.mismatch_captions(t.documents.select("doc_id", "text"), "doc_id", "text", 5)
    return out.select("doc_id", F.md5("text").alias("digest"), "label")


@query(
    "mask_tokens",
    f"""WITH {CUT}, v AS (SELECT list(word ORDER BY word) AS v FROM nouns),
    coins AS (SELECT doc_id, pos, word, {h(3, "'mask'", "doc_id", "pos")} / {UNIT}::DOUBLE AS coin, {h(3, "'word'", "doc_id", "pos")} AS x FROM doc_words),
    m AS (SELECT doc_id, pos, coin < 0.15::DOUBLE AS chosen, CASE WHEN coin >= 0.15::DOUBLE THEN word WHEN coin / 0.15::DOUBLE < 0.8::DOUBLE THEN '[MASK]'
    WHEN coin / 0.15::DOUBLE < 0.9::DOUBLE THEN v[x % len(v) + 1] ELSE word END AS token FROM coins, v)
    SELECT doc_id, md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS digest, count(token)::INT AS n,
    count_if(chosen)::INT AS n_chosen, count_if(token = '[MASK]')::INT AS n_masked FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1""",
)
def _(t):
    words = noun_table(t).agg(F.array_sort(F.collect_list("word")).alias("w")).scalar()
    listed = t.documents.select("doc_id", vo.words(F.col("text")).alias("tokens")).withColumn("_v", words)
    masked = listed.select("doc_id", sa.mask_tokens(F.col("tokens"), "doc_id", 3, F.col("_v"), F.col("_v")).alias("m"))
    return masked.select(
        "doc_id", F.md5(F.array_join("m.token", " ")).alias("digest"), F.size("m").alias("n"),
        F.size(F.filter("m", lambda m: m["label"].isNotNull())).alias("n_chosen"),
        F.size(F.filter("m", lambda m: m["token"] == "[MASK]")).alias("n_masked"),
    )


@query(
    "mask_regions",
    f"""WITH e AS (SELECT vec_id // 8 AS image, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS i FROM embeddings),
    c AS (SELECT image, {h(3, "'region'", "image", "i")} / {UNIT}::DOUBLE AS coin FROM e)
    SELECT image, count(*)::INT AS n, count_if(coin < 0.3::DOUBLE)::INT AS n_chosen,
    count_if(coin < 0.3::DOUBLE AND coin / 0.3::DOUBLE < 0.9::DOUBLE)::INT AS n_zeroed FROM c GROUP BY 1""",
)
def _(t):
    images = t.embeddings.groupBy(F.floor(F.col("vec_id") / 8).alias("image")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e")
    )
    masked = images.select("image", sa.mask_regions(F.col("e.embedding"), "image", 3, 0.3).alias("m"))
    return masked.select(
        "image", F.size("m").alias("n"), F.size(F.filter("m", lambda m: m["label"] == 1)).alias("n_chosen"),
        F.size(F.filter("m", lambda m: m["causal"] == -1)).alias("n_zeroed"),
    )


@query(
    "negative_samples",
    f"""WITH e AS (SELECT conv_id || '-' || turn AS key, conv_id, md5(text) AS caption FROM conversations),
    ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM e)),
    near AS (SELECT a.conv_id, list(b.conv_id ORDER BY b.conv_id) AS pool FROM ids a JOIN ids b ON b.conv_id BETWEEN a.conv_id AND a.conv_id + 5 GROUP BY 1),
    cap AS (SELECT conv_id, arg_min(caption, struct_pack(h := {h(9, "'cap'", "key")}, c := caption)) AS cap FROM e GROUP BY 1),
    d AS (SELECT key, conv_id, caption, (pos + {h(9, "'text'", "key")} % greatest(n - 1, 1)) % n + 1 AS tp,
    (pos + {h(9, "'image'", "key")} % greatest(n - 1, 1)) % n + 1 AS ip, pool[{h(9, "'hard'", "key")} % greatest(len(pool) - 1, 1) + 2] AS hard
    FROM e JOIN ids USING (conv_id) LEFT JOIN near USING (conv_id)),
    j AS (SELECT key, d.conv_id, caption, i.conv_id AS other, tc.cap AS text, hc.cap AS hard_text FROM d JOIN ids i ON i.pos = ip
    JOIN ids ti ON ti.pos = tp JOIN cap tc ON tc.conv_id = ti.conv_id LEFT JOIN cap hc ON hc.conv_id = hard)
    SELECT key, 0 AS kind, conv_id AS image, caption, 1 AS target FROM j UNION ALL SELECT key, 1, conv_id, text, 0 FROM j
    UNION ALL SELECT key, 2, other, caption, 0 FROM j UNION ALL SELECT key, 3, conv_id, coalesce(hard_text, text), 0 FROM j""",
)
def _(t):
    """Turns as captions of their conversation; near conversations are the next ones by id."""
    entries = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", F.md5("text").alias("caption"))
    ids = t.conversations.select("conv_id").distinct()
    near = ids.select("conv_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 5)).alias("other"))
    pool = near.join(ids.withColumnRenamed("conv_id", "other"), "other").groupBy("conv_id").agg(F.array_sort(F.collect_list("other")).alias("pool"))
    return sa.negative_samples(entries, pool, "key", "conv_id", "caption", 9)


RF = f"""{D}, tot AS (SELECT count(DISTINCT image_id)::DOUBLE AS n FROM boxes),
c AS (SELECT category, count(DISTINCT image_id) AS c FROM boxes GROUP BY 1),
f AS (SELECT category, greatest(1, sqrt(0.9 / (c / n))) AS f FROM c, tot),
rf AS (SELECT image_id, max(f) AS f FROM boxes JOIN f USING (category) GROUP BY 1)"""


@query("category_repeat_factor", f"WITH {RF} SELECT image_id, round(f, 8) AS repeat_factor FROM rf")
def _(t):
    return an.repeat_factors(detections(t), "image_id", "category", 0.9).select("image_id", r("repeat_factor", 8))


@query(
    "repeat_factor_sample",
    f"""WITH {RF}, n AS (SELECT image_id, floor(round(f, 8)) + ({h(4, '2', 'image_id')} / {UNIT} < round(f, 8) - floor(round(f, 8)))::INT AS k FROM rf)
    SELECT image_id, unnest(range(1, k::BIGINT + 1))::INT AS copy FROM n""",
)
def _(t):
    f = an.repeat_factors(detections(t), "image_id", "category", 0.9).select("image_id", r("repeat_factor", 8))
    return sa.repeat_factor_sample(f, "image_id", "repeat_factor", 4, epoch=2).select("image_id", "copy")


@query(
    "mixture",
    f"""SELECT 0 AS source_no, doc_id AS id FROM documents WHERE {h(6, '0', 'doc_id')} / {UNIT} < 1.0
    UNION ALL SELECT 1, page_id FROM pages WHERE {h(6, '1', 'page_id')} / {UNIT} < 0.25""",
)
def _(t):
    a, b = t.documents.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id"))
    return sa.mixture([(a, 0.8), (b, 0.2)], "id", 6)


@query(
    "uniform_sample",
    f"""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {h(8, 'doc_id')}, doc_id) AS rn FROM documents)
    SELECT source, doc_id FROM d WHERE rn <= 5""",
)
def _(t):
    return sa.uniform_sample(t.documents.select("source", "doc_id"), "source", "doc_id", 5, 8)


@query(
    "confidence_sample",
    f"""WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    b AS (SELECT * FROM p WHERE pos <= least(greatest(floor(n * 0.2), 10), n)),
    d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h(8, 'doc_id')}, doc_id) AS rn FROM b)
    SELECT lang, doc_id FROM d WHERE rn <= 10""",
)
def _(t):
    d = t.documents.select("lang", "doc_id", "n_chars")
    return sa.confidence_sample(d, "lang", "doc_id", "n_chars", 10, 8, proportion=0.2).select("lang", "doc_id")


@query(
    "balanced_label_sample",
    f"""WITH x AS (SELECT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS lab FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, lab ORDER BY {h(2, 'k')}, k) AS rn, count(*) FILTER (lab = 1) OVER (PARTITION BY l_suppkey) AS np FROM x)
    SELECT l_suppkey, k, lab FROM d WHERE (lab = 1 AND rn <= least(np, 8)) OR (lab = 0 AND rn <= 32 - least(np, 8))""",
)
def _(t):
    lab = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).otherwise(-1)
    rows = t.lineitem.select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), lab.alias("lab"))
    return sa.balanced_label_sample(rows, "l_suppkey", "k", "lab", 32, 0.25, 2)


FRAME_STRATEGIES = ("first", "last", "random", "all")


@query(
    "frame_selection",
    f"""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z,
    row_number() OVER (PARTITION BY user_id ORDER BY {h(11, "user_id", "event_id")}, event_id) AS x FROM events)
    SELECT 'first' AS strategy, user_id, event_id FROM p WHERE a <= 5 UNION ALL SELECT 'last', user_id, event_id FROM p WHERE z <= 5
    UNION ALL SELECT 'random', user_id, event_id FROM p WHERE x <= 5 UNION ALL SELECT 'all', user_id, event_id FROM p""",
)
def _(t):
    """Events as the frames of a user's film, five of each."""
    frames = t.events.select("user_id", "event_id")
    picked = [sa.selected_frames(frames, "user_id", "event_id", s, 5, 11).select(F.lit(s).alias("strategy"), "*") for s in FRAME_STRATEGIES]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3])


@query(
    "caption_subsample",
    f"""WITH c AS (SELECT conv_id, list(md5(text) ORDER BY turn, md5(text)) AS d, count(*) AS n FROM conversations GROUP BY 1),
    s AS (SELECT *, {h(1, "'start'", "conv_id")} % greatest(n - 4, 1) + 1 AS s FROM c)
    SELECT conv_id, array_to_string(CASE WHEN n >= 5 THEN d[s:s + 4] ELSE list_transform(range(1, 6), lambda i : d[{h(1, "'again'", "conv_id", "i")} % n + 1]) END, ',') AS picked FROM s""",
)
def _(t):
    per = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("d")))).alias("c"))
    return per.select("conv_id", F.array_join(sa.caption_subsample(F.col("c.d"), "conv_id", 5, 1), ",").alias("picked"))


@query("shuffled_epoch", f"SELECT o_orderkey, {h(1, '3', 'o_orderkey')} AS shuffle_key FROM orders")
def _(t):
    return sa.shuffled(t.orders.select("o_orderkey"), "o_orderkey", 1, 3)


@query(
    "random_fallback",
    f"""WITH g AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS n FROM documents WHERE n_chars > 300),
    b AS (SELECT doc_id, {h(3, 'doc_id')} % (SELECT count(*) FROM g) + 1 AS pos FROM documents WHERE n_chars <= 300)
    SELECT doc_id, lang, doc_id AS origin FROM g UNION ALL SELECT b.doc_id, g.lang, g.doc_id FROM b JOIN g USING (pos)""",
)
def _(t):
    d = t.documents.select("doc_id", "lang", (F.col("n_chars") > 300).alias("ok"))
    return sa.random_fallback(d, "doc_id", "ok", 3).select("doc_id", "lang", "origin")


# ---- annotations --------------------------------------------------------------------------------------------------------


def annotated(t: Tables) -> DataFrame:
    """Images (orders) with their boxes as annotations; open lines of 50 pieces are crowds."""
    b = detections(t)
    crowd = ((F.col("side") == "O") & (F.col("x1") >= 90)).cast("int")
    keypoints = F.array("x1", "y1", F.when(F.col("x1") > 40, 2.0).otherwise(0.0), "x2", "y2", F.when(F.col("y1") > 10, 1.0).otherwise(0.0))
    entry = F.struct("det_id", "category", *[c for c in ("x1", "y1", "x2", "y2", "score")], crowd.alias("iscrowd"), keypoints.alias("keypoints"))
    return b.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("annotations"))


ANN = f"{D}, a AS (SELECT *, (side = 'O' AND x1 >= 90)::INT AS crowd, (x1 > 40)::INT + (y1 > 10)::INT AS kp FROM boxes)"


@query(
    "annotation_predicates",
    f"""WITH {ANN} SELECT image_id, bool_or(crowd = 0) AS non_crowd, sum(kp) >= 4 AS enough_points, count(*) >= 3 AND bool_or(x2 - x1 > 1 AND y2 - y1 > 1) AS valid,
    bool_or(crowd = 0) AND (sum(kp) >= 4 OR count(*) >= 6) AS keep, bool_or(crowd = 0 AND (x2 - x1) * (y2 - y1) * 0.875 >= 3000) AS masked FROM a GROUP BY 1""",
)
def _(t):
    """The mask of an annotation is its box without one corner, that of a crowd has no vertices."""
    ann = F.col("annotations")

    def masked(a):
        ring = F.array(a["x1"], a["y1"], a["x2"], a["y1"], a["x2"], a["y2"], (a["x1"] + a["x2"]) / 2, a["y2"], a["x1"], (a["y1"] + a["y2"]) / 2)
        return a.withField("segmentation", F.when(a["iscrowd"] == 0, F.array(ring)))

    non_crowd, points = an.has_non_crowd(ann), an.enough_keypoints(ann, 4)
    return annotated(t).select(
        "image_id", non_crowd.alias("non_crowd"), points.alias("enough_points"), an.valid_annotation(ann, 3).alias("valid"),
        an.keep_instance([non_crowd], [points, F.size(ann) >= 6]).alias("keep"),
        an.has_mask(F.transform(ann, masked), 3000).alias("masked"),
    )


@query(
    "whitelisted_categories",
    f"WITH {D} SELECT image_id, det_id, CASE category WHEN 'N' THEN 'A' ELSE category END AS category FROM boxes WHERE category IN ('A', 'N')",
)
def _(t):
    kept = an.whitelist_and_map(F.col("annotations"), ["A", "N"], {"N": "A"})
    return annotated(t).select("image_id", F.explode(kept).alias("a")).select("image_id", "a.det_id", "a.category")


@query(
    "score_filtered_entries",
    f"WITH {D} SELECT image_id, count(*) FILTER (score >= 0.4) AS n_kept FROM boxes GROUP BY 1",
)
def _(t):
    return annotated(t).select("image_id", F.size(an.score_filter(F.col("annotations"), 0.4)).cast("long").alias("n_kept"))


@query(
    "field_selector",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#3'",
)
def _(t):
    return t.part.where(an.field_selector("p_size:int=10-20,p_brand=Brand#3")).select("p_partkey")


@query(
    "proposal_filter",
    f"""WITH {D}, c AS (SELECT image_id, det_id, score, least(x1, 80) AS a, least(y1, 50) AS b, least(x2, 80) AS c, least(y2, 50) AS d FROM boxes),
    k AS (SELECT image_id, det_id, c - a AS w, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM c WHERE c - a > 0 AND d - b > 0)
    SELECT image_id, det_id, w FROM k WHERE rn <= 3""",
)
def _(t):
    proposals = F.transform("annotations", lambda a: a.withField("id", a["det_id"]))
    kept = an.proposal_filter(proposals, F.lit(80.0), F.lit(50.0), 3)
    out = annotated(t).select("image_id", F.explode(kept).alias("p"))
    return out.select("image_id", F.col("p.id").alias("det_id"), (F.col("p.x2") - F.col("p.x1")).alias("w"))


@query(
    "proposals_into_images",
    """SELECT l.l_orderkey::VARCHAR AS image, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey::VARCHAR = o.o_orderkey::VARCHAR WHERE o.o_orderstatus = 'F' GROUP BY 1""",
)
def _(t):
    from scenetally.sources.records import proposals_into_images

    images = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image"))
    return proposals_into_images(t.lineitem, images, "l_orderkey", "image").groupBy("image").agg(F.count("*").alias("n"))


@query(
    "valid_image_semi",
    "SELECT count(*) AS n FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)",
)
def _(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(done, "l_orderkey", "left_semi").agg(F.count("*").alias("n"))


@query(
    "finished_anti",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(t):
    from scenetally.sources.writers import remaining_work

    return remaining_work(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("category_histogram", f"WITH {ANN} SELECT category, count(*) AS n FROM a WHERE crowd = 0 GROUP BY ROLLUP (category)")
def _(t):
    rows = annotated(t).select(F.explode("annotations").alias("a")).select("a.category", "a.iscrowd")
    return an.category_histogram(rows, "category", "iscrowd")


@query(
    "value_histogram",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50.0)), 49)::BIGINT AS bin, count(*) AS n FROM orders, s GROUP BY 1)
    SELECT i AS bin, round(lo + (hi - lo) * (i + 1) / 50, 6) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(50)) AS i), s LEFT JOIN b ON b.bin = i""".replace(
        "(SELECT unnest(range(50)) AS i), s LEFT JOIN", "(SELECT i, lo, hi FROM (SELECT unnest(range(50)) AS i), s) LEFT JOIN"
    ),
)
def _(t):
    return an.value_histogram(t.orders, "o_totalprice", 50).select("bin", r("upper"), "n")


@query(
    "merged_categories",
    """WITH u AS (SELECT n_nationkey AS k, n_name AS nm FROM nation UNION SELECT 100 + r_regionkey, r_name FROM region)
    SELECT k, nm, row_number() OVER (ORDER BY k) - 1 AS contiguous_id FROM u""",
)
def _(t):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nm"))
    b = t.region.select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("nm"))
    return an.merged_categories([a, b, a], "k", "nm")


PAGES = "pg AS (SELECT page_id, url, CASE WHEN url LIKE '%#%' THEN 404 WHEN url LIKE '%?%' THEN 301 ELSE 200 END AS status, CASE WHEN url LIKE 'https%' THEN 'image/jpeg; q=1' ELSE 'text/html; charset=utf-8' END AS mime, length(html) AS size FROM pages)"


def downloads(t: Tables) -> DataFrame:
    status = F.when(F.col("url").contains("#"), 404).when(F.col("url").contains("?"), 301).otherwise(200)
    mime = F.when(F.col("url").startswith("https"), "image/jpeg; q=1").otherwise("text/html; charset=utf-8")
    return t.pages.select("page_id", status.alias("status"), mime.alias("mime"), F.length("html").alias("size"))


@query(
    "download_report",
    f"""WITH {PAGES} SELECT 'mime ' || split_part(mime, ';', 1) AS entry, count(*) AS n, NULL::DOUBLE AS mean_log FROM pg GROUP BY 1
    UNION ALL SELECT 'status ' || status, count(*), NULL FROM pg WHERE status <> 200 GROUP BY status
    UNION ALL SELECT 'image size', count(*), round(avg(ln(size)), 6) FROM pg WHERE mime LIKE 'image%' AND size > 0""",
)
def _(t):
    parts = an.download_report(downloads(t), "mime", "status", "size")
    none = F.lit(None).cast("double").alias("mean_log")
    return (
        parts["by_mime"].select(F.concat(F.lit("mime "), "mime").alias("entry"), "n", none)
        .unionByName(parts["failures"].select(F.concat(F.lit("status "), F.col("status").cast("string")).alias("entry"), "n", none))
        .unionByName(parts["image_size"].select(F.lit("image size").alias("entry"), "n", r("mean_log")))
    )


# crc32 of an ASCII URL, bit by bit: each byte comes in with the first of its eight shifts
BITS = "flatten(list_transform(range(1, length(url) + 1), lambda i : [ord(substr(url, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
CRC32 = f"""xor(list_reduce(list_concat([4294967295::BIGINT], {BITS}), lambda c, b : xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"""


@query(
    "caption_by_image_id",
    f"""WITH p AS (SELECT page_id, {CRC32} AS image_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption FROM pages)
    SELECT b.page_id, image_id, a.caption FROM p a JOIN p b USING (image_id)""",
)
def _(t):
    from scenetally.sources.records import url_image_id

    captions = t.pages.select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"))
    ids = t.pages.select(url_image_id(F.col("url")).alias("image_id"), "page_id")
    return captions.withColumn("image_id", url_image_id(F.col("url"))).join(ids, "image_id").select("page_id", "image_id", "caption")


@query(
    "split_assignment",
    """WITH s AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'restval' WHEN 'fr' THEN 'val' WHEN 'de' THEN 'test' END AS sp FROM documents)
    SELECT doc_id, 'train' AS split FROM s WHERE sp = 'restval' UNION ALL SELECT doc_id, sp FROM s WHERE sp IN ('val', 'test')
    UNION ALL SELECT doc_id, unnest(['train', 'val', 'test']) FROM s WHERE sp IS NULL""",
)
def _(t):
    sp = F.when(F.col("lang") == "en", "restval").when(F.col("lang") == "fr", "val").when(F.col("lang") == "de", "test")
    return t.documents.select("doc_id", sp.alias("sp")).select("doc_id", an.assign_split("sp", "restval", False).alias("split"))


@query("ref_split_selector", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def _(t):
    sp = F.when(F.col("lang") == "fr", "testA").when(F.col("lang") == "de", "testAB").when(F.col("lang") == "es", "testB").otherwise("train")
    return t.documents.withColumn("sp", sp).where(an.ref_split("sp", "testA")).select("doc_id")


@query(
    "validity_count",
    "SELECT count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS INT) < 50) AS clean, count(*) FILTER (NOT coalesce(try_cast(json_extract_string(props, '$.k') AS INT) < 50, false)) AS dirty FROM events",
)
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return an.count_valid(t.events, F.when(k < 50, k))


@query(
    "first_unused_examples",
    """WITH RECURSIVE once AS (SELECT p_brand, l_orderkey, min(strftime(l_shipdate, '%Y%m%d') || '-' || lpad(l_orderkey::VARCHAR, 12, '0')) AS arrival
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    few AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY arrival, l_orderkey) <= (SELECT count(DISTINCT p_brand) FROM part)),
    lined AS (SELECT list(struct_pack(b := p_brand, o := l_orderkey) ORDER BY arrival, p_brand, l_orderkey) AS cands FROM few),
    walk AS (SELECT 0 AS i, cands, []::VARCHAR[] AS bs, []::BIGINT[] AS os FROM lined
      UNION ALL SELECT i + 1, cands,
        CASE WHEN list_contains(bs, cands[i + 1].b) OR list_contains(os, cands[i + 1].o) THEN bs ELSE list_append(bs, cands[i + 1].b) END,
        CASE WHEN list_contains(bs, cands[i + 1].b) OR list_contains(os, cands[i + 1].o) THEN os ELSE list_append(os, cands[i + 1].o) END
      FROM walk WHERE i < len(cands)),
    last AS (SELECT bs, os FROM walk WHERE i = len(cands))
    SELECT unnest(bs) AS p_brand, unnest(os) AS l_orderkey FROM last""",
)
def _(t):
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    arrival = F.concat_ws("-", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad("l_orderkey", 12, "0"))
    return an.first_unused_examples(lines.select("p_brand", "l_orderkey", arrival.alias("arrival")), "p_brand", "l_orderkey", "arrival")


# ---- traces -------------------------------------------------------------------------------------------------------------

TRACE = """mk AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS ts, 2 AS flags, o_custkey AS obj FROM orders
  UNION ALL SELECT l_orderkey, max(epoch(l_shipdate))::BIGINT, 4, NULL FROM lineitem GROUP BY 1),
iv AS (SELECT a.id, a.obj, a.ts AS s, b.ts AS e FROM mk a JOIN mk b ON a.id = b.id AND a.flags = 2 AND b.flags = 4),
kn AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS kid, o_custkey AS obj, epoch(l_shipdate)::BIGINT AS lo, epoch(l_shipdate)::BIGINT + 3600 AS hi FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def markers(t: Tables) -> DataFrame:
    """Order = marker of a customer: opened at the order date, closed at its last shipment."""
    begin = t.orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("ts"), F.lit(2).alias("flags"), F.col("o_custkey").alias("obj"))
    end = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.unix_timestamp("l_shipdate")).alias("ts"))
    return begin.unionByName(end.select("id", "ts", F.lit(4).alias("flags"), F.lit(None).cast("long").alias("obj")))


def intervals(t: Tables) -> DataFrame:
    return tr.marker_intervals(markers(t), "id", "ts", "flags", ["obj"])


def kernels(t: Tables) -> DataFrame:
    """Shipment = one hour of work for the customer."""
    ship = F.unix_timestamp("l_shipdate")
    lines = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("kid"), F.col("l_orderkey").alias("o_orderkey"),
        ship.alias("lo"), (ship + 3600).alias("hi"), "l_returnflag", "l_linestatus",
    )
    return lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("obj")), "o_orderkey")


@query("marker_intervals", f"WITH {TRACE} SELECT id, obj, s AS start_time, e AS end_time FROM iv")
def _(t):
    return intervals(t).select("id", "obj", "start_time", "end_time")


@query("enclosing_markers", f"WITH {TRACE} SELECT kid, id FROM kn JOIN iv ON kn.obj = iv.obj AND s < lo AND e > hi")
def _(t):
    return tr.enclosing(kernels(t), intervals(t), ["obj"], "lo", "hi", "start_time", "end_time").select("kid", "id")


@query(
    "between_launch_markers",
    f"""WITH {TRACE}, la AS (SELECT o_custkey AS obj, o_orderkey AS lid FROM orders WHERE o_orderstatus = 'F')
    SELECT m.obj, m.o AS id, min(lid) AS next_launch FROM (SELECT o_custkey AS obj, o_orderkey AS o FROM orders) m JOIN la ON la.obj = m.obj AND lid > m.o GROUP BY ALL""",
)
def _(t):
    m = t.orders.select(F.col("o_custkey").alias("obj"), F.col("o_orderkey").alias("id"))
    la = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("obj"), F.col("o_orderkey").alias("lid"))
    return tr.between_launches(m, la, "obj", "id", "lid")


@query(
    "cpu_info_fallback",
    """SELECT c_custkey, coalesce(a.x, b.x) AS acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON c_custkey = a.o_custkey
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON c_custkey = b.o_custkey""",
)
def _(t):
    def side(status: str) -> DataFrame:
        return t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("acctbal"))

    return tr.cpu_info(t.customer.select("c_custkey"), side("F"), side("O"), "c_custkey", ["acctbal"])


@query(
    "last_forward",
    """WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'f' WHEN event_type = 'error' THEN 'b' END AS d, user_id AS s, CAST(json_extract_string(props, '$.k') AS INT) AS a FROM events),
    x AS (SELECT b.event_id, max(f.event_id) AS i FROM e b JOIN e f ON b.d = 'b' AND f.d = 'f' AND f.s = b.s AND f.event_id < b.event_id GROUP BY 1),
    y AS (SELECT b.event_id, max(f.event_id) AS i FROM e b JOIN e f ON b.d = 'b' AND f.d = 'f' AND f.a = b.s AND f.event_id < b.event_id GROUP BY 1)
    SELECT e.event_id, coalesce(x.i, y.i, -1) AS forward_idx FROM e LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id) WHERE d = 'b'""",
)
def _(t):
    direction = F.when(F.col("event_type").isin("click", "view"), "fprop").when(F.col("event_type") == "error", "bprop")
    ev = t.events.select(
        "event_id", direction.alias("dir"), F.array("user_id").alias("seq"),
        F.array(F.get_json_object("props", "$.k").cast("long")).alias("alt"),
    )
    return tr.last_forward(ev, "event_id", "dir", "seq", "alt")


@query(
    "marker_classify",
    """WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'layer:l' || user_id || ', x' WHEN 'view' THEN 'AddBackward, seq = ' || user_id WHEN 'error' THEN 'traceMarker' ELSE 'Add' END AS s FROM events)
    SELECT event_id, CASE WHEN contains(s, 'layer:') THEN 'layer' WHEN contains(s, 'traceMarker') THEN 'trace' WHEN contains(s, ', seq = ') THEN 'seq' ELSE 'other' END AS kind,
    nullif(regexp_extract(s, 'layer:([^,]*)', 1), '') AS layer, nullif(regexp_extract(s, ', seq = ?([0-9]+)', 1), '')::BIGINT AS seq, contains(s, 'Backward, seq =') AS backward FROM m""",
)
def _(t):
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("layer:l"), "user_id", F.lit(", x")))
        .when(F.col("event_type") == "view", F.concat(F.lit("AddBackward, seq = "), "user_id"))
        .when(F.col("event_type") == "error", "traceMarker").otherwise("Add")
    )
    return t.events.select("event_id", tr.marker_fields(text).alias("m")).select("event_id", "m.*")


@query(
    "trace_rollup",
    """SELECT l_returnflag AS layer, l_linestatus AS op, sum(3600)::BIGINT AS duration, count(*) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(t):
    k = kernels(t).withColumnsRenamed({"l_returnflag": "layer", "l_linestatus": "op"})
    return tr.trace_rollup(k, ["layer", "op"], "lo", "hi")


@query(
    "profile_start",
    "SELECT least((SELECT min(epoch(o_orderdate)) FROM orders), (SELECT min(epoch(l_shipdate)) FROM lineitem), (SELECT min(epoch(ts)) FROM events))::BIGINT AS start",
)
def _(t):
    parts = [
        (t.orders.select(F.unix_timestamp("o_orderdate").alias("x")), "x"),
        (t.lineitem.select(F.unix_timestamp("l_shipdate").alias("x")), "x"),
        (t.events.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("x")), "x"),
    ]
    return tr.profile_start(parts)


# ---- runs and sets --------------------------------------------------------------------------------------------------------


@query(
    "run_mean_deviation",
    """SELECT n_name, round(avg(s_acctbal), 6) AS s_acctbal_mean, round(stddev_samp(s_acctbal), 6) AS s_acctbal_std,
    printf('%.6f', avg(s_acctbal)) || coalesce('±' || printf('%.6f', stddev_samp(s_acctbal)), '') AS s_acctbal_text FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def _(t):
    joined = t.supplier.join(t.nation, F.expr("s_nationkey = n_nationkey"))
    out = ru.mean_and_deviation(joined, ["n_name"], ["s_acctbal"], 6)
    return out.select("n_name", r("s_acctbal_mean"), r("s_acctbal_std"), "s_acctbal_text")


@query(
    "renamed_metrics",
    "SELECT event_id, 'val_' || regexp_replace(event_type || (user_id % 3), '^x$', 'y') AS name, 'zs_R@' || user_id AS recall FROM events",
)
def _(t):
    slim = ru.drop_columns_containing(t.events, ["prop", "ts"])
    return slim.select(
        "event_id", ru.rename_metric(F.concat("event_type", F.col("user_id") % 3), "val_").alias("name"),
        ru.rename_metric(F.concat(F.lit("r"), F.col("user_id")), "zs_").alias("recall"),
    )


@query(
    "top_causes",
    """WITH s AS (SELECT l_suppkey AS e, l_linenumber AS c, round(avg(l_discount), 9) AS s FROM lineitem GROUP BY ALL), n AS (SELECT l_suppkey AS e, count(*) AS n FROM lineitem GROUP BY 1),
    k AS (SELECT e, row_number() OVER (ORDER BY n DESC, e) AS rn FROM n), q AS (SELECT s.*, row_number() OVER (PARTITION BY e ORDER BY s DESC, c) AS rank FROM s JOIN k USING (e) WHERE rn BETWEEN 2 AND 11)
    SELECT e, rank::INT AS rank, c || ': ' || printf('%.3f', s) AS text FROM q WHERE rank <= 3""",
)
def _(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("e"), F.col("l_linenumber").alias("c")).agg(F.round(F.avg("l_discount"), 9).alias("s"))
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("e")).agg(F.count("*").alias("n"))
    return ru.top_causes(s.join(n, "e"), "e", "c", "s", "n", 10, 3)


@query(
    "custom_category_order",
    "SELECT o_orderkey, coalesce(list_position(['F', 'O'], o_orderstatus), 3)::BIGINT AS place FROM orders",
)
def _(t):
    return ru.in_listed_order(t.orders, "o_orderstatus", ["F", "O"]).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    "flattened_results",
    "SELECT user_id, event_type || '/mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY user_id, event_type UNION ALL SELECT user_id, event_type || '/max', max(value) FROM events GROUP BY user_id, event_type",
)
def _(t):
    per = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"), F.max("value").alias("x"))
    inner = F.create_map(F.lit("mean"), "m", F.lit("max"), "x")
    nested = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", inner.alias("v")))).alias("results"))
    return an.flatten_results(nested, "results", ["user_id"])


@query(
    "verified_results",
    """WITH a AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), e AS (SELECT event_type AS metric, avg(value) AS expected FROM events WHERE value < 200 GROUP BY 1)
    SELECT metric FROM e JOIN a USING (metric) WHERE abs(value - expected) > 2.0""",
)
def _(t):
    actual = t.events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    expected = t.events.where("value < 200").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("expected"))
    return an.verify_results(actual, expected.withColumn("tolerance", F.lit(2.0))).select("metric")


@query(
    "concat_datasets",
    """SELECT 0 AS set_no, row_number() OVER (ORDER BY c_custkey) - 1 AS local_index, c_custkey AS id FROM customer UNION ALL SELECT 1, row_number() OVER (ORDER BY s_suppkey) - 1, s_suppkey FROM supplier""",
)
def _(t):
    return ru.concat_datasets([t.customer.select(F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id"))], ["id"])


@query(
    "union_counts",
    """SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1""",
)
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return ru.union_counts([a, t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))], "k", "n")


@query(
    "union_distinct_and_intersect",
    "SELECT k, k IN (SELECT s_suppkey FROM supplier) AND k IN (SELECT c_custkey FROM customer) AS both FROM (SELECT s_suppkey AS k FROM supplier UNION SELECT c_custkey FROM customer)",
)
def _(t):
    a, b = t.supplier.select(F.col("s_suppkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    both = a.intersect(b).withColumn("both", F.lit(True))
    return ru.union_distinct([a, b]).join(both, "k", "left").select("k", F.coalesce("both", F.lit(False)).alias("both"))


@query(
    "first_wins_merge",
    "SELECT coalesce(s.k, c.k) AS k, CASE WHEN s.k IS NOT NULL THEN 0 ELSE 1 END AS shard, coalesce(s.v, c.v) AS v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) s FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer) c ON s.k = c.k",
)
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return ru.first_wins([a, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))], "k")


@query(
    "wide_concat",
    "SELECT s_suppkey AS id, s_acctbal, NULL AS c_mktsegment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer",
)
def _(t):
    return ru.wide_concat([t.supplier.select(F.col("s_suppkey").alias("id"), "s_acctbal"), t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment")])


@query(
    "merged_region_sets",
    """SELECT vec_id // 8 AS image, least(37, 1 + count(*))::INT AS n_regions, round(avg(embedding[1]::DOUBLE), 6) AS head
    FROM embeddings GROUP BY 1 HAVING count_if(vec_id % 8 < 5) > 0 AND count_if(vec_id % 8 >= 5) > 0""",
)
def _(t):
    """Detected and true regions of an image, each set headed by its mean vector."""
    half = (F.col("vec_id") % 8 < 5).alias("detected")
    sets = t.embeddings.select(F.floor(F.col("vec_id") / 8).alias("image"), half, "vec_id", "embedding")

    def headed(which: bool, name: str) -> DataFrame:
        rows = sets.where(F.col("detected") == which).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
        feats, _ = ve.global_region(F.col("e.embedding"), F.array().cast("array<array<double>>"), 64)
        return rows.select("image", feats.alias(name), F.size("e").cast("double").alias(f"n_{name}"))

    both = headed(True, "d").join(headed(False, "g"), "image")
    merged = ve.merge_region_sets(F.col("d"), F.col("g"), F.col("n_d"), F.col("n_g"), 37)
    return both.select("image", F.size(merged).alias("n_regions"), F.round(merged[0][0], 6).alias("head"))


@query(
    "normalised_boxes",
    f"WITH {D} SELECT det_id, round(x1 / 200, 8) AS nx1, round(y2 / 100, 8) AS ny2, round((x2 - x1) * (y2 - y1) / 20000, 8) AS share FROM boxes",
)
def _(t):
    norm = ve.normalise_boxes(F.array(F.struct("x1", "y1", "x2", "y2")), F.lit(200.0), F.lit(100.0))
    out = detections(t).select("det_id", norm[0].alias("b"))
    return out.select("det_id", F.round(F.col("b")[0], 8).alias("nx1"), F.round(F.col("b")[3], 8).alias("ny2"), F.round(F.col("b")[4], 8).alias("share"))
