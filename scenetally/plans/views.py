"""The given tables seen as the record types of the operators, in Spark and in SQL.

Every view covers the whole table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.operators.vocabulary import WORD, explode_words, words
from scenetally.plans.registry import Tables, spread


def baskets(t: Tables) -> DataFrame:
    """record = order, item = brand of each ordered part."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("record"), "l_partkey")
    return lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item")), "l_partkey").select("record", "item")


BASKETS = "baskets AS (SELECT l_orderkey AS record, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def doc_words(t: Tables) -> DataFrame:
    return explode_words(spread(t.documents.select("doc_id", "text")), "doc_id", "text")


DOC_WORDS = f"""doc_lists AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
doc_words AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM doc_lists)"""


def ballots(t: Tables) -> DataFrame:
    """Events as crowd answers: pair from the key in props, answer from the event type, confidence from the value band."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = F.when(F.col("value") < 20, "confidence_1").when(F.col("value") < 60, "confidence_2")
    answer = (
        F.when(F.col("event_type") == "click", "x-to-y")
        .when(F.col("event_type") == "view", "y-to-x")
        .when(F.col("event_type") == "error", "z-to-xy")
        .when(F.col("event_type") == "purchase", "x-is-y")
        .otherwise("x-to-y")
    )
    return t.events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(" // ", F.concat(F.lit("w"), k % 10), F.concat(F.lit("w"), 10 + F.floor(k / 10))).alias("pair"),
        answer.alias("answer"),
        F.when(F.col("value") < 300, F.coalesce(level, F.lit("confidence_3"))).alias("confidence"),
    )


BALLOTS = """ballots AS (SELECT event_id, user_id, ts,
  'w' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) || ' // w' || (10 + CAST(json_extract_string(props, '$.k') AS INT) // 10) AS pair,
  CASE event_type WHEN 'click' THEN 'x-to-y' WHEN 'view' THEN 'y-to-x' WHEN 'error' THEN 'z-to-xy' WHEN 'purchase' THEN 'x-is-y' ELSE 'x-to-y' END AS answer,
  CASE WHEN value < 20 THEN 'confidence_1' WHEN value < 60 THEN 'confidence_2' WHEN value < 300 THEN 'confidence_3' END AS confidence
  FROM events)"""


def detections(t: Tables) -> DataFrame:
    """Order lines as boxes of an image (order): quantity, discount and tax give the corners, the price the score."""
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    x1, y1 = q * 2, F.round(d * 300)
    return t.lineitem.select(
        F.col("l_orderkey").alias("image_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("det_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("side"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 40 + F.round(x * 500)).alias("x2"),
        (y1 + 30 + F.col("l_linenumber") * 4).alias("y2"),
        F.round(F.col("l_extendedprice") / 105000, 6).alias("score"),
    )


DETECTIONS = """boxes AS (SELECT l_orderkey AS image_id,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS det_id,
  l_returnflag AS category, l_linestatus AS side,
  l_quantity * 2 AS x1, round(l_discount * 300) AS y1,
  l_quantity * 2 + 40 + round(l_tax * 500) AS x2, round(l_discount * 300) + 30 + l_linenumber * 4 AS y2,
  round(l_extendedprice / 105000, 6) AS score FROM lineitem),
dets AS (SELECT * FROM boxes WHERE side = 'O'),
truths AS (SELECT * FROM boxes WHERE side = 'F'),"""


def det_and_truth(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Open lines are the detections, finished lines the truths of the same image and category."""
    boxes = detections(t)
    dets = boxes.where("side = 'O'").drop("side")
    truths = boxes.where("side = 'F'").drop("side", "score").withColumnRenamed("det_id", "truth_id")
    return dets, truths


def iou_sql(a: str, b: str, off: str = "1") -> str:
    """IoU of two aliased boxes; off is added to every side."""
    w = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {off}, 0)"
    h = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {off}, 0)"
    area = "(({0}.x2 - {0}.x1 + " + off + ") * ({0}.y2 - {0}.y1 + " + off + "))"
    return f"({w} * {h}) / ({area.format(a)} + {area.format(b)} - ({w} * {h}))"


def replies(t: Tables) -> DataFrame:
    """Each turn with the next turn of the conversation as its reference."""
    c = spread(t.conversations.select("conv_id", "turn", "text"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref_text"))
    # texts are shuffled, not their longer arrays of words
    return c.join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("item"), words(F.col("text")).alias("cand"), words(F.col("ref_text")).alias("ref")
    )


REPLIES = f"""turns AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD}') AS ws FROM conversations),
replies AS (SELECT a.conv_id || '-' || a.turn AS item, a.ws AS cand, b.ws AS ref
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),"""
