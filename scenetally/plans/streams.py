"""Streams over the given tables, drained and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.operators.vocabulary import WORD, words
from scenetally.plans.pairs import CUT, noun_table
from scenetally.plans.registry import Tables, query, r
from scenetally.streaming import streams as st


def _folder(t: Tables) -> str:
    """A new work folder beside the checkpoints the cluster names; a local one in tests only."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/streams-{uuid.uuid4().hex}"
    if not t.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="scenetally-stream-")


def _stream(t: Tables, table: str) -> DataFrame:
    static = getattr(t, table)
    # the file source reads a folder or a glob
    return st.record_stream(t.spark, f"{t.folder}/{table}*.parquet", static.schema)


@query(
    "stream_hourly_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL",
)
def _(t):
    """Every hour with its newest count, also those the watermark has not closed."""
    base = _folder(t)
    st.drain_updates(st.hourly_counts(_stream(t, "events"), "ts"), f"{base}/out", f"{base}/checkpoint", ["hour"])
    out = st.latest_updates(t.spark, f"{base}/out", ["hour"])
    return out.select(F.date_format("hour", "yyyy-MM-dd").alias("day"), F.hour("hour").alias("hour"), "n")


@query(
    "stream_class_average",
    "SELECT event_type, user_id % 10 AS slot, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY ALL",
)
def _(t):
    base = _folder(t)
    ev = _stream(t, "events").withColumn("slot", F.col("user_id") % 10)
    st.drain_updates(st.running_class_average(ev, "event_type", "slot", "value"), f"{base}/out", f"{base}/checkpoint", ["event_type", "slot"])
    out = st.latest_updates(t.spark, f"{base}/out", ["event_type", "slot"])
    return out.select("event_type", "slot", r("avg_value"), "n")


@query(
    "stream_resumed_average",
    "SELECT event_type, user_id % 10 AS slot, round(avg(value), 6) AS avg_value, count(*) AS n, true AS stopped_between FROM events GROUP BY ALL",
)
def _(t):
    """Eight files taken two at a time, stopped after the first batch or two, then resumed: no row is lost or counted twice."""
    base = _folder(t)
    t.events.select("event_type", "user_id", "value").repartition(8).write.parquet(f"{base}/in")
    stream = st.record_stream(t.spark, f"{base}/in", t.spark.read.parquet(f"{base}/in").schema, files_per_trigger=2)
    averages = st.running_class_average(stream.withColumn("slot", F.col("user_id") % 10), "event_type", "slot", "value")
    keys = ["event_type", "slot"]
    st.drain_updates(averages, f"{base}/out", f"{base}/checkpoint", keys, batches=1)
    first = st.latest_updates(t.spark, f"{base}/out", keys).agg(F.sum("n").alias("n"))
    rows_then = first.first().n
    st.drain_updates(averages, f"{base}/out", f"{base}/checkpoint", keys)
    out = st.latest_updates(t.spark, f"{base}/out", keys)
    whole = out.agg(F.sum("n")).scalar()
    return out.select("event_type", "slot", r("avg_value"), "n", (F.lit(rows_then) < whole).alias("stopped_between"))


@query(
    "stream_pair_counts",
    f"""WITH s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS l FROM benchmark), e AS (SELECT item_id, unnest(l) AS w FROM s)
    SELECT a.w AS hi, b.w AS lo, count(*) AS n FROM e a JOIN e b ON a.item_id = b.item_id AND a.w >= b.w GROUP BY ALL""",
)
def _(t):
    """All words of every item."""
    base = _folder(t)
    docs = _stream(t, "benchmark").select(words(F.col("text")).alias("items"))
    st.drain_updates(st.pair_counts(docs, "items"), f"{base}/out", f"{base}/checkpoint", ["hi", "lo"])
    return st.latest_updates(t.spark, f"{base}/out", ["hi", "lo"])


MOST_NOUNS = 100_000


@query(
    "stream_noun_pair_counts",
    f"""WITH {CUT}, s AS (SELECT DISTINCT doc_id, word FROM doc_words SEMI JOIN nouns USING (word))
    SELECT a.word AS hi, b.word AS lo, count(*) AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.word >= b.word GROUP BY ALL""",
)
def _(t):
    """The noun words of every document."""
    base = _folder(t)
    # one row: the frequent words that make up 30 % of the tokens are few, which is checked before they are broadcast
    found = F.collect_set("word")
    nouns = noun_table(t).agg(F.when(F.count("*") <= MOST_NOUNS, found).otherwise(F.raise_error(F.lit(f"more than {MOST_NOUNS} noun words"))).alias("nouns"))
    docs = _stream(t, "documents").select(F.array_distinct(words(F.col("text"))).alias("found")).crossJoin(F.broadcast(nouns))
    st.drain_updates(st.pair_counts(docs.select(F.array_intersect("found", "nouns").alias("items")), "items"), f"{base}/out", f"{base}/checkpoint", ["hi", "lo"])
    return st.latest_updates(t.spark, f"{base}/out", ["hi", "lo"])


@query(
    "stream_metric_history",
    """WITH w AS (SELECT event_type AS series, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events)
    SELECT series, max(event_id) AS iteration, max(value) FILTER (rn = 1) AS latest, list_sort(list(value))[(count(*) + 1) // 2] AS median, round(avg(value), 9) AS window_mean FROM w WHERE rn <= 20 GROUP BY 1""",
)
def _(t):
    base = _folder(t)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, st.STATE_STORE)
    try:
        history = st.metric_history(_stream(t, "events"), "event_type", "event_id", "value")
        st.drain_updates(history, f"{base}/out", f"{base}/checkpoint", ["series"])
    finally:
        t.spark.conf.set(provider, before)
    return st.latest_updates(t.spark, f"{base}/out", ["series"]).select("series", "iteration", "latest", "median", r("window_mean", 9))


@query(
    "stream_bucket_batches",
    """WITH o AS (SELECT CASE WHEN o_totalprice > 250000 THEN 'tall' ELSE 'wide' END AS bucket, ('0x' || substr(md5('0|' || o_orderkey), 1, 13))::BIGINT % 4 AS lane, o_orderkey AS id FROM orders),
    l AS (SELECT bucket, lane, count(*) AS lane_rows, sum(id)::BIGINT AS lane_ids FROM o GROUP BY ALL),
    b AS (SELECT *, unnest(range((lane_rows + 31) // 32)) AS batch FROM l)
    SELECT bucket, lane, batch, least(32, lane_rows - 32 * batch) AS n, lane_rows - 32 * batch >= 32 AS full, lane_rows, lane_rows AS lane_distinct, lane_ids FROM b""",
)
def _(t):
    """Orders in two buckets by price, sent on in batches of 32; the last of a lane may hold fewer."""
    base = _folder(t)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, st.STATE_STORE)
    try:
        bucket = F.when(F.col("o_totalprice") > 250000, "tall").otherwise("wide")
        st.drain_idle(st.bucket_batches(_stream(t, "orders"), bucket, "o_orderkey", 32, lanes=4, linger_ms=0), f"{base}/out", f"{base}/checkpoint")
    finally:
        t.spark.conf.set(provider, before)
    sent = t.spark.read.parquet(f"{base}/out")
    lanes = sent.groupBy("bucket", "lane").agg(
        F.count("*").alias("lane_rows"), F.count_distinct("id").alias("lane_distinct"), F.sum("id").alias("lane_ids")
    )
    return sent.groupBy("bucket", "lane", "batch", "full").agg(F.count("*").alias("n")).join(lanes, ["bucket", "lane"])


@query(
    "stream_mixture",
    f"""SELECT 0 AS source_no, o_orderkey AS id FROM orders WHERE ('0x' || substr(md5('6|0|' || o_orderkey), 1, 13))::BIGINT / {2**52} < 1.0
    UNION ALL SELECT 1, c_custkey FROM customer WHERE ('0x' || substr(md5('6|1|' || c_custkey), 1, 13))::BIGINT / {2**52} < 0.5""",
)
def _(t):
    base = _folder(t)
    a = _stream(t, "orders").select(F.col("o_orderkey").alias("id"))
    b = _stream(t, "customer").select(F.col("c_custkey").alias("id"))
    st.drain(st.mixed_streams([(a, 1.0), (b, 0.5)], "id", 6), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").select("source_no", "id")
