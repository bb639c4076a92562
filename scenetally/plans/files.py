"""File formats: the given tables written out by Spark in each format and read back by the readers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from scenetally.operators import batching as ba
from scenetally.operators import cooccurrence as co
from scenetally.plans.pairs import PAIR_COUNTS, baskets
from scenetally.plans.registry import Tables, query, r
from scenetally.plans.records import D, annotated
from scenetally.plans.streams import _folder
from scenetally.plans.views import detections
from scenetally.sources import annotations as sn
from scenetally.sources import logs as lg
from scenetally.sources import records as rc
from scenetally.sources import writers as wr


@query(
    "captions_tsv",
    "SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption, url, 'pages' AS folder FROM pages",
)
def _(t):
    base = _folder(t)
    rows = t.pages.select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"), "url")
    rows.select(F.concat_ws("\t", "caption", "url").alias("value")).write.text(f"{base}/tsv")
    return rc.captions_tsv(t.spark, f"{base}/tsv", "pages")


@F.pandas_udf(BinaryType())
def _blob(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.asarray(v, dtype="<f4").tobytes())


@query(
    "region_tsv",
    """WITH e AS (SELECT vec_id // 8 AS image, vec_id % 8 AS region, embedding AS v, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS i FROM embeddings)
    SELECT image::VARCHAR AS image_id, i::INT AS region, round(v[1]::DOUBLE, 6) AS first, round(v[64]::DOUBLE, 6) AS last, 64 AS width FROM e""",
)
def _(t):
    base = _folder(t)
    flat = t.embeddings.groupBy(F.floor(F.col("vec_id") / 8).alias("image")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    blob = F.regexp_replace(F.base64(_blob(F.flatten("e.embedding"))), r"\s", "")
    rows = flat.select(F.col("image").cast("string").alias("i"), F.lit("640").alias("w"), F.lit("480").alias("h"), F.size("e").cast("string").alias("n"), blob.alias("f"))
    rows.select(F.concat_ws("\t", "i", "w", "h", "n", "f", "f", "f").alias("value")).write.text(f"{base}/tsv")
    read = rc.region_tsv(t.spark, f"{base}/tsv").select("image_id", F.posexplode("features").alias("region", "f"))
    return read.select(
        "image_id", "region", F.round(F.col("f")[0].cast("double"), 6).alias("first"), F.round(F.element_at("f", -1).cast("double"), 6).alias("last"), F.size("f").alias("width")
    )


@query("sharded_records", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    base = _folder(t)
    wr.sharded_write(t.orders.select("o_orderkey", "o_totalprice"), f"{base}/shards", 4, ["o_orderkey"])
    return rc.sharded_records(t.spark, [f"{base}/shards"]).select("o_orderkey", "o_totalprice")


@query(
    "caption_jsonl",
    """WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations)
    SELECT conv_id AS image_id, i::INT AS caption_no, text AS caption FROM p""",
)
def _(t):
    base = _folder(t)
    per = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    rows = per.select("id", F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".jpg")).alias("img_path"), F.col("s.text").alias("sentences"))
    rows.write.json(f"{base}/jsonl")
    return rc.caption_jsonl(t.spark, f"{base}/jsonl", id_from_stem=True)


@query(
    "question_answer_join",
    "SELECT conv_id * 100 + turn AS question_id, conv_id AS image_id, md5(text) AS question, length(text) AS label FROM conversations",
)
def _(t):
    base = _folder(t)
    q = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("conv_id").alias("image_id"), F.md5("text").alias("question"))
    # one JSON document a file, of at most 500 conversations
    docs = q.groupBy(F.floor(F.col("image_id") / 500).alias("part")).agg(F.collect_list(F.struct("question_id", "image_id", "question")).alias("questions"))
    docs.select("questions").write.option("maxRecordsPerFile", 1).json(f"{base}/questions")
    targets = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("conv_id").alias("image_id"), F.length("text").cast("long").alias("label"))
    return rc.question_answers(rc.questions_json(t.spark, f"{base}/questions"), targets).select("question_id", "image_id", "question", "label")


@query(
    "vcr_rationale_rows",
    """WITH s AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), c AS (SELECT item_id, w, (item_id % 4)::INT AS lab FROM s),
    p AS (SELECT *, lab * len(w) // 4 + 1 AS lo, (lab + 1) * len(w) // 4 AS hi FROM c)
    SELECT 'a' || item_id AS annot_id, array_to_string(list_concat(w, ['[SEP]'], w[lo:hi]), ' ') AS question, lab AS target FROM p""",
)
def _(t):
    base = _folder(t)
    vcr_rows(t).write.json(f"{base}/vcr")
    return rc.vcr_questions(t.spark, f"{base}/vcr", "rationale").select("annot_id", F.array_join("question", " ").alias("question"), "target")


def vcr_rows(t: Tables) -> DataFrame:
    """Benchmark items as questions whose own words, in four pieces, are the answers and the rationales."""
    w = F.split("text", " ")
    # the whole text in four pieces
    cut = [F.floor(F.size(w) * i / 4).cast("int") for i in range(5)]
    choices = F.array(*[F.slice(w, cut[i] + 1, cut[i + 1] - cut[i]) for i in range(4)])
    return t.benchmark.select(
        F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("img_id"), F.concat(F.lit("a"), F.col("item_id").cast("string")).alias("annot_id"), w.alias("question"),
        choices.alias("answer_choices"), (F.col("item_id") % 4).cast("int").alias("answer_label"), choices.alias("rationale_choices"), (F.col("item_id") % 4).cast("int").alias("rationale_label"),
    )


def coco_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as images, lines as annotations with a rectangle for a polygon (broken for the thinnest discounts)."""
    from scenetally.operators.ordered import positions

    b = positions(detections(t), [], ["det_id"], "id")
    ring = F.array("x1", "y1", "x2", "y1", "x2", "y2")
    cat = F.when(F.col("category") == "A", 7).when(F.col("category") == "N", 3).otherwise(11)
    anns = b.select(
        "id", F.col("image_id"), cat.alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"),
        F.lit(0).alias("iscrowd"), F.array(F.when(F.col("y1") == 0, F.slice(ring, 1, 4)).otherwise(ring)).alias("segmentation"), F.array("x1", "y1", F.lit(2.0)).alias("keypoints"),
    )
    images = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(100).alias("height"), F.lit(200).alias("width"))
    cats = t.lineitem.select("l_returnflag").distinct().select(
        F.when(F.col("l_returnflag") == "A", 7).when(F.col("l_returnflag") == "N", 3).otherwise(11).alias("id"), F.col("l_returnflag").alias("name")
    )
    return images, anns, cats


@query(
    "coco_annotation_records",
    f"""WITH {D}, k AS (SELECT image_id, count(*) AS n, sum(CASE category WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS cats, sum(x1 + 0.5) AS kx FROM boxes WHERE y1 <> 0 GROUP BY 1)
    SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file_name, coalesce(n, 0) AS n, coalesce(cats, 0)::BIGINT AS cats, round(coalesce(kx, 0), 4) AS kx FROM orders LEFT JOIN k ON o_orderkey = image_id""",
)
def _(t):
    rec = sn.coco_records(*coco_tables(t))
    total = F.aggregate("annotations", F.lit(0).cast("long"), lambda acc, a: acc + a["category_id"])
    kx = F.aggregate("annotations", F.lit(0.0), lambda acc, a: acc + a["keypoints"][0])
    return rec.select("image_id", "file_name", F.size("annotations").cast("long").alias("n"), total.alias("cats"), F.round(kx, 4).alias("kx"))


@query(
    "coco_export_rows",
    f"""WITH {D} SELECT row_number() OVER (ORDER BY image_id, det_id, category, x1, y1, x2, y2, score) AS id, image_id, category AS category_id, round((x2 - x1) * (y2 - y1), 3) AS area, x2 - x1 AS w, x1 - 0.5 AS kx FROM boxes""",
)
def _(t):
    rows = wr.coco_rows(annotated(t), "image_id", "annotations")
    return rows.select("id", "image_id", "category_id", F.round("area", 3).alias("area"), F.col("bbox")[2].alias("w"), F.col("keypoints")[0].alias("kx"))


XML_IMAGES = 50_000
# text of the files is some ten times a table as Parquet; of a table beyond this many bytes it is compressed
XML_PLAIN_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of a scanned table as Spark plans with it, before columns are left out."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@query(
    "voc_xml",
    f"""WITH {D} SELECT image_id::VARCHAR AS image_id, category, x1 - 1 AS x1, y2 FROM boxes""",
)
def _(t):
    base = _folder(t)
    box = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    rows = detections(t).groupBy("image_id").agg(F.collect_list(F.struct(F.col("category").alias("name"), F.lit(0).alias("difficult"), box.alias("bndbox"))).alias("object"))
    out = rows.select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("filename"), F.struct(F.lit(200).alias("width"), F.lit(100).alias("height")).alias("size"), "object")
    # a file is read in one piece, compressed or not; without an indent it is half as long
    codec = "gzip" if table_bytes(t.lineitem) > XML_PLAIN_BYTES else "none"
    writer = out.write.format("xml").option("maxRecordsPerFile", XML_IMAGES).option("indent", "").option("compression", codec)
    writer.option("rowTag", "annotation").option("rootTag", "annotations").save(f"{base}/xml")
    return sn.voc_xml(t.spark, f"{base}/xml").select("image_id", "category", "x1", "y2")


@query(
    "crowd_response_lists",
    """SELECT user_id || '/' || strftime(ts, '%Y-%m-%d %H') AS pair, string_agg(event_type || '''s', '|' ORDER BY event_id) AS answers, count(*)::INT AS n FROM events GROUP BY 1""",
)
def _(t):
    base = _folder(t)
    # answers of one user in one hour, so a list does not grow with the table
    pair = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd HH")).alias("pair")
    per = t.events.groupBy(pair).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    literal = F.concat(F.lit("["), F.array_join(F.transform("e.event_type", lambda v: F.concat(F.lit("'"), v, F.lit("'s'"))), ", "), F.lit(", None]"))
    lines = per.select(F.concat_ws("\t", "pair", literal).alias("value"))
    lines.write.text(f"{base}/tsv")
    raw = t.spark.read.csv(f"{base}/tsv", sep="\t", schema="pair string, cause_directions string", quote="")
    read = raw.withColumn("answers", rc.literal_list(F.col("cause_directions")))
    given = F.filter("answers", lambda a: a.isNotNull())
    return read.select("pair", F.array_join(given, "|").alias("answers"), F.size(given).alias("n"))


@query("metrics_json", "SELECT event_type AS name, event_id AS iteration, value FROM events")
def _(t):
    base = _folder(t)
    t.events.select(F.lit("r0").alias("run"), F.col("event_type").alias("name"), F.col("event_id").alias("iteration"), "value").write.json(f"{base}/json")
    return lg.metrics_json(t.spark, f"{base}/json").select("name", "iteration", "value")


@query(
    "word_list",
    """SELECT lower(p_brand) AS word, row_number() OVER (ORDER BY p_brand) AS word_id FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'background', 0""",
)
def _(t):
    base = _folder(t)
    # a class list is one small file by nature
    t.part.select("p_brand").distinct().orderBy("p_brand").coalesce(1).write.text(f"{base}/classes")
    return rc.word_list(t.spark, f"{base}/classes/*.txt", "background").select("word", F.col("word_id").cast("long").alias("word_id"))


@query(
    "run_results_json",
    "SELECT (s_suppkey // 25)::VARCHAR AS run, s_name AS metric, s_acctbal AS value FROM supplier",
)
def _(t):
    base = _folder(t)
    # runs of at most 25 suppliers: their number grows with the table, their size does not
    per = t.supplier.groupBy(F.floor(F.col("s_suppkey") / 25).alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("s_name", "s_acctbal"))).alias("m"))
    per.select("run", F.to_json("m").alias("value")).repartition("run").write.partitionBy("run").text(f"{base}/runs")
    out = lg.run_results(t.spark, f"{base}/runs/*/*.txt", "json")
    return out.select(F.regexp_replace("run", "^run=", "").alias("run"), "metric", "value")


@query(
    "run_log_best_checkpoint",
    """WITH p AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS c FROM events),
    a AS (SELECT user_id, c, avg(value) AS s FROM p GROUP BY ALL)
    SELECT user_id::VARCHAR AS run, arg_max(c, struct_pack(s := s, c := -c)) AS checkpoint, round(max(s), 6) AS score FROM a GROUP BY 1""",
)
def _(t):
    score = F.concat(F.lit("12:00 Validation [x] loss 1.0 score "), F.col("value").cast("string"), F.lit(" "))
    lines = t.events.select(F.concat(F.lit("run="), "user_id").alias("file"), F.lit(0).alias("block"), F.col("event_id").alias("line"), score.alias("value"))
    head = lines.groupBy("file").agg(F.lit(0).alias("block"), F.lit(-1).cast("long").alias("line"), F.lit("args ['--world_size', '2']").alias("value"))
    log = lg.run_log(lines.unionByName(head))
    best = ba.best_checkpoint(ba.log_group_average(log["scores"], "file", lg.ORDER, "score", "world"), "file")
    return best.select(F.regexp_extract("file", r"run=(\d+)", 1).alias("run"), "checkpoint", r("score"))


@query(
    "per_class_detection_lines",
    f"""WITH {D} SELECT category AS class, printf('%d %.3f %.1f %.1f %.1f %.1f', image_id, round(score, 3), x1 + 1, y1 + 1, x2 + 1, y2 + 1) AS value FROM boxes""",
)
def _(t):
    base = _folder(t)
    rounded = detections(t).withColumn("score", F.round("score", 3))
    wr.per_class_detections(rounded, "image_id", "category", "score", f"{base}/dets")
    return t.spark.read.text(f"{base}/dets").select("class", "value")


@query(
    "caption_reference_export",
    """WITH r AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, list_filter(string_split(text, '. '), lambda s : s <> '') AS l FROM documents WHERE lang <> 'en'))
    SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS id, doc_id AS image_id, s AS caption FROM r""",
)
def _(t):
    sentences = F.filter(F.split("text", r"\. "), lambda s: s != "")
    docs = t.documents.select(
        "doc_id", F.when(F.col("lang") == "en", "train").otherwise("val").alias("split"), F.transform(sentences, lambda s: F.split(s, " ")).alias("sentences")
    )
    return wr.caption_references(docs, "doc_id", "split", "sentences")


@query("tsv_round_trip", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def _(t):
    base = _folder(t)
    wr.tsv_write(t.part.select("p_partkey", "p_name"), f"{base}/tsv")
    return t.spark.read.csv(f"{base}/tsv", sep="\t", header=True, lineSep="\r\n")


@query(
    "prediction_json",
    "SELECT user_id AS question_id, arg_max(event_type, struct_pack(v := value, e := event_id)) AS answer FROM events GROUP BY 1",
)
def _(t):
    base = _folder(t)
    best = t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("answer"))
    wr.predictions_json(best, "user_id", f"{base}/json", ["answer"])
    return t.spark.read.schema("question_id long, answer string").json(f"{base}/json")


@query(
    "top_predictions_json",
    """WITH s AS (SELECT user_id, event_type || '-' || hour(ts) AS answer, round(avg(value), 6) AS score FROM events GROUP BY ALL),
    p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY user_id)) AS e FROM s),
    q AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS probability, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, answer) AS rank FROM p)
    SELECT user_id AS question_id, rank, answer, round(probability, 6) AS probability FROM q WHERE rank <= 8""",
)
def _(t):
    """A user is a question, an event type and hour an answer, its mean value the score."""
    base = _folder(t)
    answer = F.concat_ws("-", "event_type", F.hour("ts"))
    scores = t.events.groupBy("user_id", answer.alias("answer")).agg(F.round(F.avg("value"), 6).alias("score"))
    wr.top_predictions_json(scores, "user_id", "answer", "score", f"{base}/json")
    lines = t.spark.read.schema("question_id long, answers array<struct<rank: long, answer: string, probability: double>>").json(f"{base}/json")
    return lines.select("question_id", F.explode("answers").alias("a")).select("question_id", "a.rank", "a.answer", F.round("a.probability", 6).alias("probability"))


@query("matrix_round_trip", f"WITH {PAIR_COUNTS} SELECT hi, lo, n FROM pairs")
def _(t):
    """The pair matrix of order baskets, written in long form and read back."""
    base = _folder(t)
    wr.matrix_write(co.set_cooccurrence(baskets(t), "record", "item"), f"{base}/matrix")
    return t.spark.read.parquet(f"{base}/matrix")


@query("catalogued_dataset", "SELECT count(*) AS n, 'order brands' AS title FROM part")
def _(t):
    rc.register(t.spark, "scenetally_parts", t.part, title="order brands")
    title = rc.properties_of(t.spark, "scenetally_parts")["title"]
    return t.spark.table("scenetally_parts").agg(F.count("*").alias("n")).withColumn("title", F.lit(title))
