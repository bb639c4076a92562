"""Readers over files that Spark writes from the given tables: annotation documents, run results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.operators import batching as ba
from scenetally.operators import ordered
from scenetally.operators import vocabulary as vo
from scenetally.operators import votes as vt
from scenetally.plans.files import coco_tables, vcr_rows
from scenetally.plans.pairs import CUT, noun_table
from scenetally.plans.records import D
from scenetally.plans.registry import ORACLES, Tables, query, r
from scenetally.plans.streams import MOST_NOUNS, _folder
from scenetally.plans.views import detections
from scenetally.sources import annotations as sn
from scenetally.sources import logs as lg
from scenetally.sources import records as rc

# ---- annotation documents ----------------------------------------------------------------------------------------

DOCUMENT_IMAGES = 5000
REF_ROWS = 500_000


def annotation_documents(images: DataFrame, anns: DataFrame, cats: DataFrame, path: str) -> None:
    """Annotation files of at most ``DOCUMENT_IMAGES`` images: one compressed JSON document a file, each with all categories."""

    def part(column: str):
        return F.floor(F.col(column) / DOCUMENT_IMAGES).alias("part")

    heads = images.groupBy(part("id")).agg(F.collect_list(F.struct(*images.columns)).alias("images"))
    bodies = anns.groupBy(part("image_id")).agg(F.collect_list(F.struct(*anns.columns)).alias("annotations"))
    every = cats.agg(F.collect_list(F.struct(*cats.columns))).scalar()
    docs = heads.join(bodies, "part", "left").select("images", "annotations", every.alias("categories"))
    docs.write.option("maxRecordsPerFile", 1).json(path, compression="gzip")


@query("coco_json_records", ORACLES["coco_annotation_records"])
def _(t):
    base = _folder(t)
    annotation_documents(*coco_tables(t), f"{base}/coco")
    images, anns, cats = sn.json_tables(t.spark, f"{base}/coco")
    rec = sn.coco_records(images, anns, cats.distinct())
    total = F.aggregate("annotations", F.lit(0).cast("long"), lambda acc, a: acc + a["category_id"])
    kx = F.aggregate("annotations", F.lit(0.0), lambda acc, a: acc + a["keypoints"][0])
    return rec.select("image_id", "file_name", F.size("annotations").cast("long").alias("n"), total.alias("cats"), F.round(kx, 4).alias("kx"))


@query(
    "lvis_annotation_records",
    f"""WITH {D}, k AS (SELECT image_id, count(*) AS n, sum(CASE category WHEN 'A' THEN 6 WHEN 'N' THEN 2 ELSE 10 END) AS cats FROM boxes WHERE y1 <> 0 GROUP BY 1)
    SELECT o_orderkey AS image_id, 'root/' || CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END || '/' || o_orderkey || '.jpg' AS file_name,
      coalesce(n, 0) AS n, coalesce(cats, 0)::BIGINT AS cats, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS negatives, 0 AS not_exhaustive
    FROM orders LEFT JOIN k ON o_orderkey = image_id""",
)
def _(t):
    """Whole polygons only: this format takes no broken one."""
    base = _folder(t)
    _, anns, cats = coco_tables(t)
    folder = F.when(F.col("o_orderstatus") == "F", "val").otherwise("train")
    key = F.col("o_orderkey")
    images = t.orders.select(
        key.alias("id"), F.concat(F.lit("http://images/"), folder, F.lit("/"), key.cast("string"), F.lit(".jpg")).alias("coco_url"),
        F.lit(100).alias("height"), F.lit(200).alias("width"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit(7), F.lit(3))).alias("neg_category_ids"),
    )
    annotation_documents(images, anns.where(F.size(F.col("segmentation")[0]) == 6), cats, f"{base}/lvis")
    tables = sn.json_tables(t.spark, f"{base}/lvis", sn.LVIS_ANNOTATIONS)
    rec = sn.lvis_records(tables[0], tables[1], "root/")
    total = F.aggregate("annotations", F.lit(0).cast("long"), lambda acc, a: acc + a["category_id"])
    return rec.select(
        "image_id", "file_name", F.size("annotations").cast("long").alias("n"), total.alias("cats"),
        F.size("neg_category_ids").alias("negatives"), F.size("not_exhaustive_category_ids").alias("not_exhaustive"),
    )


@query(
    "referring_expressions",
    f"""WITH {D} SELECT image_id, image_id || '.jpg' AS file_name, category AS name, count(*) * 2 AS n_sentences, count(*) * 5 AS n_tokens, round(sum(x2 - x1) * 2, 3) AS width
    FROM boxes WHERE category = 'A' GROUP BY ALL""",
)
def _(t):
    """Every box is referred to twice; the references of the first test part, joined to their boxes, images and categories."""
    base = _folder(t)
    images, anns, cats = coco_tables(t)
    split = F.when(F.col("category_id") == 7, "testA").when(F.col("category_id") == 3, "testB").otherwise("train")

    def said(i: int, text: str):
        return F.struct(
            (F.col("id") * 2 + i).alias("sent_id"), F.lit(text.upper()).alias("raw"), F.lit(text).alias("sent"), F.split(F.lit(text), " ").alias("tokens")
        )

    refs = anns.select(
        F.col("id").alias("ref_id"), F.col("id").alias("ann_id"), "category_id", "image_id", split.alias("split"), F.array(said(0, "left one"), said(1, "the big one")).alias("sentences")
    )
    # a compressed file is read in one piece
    refs.write.option("maxRecordsPerFile", REF_ROWS).json(f"{base}/refs", compression="gzip")
    annotation_documents(images, anns, cats, f"{base}/instances")
    tables = sn.referring_tables(t.spark, f"{base}/refs", f"{base}/instances")
    wanted = sn.select_refs(tables["refs"], categories=[7], split="testA").select("ref_id", "ann_id", "category_id", "image_id")
    boxes = tables["anns"].select(F.col("id").alias("ann_id"), F.col("bbox")[2].alias("w"))
    names = tables["cats"].select(F.col("id").alias("category_id"), "name").distinct()
    said_of = tables["sents"].select("ref_id", F.size("tokens").alias("n"))
    joined = wanted.join(said_of, "ref_id").join(boxes, "ann_id").join(names, "category_id").join(tables["imgs"].select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return joined.groupBy("image_id", "file_name", "name").agg(
        F.count("*").alias("n_sentences"), F.sum("n").alias("n_tokens"), F.round(F.sum("w"), 3).alias("width")
    )


@query(
    "polygon_instances",
    """SELECT (s_suppkey // 50 + 100)::INT AS width, CASE s_nationkey % 3 WHEN 1 THEN 'person' ELSE 'car' END AS category, (s_suppkey % 50 + 1)::DOUBLE AS x1, (s_nationkey + 1)::DOUBLE AS w, 7::DOUBLE AS h, (s_nationkey + 1) * 7 / 2 AS area
    FROM supplier WHERE s_nationkey % 3 <> 0""",
)
def _(t):
    """Fifty suppliers an image; every third nation is road, which is no instance."""
    base = _folder(t)
    x, w = (F.col("s_suppkey") % 50 + 1).cast("double"), (F.col("s_nationkey") + 1).cast("double")
    label = F.element_at(F.array(F.lit("road"), F.lit("person"), F.lit("car")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    ring = F.array(F.array(x, F.lit(2.0)), F.array(x + w, F.lit(2.0)), F.array(x, F.lit(9.0)))
    # a line is no polygon
    shapes = F.array(F.struct(label.alias("label"), ring.alias("polygon")), F.struct(F.lit("car").alias("label"), F.slice(ring, 1, 2).alias("polygon")))
    rows = t.supplier.select(F.floor(F.col("s_suppkey") / 50).alias("image"), F.explode(shapes).alias("o"))
    per = rows.groupBy("image").agg(F.collect_list("o").alias("objects"))
    files = per.select((F.col("image") + 100).cast("int").alias("imgWidth"), F.lit(50).alias("imgHeight"), "objects")
    files.write.option("maxRecordsPerFile", 1).json(f"{base}/polygons")
    images, anns = sn.polygon_files(t.spark, f"{base}/polygons")
    box = F.col("bbox")
    joined = anns.join(images.select(F.col("id").alias("image_id"), "width"), "image_id")
    return joined.select("width", "category", box[0].alias("x1"), box[2].alias("w"), box[3].alias("h"), "area")


@query(
    "proposal_records",
    f"""WITH {D} SELECT o_orderkey::VARCHAR AS image, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, x1, y1, x2, y2) AS rank, x1, y2, score
    FROM boxes JOIN orders ON image_id = o_orderkey WHERE o_orderstatus = 'F'""",
)
def _(t):
    images = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image"))
    rec = rc.proposal_records(detections(t), images, "image_id", "image", ["x1", "y1", "x2", "y2"], "score")
    rows = rec.select("image", F.posexplode(F.arrays_zip("proposal_boxes", "proposal_logits")).alias("i", "p"))
    box = F.col("p.proposal_boxes")
    return rows.select("image", (F.col("i") + 1).cast("long").alias("rank"), box[0].alias("x1"), box[3].alias("y2"), F.col("p.proposal_logits").alias("score"))


# ---- captions and questions --------------------------------------------------------------------------------------


@query("caption_jsonl_ids", ORACLES["caption_jsonl"])
def _(t):
    """The id field names the image, the path something else."""
    base = _folder(t)
    per = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    per.select("id", F.lit("images/0.jpg").alias("img_path"), F.col("s.text").alias("sentences")).write.json(f"{base}/jsonl")
    return rc.caption_jsonl(t.spark, f"{base}/jsonl")


VCR_WORDS = "s AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark)"


@query(
    "vcr_answer_rows",
    f"""WITH {VCR_WORDS}, c AS (SELECT *, (item_id % 4)::INT AS lab FROM s)
    SELECT 'a' || item_id AS annot_id, text AS question, array_to_string(w[lab * len(w) // 4 + 1:(lab + 1) * len(w) // 4], ' ') AS answer, 4 AS n_answers, lab AS target FROM c""",
)
def _(t):
    base = _folder(t)
    vcr_rows(t).write.json(f"{base}/vcr")
    rows = rc.vcr_questions(t.spark, f"{base}/vcr", "answer")
    answer = F.array_join(F.get("answers", F.col("target")), " ")
    return rows.select("annot_id", F.array_join("question", " ").alias("question"), answer.alias("answer"), F.size("answers").alias("n_answers"), "target")


@query(
    "vcr_test_rows",
    f"""WITH {VCR_WORDS}, c AS (SELECT *, unnest(range(4)) AS i FROM s)
    SELECT 'a' || item_id || '-' || i AS annot_id, array_to_string(list_concat(w, ['[SEP]'], w[i * len(w) // 4 + 1:(i + 1) * len(w) // 4]), ' ') AS question, 4 AS n_rationales, NULL::INT AS target FROM c""",
)
def _(t):
    """Without labels every answer is asked about."""
    base = _folder(t)
    vcr_rows(t).drop("answer_label", "rationale_label").write.json(f"{base}/vcr")
    rows = rc.vcr_questions(t.spark, f"{base}/vcr", "rationale", test=True)
    return rows.select("annot_id", F.array_join("question", " ").alias("question"), F.size("answers").alias("n_rationales"), "target")


@query(
    "whole_noun_tokens",
    rf"""WITH {CUT}, l AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(tion|ing)\b', ' #\1', 'g'), '#?{vo.WORD}') AS ws FROM documents),
    e AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM l),
    x AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM e)
    SELECT word, count(*) AS n FROM x SEMI JOIN nouns USING (word) WHERE NOT starts_with(word, '#') AND NOT starts_with(coalesce(nxt, ''), '#') GROUP BY word""",
)
def _(t):
    """As whole_word_tokens, of the noun words only."""
    found = F.when(F.count("*") <= MOST_NOUNS, F.collect_set("word")).otherwise(F.raise_error(F.lit(f"more than {MOST_NOUNS} noun words")))
    nouns = noun_table(t).agg(found).scalar()
    pieces = F.regexp_replace(F.lower("text"), r"(tion|ing)(?![a-zA-Z0-9_])", " #$1")
    tokens = F.regexp_extract_all(pieces, F.lit(f"#?{vo.WORD}"), F.lit(0))
    listed = t.documents.select(tokens.alias("tokens"), nouns.alias("nouns"))
    return vo.word_counts(listed.select(F.explode(vo.whole_word_tokens(F.col("tokens"), F.col("nouns"))).alias("word")))


@query(
    "member_urls",
    """WITH h AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS host, page_id FROM pages), k AS (SELECT *, ('0x' || substr(md5('11|' || host || '|' || page_id), 1, 13))::BIGINT AS h FROM h),
    p AS (SELECT host, arg_min(page_id, h) AS page_id FROM k GROUP BY host) SELECT host, page_id, url FROM p LEFT JOIN pages USING (page_id)""",
)
def _(t):
    """One page of each host with its address."""
    hosts = t.pages.select(F.regexp_extract("url", "//([^/]+)/", 1).alias("host"), "page_id")
    return vt.picked_with_url(hosts, "host", "page_id", t.pages.select("page_id", "url"), "url", seed=11)


# ---- run results and logs ----------------------------------------------------------------------------------------


@query(
    "run_results_csv",
    """SELECT s_nationkey::VARCHAR AS run, 'key' AS metric, s_suppkey::DOUBLE AS value FROM supplier
    UNION ALL SELECT s_nationkey::VARCHAR, 'balance', s_acctbal FROM supplier""",
)
def _(t):
    """A run per nation; the name column holds no number."""
    base = _folder(t)
    rows = t.supplier.select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows.repartition("run").write.partitionBy("run").option("header", True).csv(f"{base}/runs")
    out = lg.run_results(t.spark, f"{base}/runs/*/*.csv", "csv")
    return out.select(F.regexp_replace("run", "^run=", "").alias("run"), "metric", "value")


@query(
    "run_results_nested",
    """SELECT s_name AS run, 'test-dev balance' AS metric, s_acctbal AS value FROM supplier
    UNION ALL SELECT s_name, 'test-dev nation', s_nationkey::DOUBLE FROM supplier UNION ALL SELECT s_name, 'test-std balance', s_acctbal / 2 FROM supplier""",
)
def _(t):
    """Cells of a CSV file that hold lists of objects."""
    base = _folder(t)

    def part(name: str, *values):
        return F.create_map(F.lit(name), F.create_map(*values))

    balance = F.col("s_acctbal")
    cell = F.to_json(F.array(
        part("test-dev", F.lit("balance"), balance, F.lit("nation"), F.col("s_nationkey").cast("double")), part("test-std", F.lit("balance"), balance / 2)
    ))
    t.supplier.select(F.col("s_name").alias("run"), cell.alias("cell")).write.option("header", True).option("escape", '"').csv(f"{base}/cells")
    cells = t.spark.read.schema("run string, cell string").option("header", True).option("escape", '"').csv(f"{base}/cells")
    return lg.nested_results(cells, "run", "cell")


def _logs(t: Tables, lines, path: str) -> DataFrame:
    """A log per event type and day, as text files in event order, read back as lines.

    The number of logs follows the days; a log grows with its day and is split by the reader like any text.
    """
    run = F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd"))
    numbered = ordered.running(
        t.events.select(run.alias("run"), "event_id", "ts", "value"), ["run"], ["event_id"], {"no": ("count", None)}
    )
    rows = numbered.select("run", "event_id", F.posexplode(lines).alias("i", "line"))
    rows.repartition("run").sortWithinPartitions("run", "event_id", "i").select("run", "line").write.partitionBy("run").text(path)
    read = lg.log_lines(t.spark, f"{path}/*/*.txt")
    return read.withColumn("file", F.regexp_extract("file", "run=([^/]+)/", 1))


RUNS = "e AS (SELECT event_type || '-' || strftime(ts, '%Y%m%d') AS run, event_id, ts, value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS no FROM events)"


@query(
    "run_log_files",
    f"""WITH {RUNS}, a AS (SELECT run, (no - 1) // 2 AS c, avg(value) AS s FROM e GROUP BY ALL),
    b AS (SELECT run, arg_max(c, struct_pack(s := s, c := -c)) AS checkpoint, round(max(s), 6) AS score FROM a GROUP BY 1)
    SELECT run, checkpoint, score, '/p/' || checkpoint || '.bin' AS path FROM b""",
)
def _(t):
    """Two workers report a score each after every checkpoint; the path of the best one comes from its own line."""
    base = _folder(t)
    no = F.col("no")
    head = F.when(no == 1, F.lit("args ['--world_size', '2']"))
    saved = F.when(no % 2 == 1, F.concat(F.lit("** ** * Saving fine - tuned model on r in /p/"), F.floor((no - 1) / 2).cast("string"), F.lit(".bin ** ** *")))
    score = F.concat(F.lit("12:00 Validation [x] loss 1.0 score "), F.col("value").cast("string"), F.lit(" "))
    log = lg.run_log(_logs(t, F.array_compact(F.array(head, saved, score)), f"{base}/logs"))
    best = ba.best_checkpoint(ba.log_group_average(log["scores"], "file", lg.ORDER, "score", "world"), "file")
    return best.join(log["checkpoints"], ["file", "checkpoint"]).select(F.col("file").alias("run"), "checkpoint", r("score"), "path")


def _result_lines():
    number = F.col("event_id").cast("string")
    return F.array(
        F.concat(F.lit("Overall training speed: 10 iterations in 0:00:10 ("), number, F.lit(".5 s / it)")),
        F.concat(F.lit("Total inference pure compute time: 0:01 ("), number, F.lit(".25 s / img)")),
        F.concat(F.lit("max_mem: "), number),
        F.concat(F.lit("x copypaste: Task: hour "), F.hour("ts").cast("string")),
        F.lit("x copypaste: AP,AP50"),
        F.concat(F.lit("x copypaste: "), F.col("value").cast("string"), F.lit(","), number),
    )


@query(
    "result_log_speeds",
    f"WITH {RUNS} SELECT run, max(event_id) + 0.5::DOUBLE AS train_s_per_it, max(event_id) + 0.25::DOUBLE AS inference_s_per_it, max(event_id) AS memory_mb FROM e GROUP BY run",
)
def _(t):
    lines = _logs(t, _result_lines(), f"{_folder(t)}/logs")
    return lg.result_log(lines).withColumnRenamed("file", "run")


@query(
    "result_log_metrics",
    f"""WITH {RUNS}, k AS (SELECT run, 'hour ' || hour(ts) AS task, max(event_id) AS last, arg_max(value, event_id) AS v FROM e GROUP BY ALL)
    SELECT run, task, 'AP' AS metric, v AS value FROM k UNION ALL SELECT run, task, 'AP50', last::DOUBLE FROM k""",
)
def _(t):
    """The last block of each task, wherever the reader cut the file."""
    lines = _logs(t, _result_lines(), f"{_folder(t)}/logs")
    return lg.result_log_metrics(lines).withColumnRenamed("file", "run")


@query("latest_run_file", "SELECT o_orderstatus AS run, count(*) AS n FROM orders WHERE o_orderstatus = (SELECT max(o_orderstatus) FROM orders) GROUP BY 1")
def _(t):
    """Three runs written one after the other; the newest file leads to its run, whose rows are counted."""
    base = _folder(t)
    for status in ("F", "O", "P"):
        t.orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").cast("string")).write.text(f"{base}/run={status}")
    newest = lg.latest_file(t.spark, f"{base}/run=*/*.txt").select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("run"))
    lines = t.spark.read.text(f"{base}/run=*/*.txt").select(F.regexp_extract("_metadata.file_path", "run=([^/]+)/", 1).alias("run"))
    return lines.join(newest, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
