"""Readers and streams on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from scenetally.operators import batching as ba
from scenetally.sources import annotations as sn
from scenetally.sources import logs as lg
from scenetally.sources import records as rc
from scenetally.streaming import streams as st


def write_json(path, value):
    path.write_text(json.dumps(value))
    return str(path)


ANNS = [
    {"id": 1, "image_id": 1, "category_id": 18, "bbox": [0, 0, 2, 2], "area": 4, "iscrowd": 0, "segmentation": [[0, 0, 1, 0, 1, 1]], "keypoints": [1, 2, 2]},
    {"id": 2, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4, "iscrowd": 0, "segmentation": [[0, 0, 1, 0]]},
]
DOC = {
    "images": [{"id": 1, "file_name": "a.jpg", "coco_url": "http://x/train/a.jpg", "height": 4, "width": 5, "neg_category_ids": [2]}, {"id": 2, "file_name": "b.jpg", "coco_url": "http://x/val/b.jpg", "height": 4, "width": 5}],
    "annotations": ANNS,
    "categories": [{"id": 18, "name": "dog"}, {"id": 3, "name": "car"}],
}


def test_coco_and_lvis(spark, tmp_path):
    tables = sn.json_tables(spark, write_json(tmp_path / "c.json", DOC))
    rows = {r.image_id: r for r in sn.coco_records(*tables).collect()}
    assert len(rows[2].annotations) == 0 and [a.id for a in rows[1].annotations] == [1]
    assert rows[1].annotations[0].category_id == 1 and rows[1].annotations[0].keypoints == [1.5, 2.5, 2.0]
    with pytest.raises(ValueError, match="broken polygon"):
        sn.lvis_records(tables[0], tables[1], "root/")
    good = tables[1].where("id = 1")
    lvis = {r.image_id: r for r in sn.lvis_records(tables[0], good, "root/").collect()}
    assert lvis[1].file_name == "root/train/a.jpg" and lvis[1].neg_category_ids == [2] and lvis[2].neg_category_ids == []
    assert lvis[1].annotations[0].category_id == 17
    with pytest.raises(ValueError, match="not unique"):
        sn.coco_records(tables[0], tables[1].unionByName(tables[1]), tables[2])


def test_referring(spark, tmp_path):
    ref = {"ref_id": 5, "ann_id": 1, "category_id": 18, "image_id": 1, "split": "testAB", "sentences": [{"sent_id": 9, "raw": "R", "sent": "r", "tokens": ["r"]}]}
    tables = sn.referring_tables(spark, write_json(tmp_path / "r.json", ref), write_json(tmp_path / "c.json", DOC))
    assert tables["sents"].first().sent_id == 9
    assert sn.select_refs(tables["refs"], split="testA").count() == 1 and sn.select_refs(tables["refs"], split="testC").count() == 0
    assert [r.id for r in sn.select_annotations(tables["anns"], tables["refs"], images=[1], ref_ids=[5]).collect()] == [1]


def test_polygons(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 3], [0, 3]]
    for name, label in (("b_polygons.json", "car"), ("a_polygons.json", "road")):
        write_json(tmp_path / name, {"imgWidth": 10, "imgHeight": 8, "objects": [{"label": label, "polygon": square}]})
    images, anns = sn.polygon_files(spark, str(tmp_path))
    assert [r.file_name for r in images.orderBy("id").collect()] == ["a", "b"]
    row = anns.collect()
    assert len(row) == 1 and (row[0].image_id, row[0].bbox, row[0].area) == (1, [0, 0, 4, 3], 12.0)


def test_paired_files(spark, tmp_path):
    for folder, names in (("img", ["a.jpg", "b.jpg"]), ("lab", ["b_gt.png", "c_gt.png"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    got = sn.paired_files(spark, str(tmp_path / "img"), str(tmp_path / "lab"), ".jpg", ".png", "_gt").collect()
    assert [r.stem for r in got] == ["b"]


def test_vcr_test_mode(spark, tmp_path):
    row = {"img_id": "i", "annot_id": "test-3", "question": ["q"], "answer_choices": [["a"], ["b"]], "rationale_choices": [["r"]]}
    got = rc.vcr_questions(spark, write_json(tmp_path / "v.json", row), "rationale", test=True).orderBy("annot_id").collect()
    assert [r.question for r in got] == [["q", "[SEP]", "a"], ["q", "[SEP]", "b"]]


def test_question_without_target(spark):
    q = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "question_id long, image_id long, question string")
    with pytest.raises(Exception, match="without target"):
        rc.question_answers(q, q.where("question_id = 1").select("question_id", "image_id", F.lit(1).alias("label"))).collect()


def test_crowd_list_literals(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("Unnamed: 0\tanswers\tnote\nx // y\t['it's', None, 'b']\tz\n")
    row = rc.crowd_responses(spark, str(tmp_path / "r.tsv"), ["answers"]).first()
    assert row.pair == "x // y" and row.answers == ["it's", None, "b"]


def test_result_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "Overall training speed: 10 iterations in 0:00:10 (0.5 s / it)\nTotal inference pure compute time: 0:01 (0.06 s / img)\n"
        "max mem: 4161\nx copypaste: Task: bbox\nx copypaste: AP,AP50\nx copypaste: 1.0,2.0\nmax_mem: 5000\n"
        "x copypaste: Task: bbox\nx copypaste: AP,AP50\nx copypaste: 3.0,4.0\n"
    )
    row = lg.result_log(lg.log_lines(spark, str(tmp_path))).first()
    assert (row.train_s_per_it, row.inference_s_per_it, row.memory_mb) == (0.5, 0.06, 5000)
    assert {r.metric: r.value for r in lg.result_log_metrics(lg.log_lines(spark, str(tmp_path))).collect()} == {"AP": 3.0, "AP50": 4.0}


def test_run_log(spark, tmp_path):
    lines = ["args ['--world_size', '2']"]
    for i in range(3):
        lines += [f"** ** * Saving fine - tuned model on r in /p/{i}.bin ** ** *"] + [f"1:00 Validation [{k}] score {i + k}.5 \\n" for k in range(2)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    log = lg.run_log(lg.log_lines(spark, str(tmp_path)))
    best = ba.best_checkpoint(ba.log_group_average(log["scores"], "file", lg.ORDER, "score", "world"), "file")
    row = best.join(log["checkpoints"], ["file", "checkpoint"]).first()
    assert (row.path, row.score) == ("/p/2.bin", 3.0)


def test_logs_cut_into_blocks(spark, tmp_path):
    """The last block of a task and the i-th checkpoint are found wherever the reader cuts the file."""
    lines = ["args ['--world_size', '1']"]
    for i in range(200):
        lines += [f"x copypaste: Task: t{i % 3}", "x copypaste: AP,AP50", f"x copypaste: {i}.0,{i}.5", f"max_mem: {i}"]
        lines += [f"** ** * Saving fine - tuned model on r in /p/{i}.bin ** ** *", f"1:00 Validation [0] score {(i * 7) % 200}.0 "]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        read = lg.log_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 4
        got = {(r.task, r.metric): r.value for r in lg.result_log_metrics(read).collect()}
        memory = lg.result_log(read).first().memory_mb
        log = lg.run_log(read)
        best = ba.best_checkpoint(ba.log_group_average(log["scores"], "file", lg.ORDER, "score", "world"), "file")
        row = best.join(log["checkpoints"], ["file", "checkpoint"]).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    last = {"t0": 198, "t1": 199, "t2": 197}
    assert got == {(t, m): v + add for t, v in last.items() for m, add in (("AP", 0.0), ("AP50", 0.5))}
    wanted = next(i for i in range(200) if (i * 7) % 200 == 199)
    assert memory == 199 and (row.path, row.score) == (f"/p/{wanted}.bin", 199.0)


def test_run_results_csv_and_latest(spark, tmp_path):
    for run, v in (("r1", 1.5), ("r2", 2.5)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "m.csv").write_text(f"a,b\n{v},x\n")
    got = {(r.run, r.metric): r.value for r in lg.run_results(spark, str(tmp_path / "*" / "m.csv"), "csv").collect()}
    assert got == {("r1", "a"): 1.5, ("r2", "a"): 2.5}
    assert lg.latest_file(spark, str(tmp_path / "*" / "m.csv")).first().path.endswith("m.csv")
    cells = spark.createDataFrame([("r", '[{"test-dev": {"overall": 71.5}}]')], "run string, cell string")
    assert lg.nested_results(cells, "run", "cell").first().metric == "test-dev overall"


def test_word_list_synonyms(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Dog,Puppy\ncat\n")
    got = {r.word: r.word_id for r in rc.word_list(spark, str(tmp_path / "c.txt"), "__background__").collect()}
    assert got == {"__background__": 0, "dog": 1, "puppy": 1, "cat": 2}


SCHEMA = "event_id long, ts timestamp_ntz, name string, value double"


def feed(spark, folder, start, stop, hour):
    rows = spark.range(start, stop).selectExpr("id AS event_id", f"timestamp_ntz'2024-01-01 0{hour}:00:00' AS ts", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS name", "CAST((id * 7) % 13 AS DOUBLE) AS value")
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_history_goes_on_after_restart(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, st.STATE_STORE)
    try:
        folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
        for start, stop in ((0, 70), (70, 150)):
            feed(spark, folder, start, stop, 1)
            history = st.metric_history(st.record_stream(spark, folder, SCHEMA, 1), "name", "event_id", "value")
            st.drain_updates(history, out, check, ["series"])
    finally:
        spark.conf.set(provider, before)
    got = {r.series: r for r in st.latest_updates(spark, out, ["series"]).collect()}
    batch = ba.windowed_history(spark.read.parquet(folder), ["name"], ["event_id"], "value")
    for r in batch.where("event_id IN (147, 149)").collect():
        assert (got[r.name].median, got[r.name].iteration, got[r.name].latest) == (r["median"], r.event_id, r.value)
        assert got[r.name].window_mean == pytest.approx(r.window_mean)


def test_late_rows_and_resume(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for start, stop, hour in ((0, 10, 1), (10, 20, 5), (20, 25, 1), (25, 30, 8)):
        feed(spark, folder, start, stop, hour)
        st.drain(st.hourly_counts(st.record_stream(spark, folder, SCHEMA), "ts"), out, check)
    got = {r.hour.hour: r.n for r in spark.read.parquet(out).collect()}
    # the five rows that came hours too late are not counted, the last hour is still open
    assert got == {1: 10, 5: 10}


def test_bucket_batches_are_full(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, st.STATE_STORE)
    try:
        folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
        for start, stop in ((0, 10), (10, 25)):
            feed(spark, folder, start, stop, 1)
            st.drain(st.bucket_batches(st.record_stream(spark, folder, SCHEMA), "name", "event_id", 4), out, check)
    finally:
        spark.conf.set(provider, before)
    rows = spark.read.parquet(out)
    assert {r["n"] for r in rows.groupBy("bucket", "batch").agg(F.count("*").alias("n")).collect()} == {4}
    assert rows.select("id").distinct().count() == rows.count() == 8 + 16


def test_bucket_batches_flush(spark, tmp_path):
    """Every row comes out: full batches, and the rest of each lane when the stream ends, also over a restart."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, st.STATE_STORE)
    try:
        folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
        for start, stop in ((0, 10), (10, 25)):
            feed(spark, folder, start, stop, 1)
            batches = st.bucket_batches(st.record_stream(spark, folder, SCHEMA), "name", "event_id", 4, lanes=2, linger_ms=0)
            st.drain_idle(batches, out, check)
            assert sorted(r.id for r in spark.read.parquet(out).collect()) == [i for i in sorted(range(stop)) for _ in range(spark.read.schema(SCHEMA).parquet(folder).where(f"event_id = {i}").count())]
    finally:
        spark.conf.set(provider, before)
    sizes = spark.read.parquet(out).groupBy("bucket", "lane", "batch", "full").agg(F.count("*").alias("n")).collect()
    assert all(r["n"] == 4 if r["full"] else r["n"] < 4 for r in sizes) and any(not r["full"] for r in sizes)
    numbers = {}
    for r in sizes:
        numbers.setdefault((r["bucket"], r["lane"]), []).append(r["batch"])
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
