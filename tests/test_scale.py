"""Small cases behind the findings on whole work and growth."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from scenetally.operators import captions as ca
from scenetally.operators import detection as de
from scenetally.operators import grams as gr
from scenetally.operators import matching as ma
from scenetally.operators import ordered
from scenetally.operators import traces as tr
from scenetally.operators import vectors as ve
from scenetally.operators import vocabulary as vo
from scenetally.plans import files, readers, registry
from scenetally.sources import annotations as sn


def test_box_geometry_large_asks_for_both_sides(spark, tmp_path):
    rows = [(1, 1, 1, 1, 2.0, 100.0, 0.0, 0.02, "A", "F"), (1, 3, 1, 1, 2.0, 100.0, 0.0, 0.02, "A", "F"), (1, 3, 2, 1, 2.0, 100.0, 0.0, 0.05, "A", "F"), (1, 2, 3, 1, 2.0, 100.0, 0.0, 0.05, "A", "F")]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry_module.queries()["box_geometry"](spark, str(tmp_path))
    assert {(r.w, r.h): r.large for r in out.collect()} == {(50.0, 34.0): False, (50.0, 42.0): False, (65.0, 42.0): True, (65.0, 38.0): False}


def caption_tables(spark, copies=1):
    texts = {"a": ("x y x y z", ["x y z", "y"]), "b": ("x y", ["x y x y"]), "c": ("q", ["x y z w"]), "d": ("", ["z"])}
    cands = [(f"{i}{k}", c.split()) for k in range(copies) for i, (c, _) in texts.items()]
    refs = [(f"{i}{k}", j, r.split()) for k in range(copies) for i, (_, rs) in texts.items() for j, r in enumerate(rs)]
    return spark.createDataFrame(cands, "item string, cand array<string>"), spark.createDataFrame(refs, "item string, ref_id int, ref array<string>")


def test_caption_counts_add_repeated_rows(spark):
    cands = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (1, ["a"]), (2, []), (None, ["a"]), (4, None)], "item int, cand array<string>")
    refs = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 0, ["a"]), (1, None, ["b", None, "c"]), (3, 1, [])], "item int, ref_id int, ref array<string>")
    counts = {(r.item, r.n, r.gram): (r.c, {x.ref: x.r for x in r.refs}) for r in ca.caption_counts(cands, refs, "item", "cand", "ref_id", "ref", 2).collect()}
    assert counts == {
        (1, 0, ""): (5, {0: 3, None: 3}), (1, 1, "a"): (4, {0: 2}), (1, 1, "b"): (1, {0: 1, None: 1}), (1, 1, ""): (None, {None: 1}),
        (1, 1, "c"): (None, {None: 1}), (1, 2, "a b"): (1, {0: 1}), (1, 2, "b a"): (1, {}), (1, 2, "b"): (None, {None: 1}),
        (1, 2, "c"): (None, {None: 1}), (2, 0, ""): (0, {}), (3, 0, ""): (None, {1: 0}),
    }
    stats = ca.bleu_statistics(cands, refs, "item", "cand", "ref_id", "ref", 2).collect()
    assert [(r.item, r.testlen, r.reflen, r.correct1, r.correct2, r.guess2) for r in stats] == [(1, 5, 3, 3, 1, 4)]


def test_caption_statistics_shuffle_no_ngrams(spark):
    cands, refs = caption_tables(spark)
    plan = ca.bleu_statistics(cands, refs, "item", "cand", "ref_id", "ref")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "gram#" not in plan


def test_cider_asks_once_a_block(spark):
    cands, refs = caption_tables(spark, 50)
    blocked = ca._texts(cands, refs, "item", "cand", "ref_id", "ref").selectExpr("0 AS block", "item", "texts")
    common = {(r.n, r.gram): r.df for r in ca._common_grams(blocked, 4).collect()}
    want = Counter((k, " ".join(g)) for t in ([["x y z", "y"]], [["x y x y"]], [["x y z w"]], [["z"]]) for k, g in {
        (k, tuple(r.split()[i : i + k])) for r in t[0] for k in range(1, 5) for i in range(len(r.split()) - k + 1)})
    assert common == {g: 50 * d for g, d in want.items()}


def test_cider_over_several_blocks_equals_one(spark, monkeypatch):
    cands, refs = caption_tables(spark, 5)
    args = (cands, refs, "item", "cand", "ref_id", "ref")
    one = {r.item: r.cider for r in ca.cider(*args).collect()}
    monkeypatch.setattr(ca, "BLOCK_TOKENS", 7)
    many = {r.item: r.cider for r in ca.cider(*args).collect()}
    assert len(one) == 20 and many == pytest.approx(one, abs=1e-12) and all(math.isfinite(v) for v in one.values())


def test_self_critical_reward_asks_once_for_both_captions(spark, monkeypatch):
    monkeypatch.setattr(ca, "BLOCK_TOKENS", 30)
    monkeypatch.setattr(ca, "NUMBER_GRAMS", 60)
    sampled, refs = caption_tables(spark, 6)
    greedy = sampled.where("item <> 'b0'").select("item", F.array_distinct("cand").alias("cand"))
    odd = [("odd", ["x y", None, "", "z"])]
    sampled = sampled.unionByName(spark.createDataFrame([*odd, (None, ["x"]), ("alone", ["x"])], sampled.schema))
    greedy = greedy.unionByName(spark.createDataFrame([("odd", ["x", "y z"]), ("odd", ["x"])], greedy.schema))
    refs = refs.unionByName(spark.createDataFrame([("odd", 0, ["x", "y"]), ("odd", 1, [None, "x y", "z"]), ("odd", 1, None)], refs.schema))
    names = ("item", "cand", "ref_id", "ref")
    scores = [{r.item: r.cider for r in ca.cider(c, refs, *names).collect()} for c in (sampled, greedy)]
    bleu = [{r.item: r.bleu4 for r in ca.bleu_per_item(ca.bleu_statistics(c, refs, *names), "item").collect()} for c in (sampled, greedy)]
    out = ca.self_critical_reward(sampled, greedy, refs, *names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "gram#" not in plan
    got = {r.item: r.reward for r in out.collect()}
    assert len(got) == 4 * 6 - 1 + 1 and "b0" not in got and got == {i: scores[0][i] - scores[1][i] for i in got}
    both = ca.self_critical_reward(sampled, greedy, refs, *names, cider_weight=0.5, bleu_weight=2.0)
    want = {i: 0.5 * (scores[0][i] - scores[1][i]) + 2 * (bleu[0][i] - bleu[1][i]) for i in got}
    assert {r.item: r.reward for r in both.collect()} == pytest.approx(want)


def test_blocks_end_where_their_words_do(spark):
    cands, refs = caption_tables(spark, 9)
    texts = ca._texts(cands, refs, "item", "cand", "ref_id", "ref").coalesce(1)
    sizes = [(r.n_given, r.n_tokens) for r in ca._blocks(texts, 20).collect()]
    assert sum(g for g, _ in sizes) == 36 and sum(n for _, n in sizes) == texts.agg(F.sum("n_tokens")).first()[0] == 9 * 21
    assert all(20 <= n < 30 for _, n in sizes[:-1]) and sizes[-1][1] < 30
    again = ca._unblocked(ca._blocks(texts, 20), texts).collect()
    assert sorted(map(str, again)) == sorted(map(str, texts.select("item", "texts").collect()))


def conversation_table(spark, folder):
    said = [["a b a c", "b a c", "", "a b c d e"], ["x y", "y x y x", "x"], ["a b a c", "a c"], ["z"]]
    rows = [(i, k, "user", text) for i, turns in enumerate(said) for k, text in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_caption_report_has_every_item(spark, tmp_path):
    conversation_table(spark, tmp_path)
    queries = entry_module.queries()
    got = {(r.item, r.metric): r.value for r in queries["caption_report"](spark, str(tmp_path)).collect()}
    want = {
        (r.item, m): r[m]
        for name in ("bleu_per_item", "rouge_l", "cider")
        for r in queries[name](spark, str(tmp_path)).collect()
        for m in r.asDict() if m != "item"
    }
    want |= {(None, m): v for m, v in queries["bleu_corpus"](spark, str(tmp_path)).first().asDict().items()}
    assert len(want) == 6 * 6 + 4 and {k: got[k] for k in want} == want
    for m in ("rouge_l", "cider"):
        every = [v for (i, metric), v in want.items() if i is not None and metric == m]
        assert got.pop((None, m)) == pytest.approx(sum(every) / len(every), abs=2e-6)
    assert set(got) == set(want)


def test_grid_reads_blocks_without_a_shuffle_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ve, "LEFT_PARTS", 3)
    monkeypatch.setattr(ve, "RIGHT_BLOCKS", 2)
    vectors = np.random.default_rng(5).integers(-2, 3, size=(90, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), (i * 7) % 90) for i, v in enumerate(vectors)], "k long, v array<double>, target long")
    grid = ve.score_grid(df, df.select("k", "v"), "k", "k", "v", 10)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert grid.count() == 81 and "CartesianProduct" in plan and "Exchange" not in plan
    scores = vectors @ vectors.T
    got = {}
    for r in ve.top_matches(df, df, "k", "k", "v", 4, 10).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.item, r.score))
    ranks = {r.k: r["rank"] for r in ve.rank_of_target(df, df, "k", "k", "v", "target", 10).collect()}
    for i in range(90):
        best = sorted(range(90), key=lambda j: (-scores[i, j], j))
        assert got[i] == [(j, scores[i, j]) for j in best[:4]] and ranks[i] == best.index((i * 7) % 90) + 1


def boxes_of(rng, n):
    at = rng.integers(0, 8, (n, 2)).astype(float)
    return np.concatenate([at, at + rng.integers(1, 9, (n, 2))], axis=1)


def test_images_matched_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(8)
    levels, ranges = [0.1, 0.3, 0.6], [(0, 1e9), (0, 20)]
    n_d, n_g = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    d, g = boxes_of(rng, n_d.sum()), boxes_of(rng, n_g.sum())
    crowd = rng.random(len(g)) < 0.2
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    det, truth = ma._group_pairs(n_d, n_g)
    place = np.arange(len(d)) - np.repeat(np.cumsum(n_d) - n_d, n_d)
    got = ma.coco_match_groups(det, truth, ma._pair_iou(d[det], g[truth], crowd[truth]), place, size(d), crowd, size(g), levels, ranges)
    cover = ma.cover_groups(det, truth, ma._pair_iou(d[det], g[truth]), len(g))
    at_d, at_g = 0, 0
    for a, b in zip(n_d, n_g):
        one, other = slice(at_d, at_d + a), slice(at_g, at_g + b)
        want = ma.coco_match_one(ma.iou_matrix(d[one], g[other], crowd[other]), size(d[one]), crowd[other], size(g[other]), levels, ranges)
        assert all((np.moveaxis(x[one], 0, 2) == y).all() for x, y in zip(got, want))
        rest = ma.iou_matrix(d[one], g[other])
        best = np.zeros(b)
        for _ in range(min(a, b)):
            j = int(rest.max(axis=0).argmax())
            i = int(rest[:, j].argmax())
            best[j] = rest[i, j]
            rest[i], rest[:, j] = -1, -1
        assert (cover[other] == best).all()
        at_d, at_g = at_d + a, at_g + b


def test_suppression_side_by_side_equals_loops():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 1, 9, 14, 600])
    boxes = boxes_of(rng, sizes.sum())
    boxes[5, 0] = np.nan
    stays, at = [], 0
    for n in sizes:
        kept = []
        for i in range(at, at + n):
            if not any(ma._clash(boxes[k : k + 1], boxes[i : i + 1], 0.3, 0.0)[0] for k in kept):
                kept.append(i)
        stays += kept
        at += n
    assert np.flatnonzero(ma.nms_groups(boxes, sizes, 0.3, 0.0)).tolist() == stays
    alone = ma.nms_groups(boxes[-600:], sizes[-1:], 0.3, 0.0)
    assert (np.flatnonzero(alone) + sizes[:-1].sum()).tolist() == [i for i in stays if i >= sizes[:-1].sum()]


def test_curve_sums_over_slices_and_classes(spark, many_slices):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", "c", None][int(k)], float(s), i, t.tolist(), (1 - t).tolist()) for i, (k, s, t) in enumerate(zip(rng.choice(4, 400, p=[0.8, 0.1, 0.05, 0.05]), rng.integers(0, 50, 400), rng.integers(0, 2, (400, 3))))]
    df = spark.createDataFrame(rows, "cls string, score double, place int, tp array<tinyint>, fp array<tinyint>")
    got = {(r.cls, r.i): (r.step, r.top, r.found, r.found_20) for r in de.curve_sums(df, "cls", ["-score", "place"], 3, limits=[20]).collect()}
    assert len(got) == 12
    for (cls, i), values in got.items():
        some = sorted((r for r in rows if r[0] == cls), key=lambda r: (-r[1], r[2]))
        tp = np.array([r[3][i] for r in some])
        precision = np.cumsum(tp) / np.arange(1, len(tp) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        assert values == pytest.approx(((envelope * tp).sum(), envelope[0], tp.sum(), sum(r[3][i] for r in some if r[2] <= 20)))


def test_enclosing_copies_a_row_once_a_step_of_levels(spark):
    lengths = spark.createDataFrame([(k,) for k in (1, 2, 3, 16, 17, 255, 256, 257, 4097, 65536)], "n long")
    got = {r.n: r.level for r in lengths.select("n", tr.interval_level(F.col("n")).alias("level")).collect()}
    assert set(got.values()) == {0, 4, 8, 12, 16} and all(2**level >= n for n, level in got.items())
    rng = np.random.default_rng(2)
    outer = [(int(k % 2), int(s), int(s + n), i) for i, (k, s, n) in enumerate(zip(range(60), rng.integers(0, 3000, 60), 2 ** rng.integers(0, 12, 60)))]
    inner = [(int(k % 2), int(x), int(x + 3), i) for i, (k, x) in enumerate(zip(range(200), rng.integers(0, 4000, 200)))]
    pairs = tr.enclosing(
        spark.createDataFrame(inner, "obj int, lo long, hi long, kid int"), spark.createDataFrame(outer, "obj int, s long, e long, id int"), ["obj"], "lo", "hi", "s", "e"
    )
    want = sorted((i[3], o[3]) for i in inner for o in outer if i[0] == o[0] and o[1] < i[1] and o[2] > i[2])
    assert want and sorted((r.kid, r.id) for r in pairs.collect()) == want


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_xml_files_hold_few_images(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "XML_IMAGES", 2)
    rows = [(i, j, 1, 1, 2.0, 100.0, 0.01, 0.02, "A", "F") for i in range(40) for j in (1, 2)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(files, "_folder", lambda t: str(tmp_path))
    assert entry_module.queries()["voc_xml"](spark, str(tmp_path)).count() == 80
    texts = [p.read_text() for p in (tmp_path / "xml").glob("part-*")]
    assert max(t.count("<filename>") for t in texts) == 2 and sum(t.count("<filename>") for t in texts) == 40


def test_xml_of_a_large_table_is_compressed(spark, tmp_path, monkeypatch):
    rows = [(i, j, 1, 1, i / 7, 100.0 * j, 0.01, 0.02, "A" if i % 3 else None, "F") for i in range(400) for j in (1, 2)]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found, sizes = {}, {}
    for kind, most in (("plain", 64 << 20), ("packed", 0)):
        monkeypatch.setattr(files, "XML_PLAIN_BYTES", most)
        monkeypatch.setattr(files, "_folder", lambda t, kind=kind: f"{tmp_path}/{kind}")
        found[kind] = sorted(map(str, entry_module.queries()["voc_xml"](spark, str(tmp_path)).collect()))
        parts = list((tmp_path / kind / "xml").glob("part-*"))
        sizes[kind] = sum(p.stat().st_size for p in parts)
        assert all(p.name.endswith(".xml.gz") == (kind == "packed") for p in parts)
    assert len(found["plain"]) == 800 and found["plain"] == found["packed"]
    # an indent made it some 400 bytes a box
    assert sizes["plain"] < 250 * 800 and sizes["packed"] * 5 < sizes["plain"]


def test_positions_over_everything_shuffle_once(spark, many_slices):
    df = spark.createDataFrame([((i * 37) % 101 if i % 9 else None, str(i)) for i in range(300)], "a int, b string")
    placed = ordered.positions(df, [], ["a", "-b"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan
    rows = sorted(((r.a, r.b) for r in df.collect()), key=lambda r: r[1], reverse=True)
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    assert [(r.a, r.b, r.pos) for r in sorted(placed.collect(), key=lambda r: r.pos)] == [(*r, i) for i, r in enumerate(rows, 1)]


def test_annotation_documents_are_compressed(spark, tmp_path):
    images = spark.createDataFrame([(i, f"{i}.jpg", 1, 2) for i in range(3)], "id long, file_name string, height int, width int")
    anns = spark.createDataFrame([(7, 1, 3, [0.0, 1.0, 2.0, 3.0])], "id long, image_id long, category_id int, bbox array<double>")
    readers.annotation_documents(images, anns, spark.createDataFrame([(3, "c")], "id int, name string"), f"{tmp_path}/docs")
    names = [p.name for p in (tmp_path / "docs").glob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)
    read, rows, cats = sn.json_tables(spark, f"{tmp_path}/docs")
    assert read.count() == 3 and cats.count() == 1 and [(r.id, r.bbox) for r in rows.collect()] == [(7, [0.0, 1.0, 2.0, 3.0])]


def test_lvis_records_check_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, i // 2, 1 + i % 3, [0.0, 0.0, 1.0, 1.0], [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]]) for i in range(20)]

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "id long, image_id long, category_id int, bbox array<double>, segmentation array<array<double>>")
    anns = df.mapInArrow(watched, df.schema)
    images = spark.createDataFrame([(i, "http://x/val/1.jpg", 1, 1, None, None) for i in range(10)], "id long, coco_url string, height int, width int, neg_category_ids array<int>, not_exhaustive_category_ids array<int>")
    records = sn.lvis_records(images, anns, "root/")
    assert seen.value == 20 and {len(r.annotations) for r in records.collect()} == {2}
    with pytest.raises(ValueError, match="annotation 4 has a broken polygon"):
        sn.lvis_records(images, df.withColumn("segmentation", F.when(F.col("id") != 4, F.col("segmentation")).otherwise(F.array())), "root/")


def test_shuffles_start_wide(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    registry.widen(spark)
    assert int(spark.conf.get(key)) >= registry.START_PARTS
    spark.conf.set(key, "5000")
    assert registry.widen(spark).conf.get(key) == "5000"
    spark.conf.unset(key)


def test_grams_are_dealt_out_before_they_are_summed(spark, monkeypatch):
    monkeypatch.setattr(vo, "CHUNK_BYTES", 12)
    rows = [(i, t.split()) for i, t in enumerate(["a b a b a", "b a", "", "é b a c", "a a a a a", "a b", "c", "x y z x y z"])]
    rows += [(8, None), (9, ["a b", "c"]), (9, ["a", "b c"]), (None, ["a", None, "b", ""]), (0, [None, "a", "a", None])]
    df = spark.createDataFrame(rows, "k long, t array<string>").coalesce(1)
    once = [{(k, " ".join(w for w in t[i : i + k] if w is not None)) for k in range(1, 5) for i in range(len(t) - k + 1)} for _, t in rows if t]
    out = vo.ngram_document_frequency(df, "k", "t", 4, rows_per_key="one")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # top down: every sum stands before the only shuffle, which the counted chunks go through
    assert plan.rindex("Aggregate") < plan.index("Exchange hashpartitioning(n") < plan.index("MapInArrow") and plan.count("Exchange") == 1
    assert sorted((r.n, r.gram, r.df) for r in out.collect()) == sorted((*g, c) for g, c in Counter(g for s in once for g in s).items())
    assert vo.ngram_document_frequency(df.where("false"), "k", "t", 4, rows_per_key="one").count() == 0


def test_grams_are_packed_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vo, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{w}" if w % 11 else "é" * w for w in rng.zipf(1.4, 40) % 500 + 1]) for i in range(120)]
    rows += [(200, ["w1 w2", "w3"]), (201, ["w1", None, "w2", "w3"]), (202, ["w1", "w2", "w3", "w1", "w2"]), (203, [])]
    out = vo.ngram_document_frequency(spark.createDataFrame(rows, "k long, t array<string>").coalesce(2), "k", "t", 5, rows_per_key="one", parts=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "gram#" not in plan[plan.index("Exchange") :] and "blob#" in plan[plan.index("Exchange") :]
    want = Counter(g for _, t in rows for g in {(k, " ".join(w for w in t[i : i + k] if w is not None)) for k in range(1, 6) for i in range(len(t) - k + 1)})
    assert sorted((r.n, r.gram, r.df) for r in out.collect()) == sorted((*g, c) for g, c in want.items())


def test_packed_grams_take_less_room_than_their_words():
    rng = np.random.default_rng(9)
    rows = [[f"word{w}" for w in rng.zipf(1.3, 60) % 3000] for _ in range(500)]
    tokens = vo.pa.array(rows, vo.pa.list_(vo.pa.string()))
    blobs = dict(gr.packed(*gr.coded(tokens, np.arange(500) // 2, np.arange(500) % 4 < 3, 4), 5))
    assert sum(map(len, blobs.values())) < sum(len(" ".join(t)) for t in rows)
    got = {}
    for blob in blobs.values():
        for k, grams in enumerate(gr.merged([blob, blob], 4), start=1):
            got |= {(k, g): int(c) for g, c in zip(grams.texts.to_pylist(), gr.totals(grams))}
    held = {}
    for i, t in enumerate(rows):
        for k in range(1, 5):
            for j in range(len(t) - k + 1):
                held.setdefault((k, " ".join(t[j : j + k])), set()).update([i // 2] if i % 4 < 3 else [])
    # two blobs of the same grams: twice the owners, of the rows that count only
    assert got == {g: 2 * len(those) for g, those in held.items()}
