"""Exact small cases and brute-force comparisons of the operators without SQL."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetally.functions import answers as an
from scenetally.functions import arrays
from scenetally.functions.boxes import Box, mask_area, polygon_area
from scenetally.operators import annotations as ann
from scenetally.operators import captions as ca
from scenetally.operators import cooccurrence as co
from scenetally.operators import detection as de
from scenetally.operators import matching as ma
from scenetally.operators import ranking as ra
from scenetally.operators import sampling as sa
from scenetally.operators import traces as tr
from scenetally.operators import vectors as ve
from scenetally.operators import vocabulary as vo
from scenetally.operators import votes as vt


def test_iou_cases(spark):
    other = [(0, 0, 1, 1), (0, 0, 0.5, 1), (0, 0, 1, 0.5), (0, 0, 0.5, 0.5), (0.5, 0.5, 1, 1), (0.5, 0.5, 1.5, 1.5)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in other], "x1 double, y1 double, x2 double, y2 double")
    unit = Box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    got = [r.v for r in df.select(unit.iou(Box.of()).alias("v")).collect()]
    assert got == pytest.approx([1, 0.5, 0.5, 0.25, 0.25, 0.25 / 1.75])


def test_nms_cases(spark):
    rows = [(1, 10, 10, 50, 60, 0.5), (2, 11, 12, 48, 60, 0.7), (3, 8, 9, 40, 50, 0.6), (4, 100, 100, 150, 140, 0.9), (5, 99, 110, 155, 139, 0.8)]
    df = spark.createDataFrame([(0, 0, i, *map(float, b)) for i, *b in rows], "image int, cls int, id int, x1 double, y1 double, x2 double, y2 double, score double")
    for level, want in ((0.1, {2, 4}), (0.3, {2, 4}), (0.5, {2, 4}), (0.8, {2, 3, 4, 5}), (0.9, {1, 2, 3, 4, 5})):
        kept = ma.class_nms(df, "image", "cls", "id", "score", level, offset=1.0)
        assert {r.id for r in kept.collect()} == want, level


def test_threshold_assignment_case(spark):
    quality = [[0.15, 0.45, 0.2, 0.6], [0.3, 0.65, 0.05, 0.1], [0.05, 0.4, 0.25, 0.4]]
    pairs = spark.createDataFrame([(0, b, g, quality[g][b]) for g in range(3) for b in range(4)], "image int, box int, truth int, iou double")
    boxes = spark.createDataFrame([(0, b) for b in range(4)], "image int, box int")
    out = ma.assign_labels(pairs, boxes, "image", "box", "truth", [0.3, 0.7], [0, -1, 1]).orderBy("box").collect()
    assert [r.truth for r in out] == [1, 1, 2, 0] and [r.label for r in out] == [-1, 1, 0, 1]


def test_cooccurrence_marginals_and_log_of_zero(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b"), (1, "a"), (2, "a"), (2, "c"), (3, "a")], "r int, c string")
    pairs = co.set_cooccurrence(df, "r", "c")
    assert {(r.hi, r.lo): r.n for r in pairs.collect()} == {("a", "a"): 4, ("b", "b"): 1, ("c", "c"): 1, ("b", "a"): 1, ("c", "a"): 1}
    never = pairs.unionByName(spark.createDataFrame([("c", "b", 0)], "hi string, lo string, n long"))
    out = {(r.hi, r.lo): r for r in co.excess_joint(never, F.lit(4)).collect()}
    assert out[("c", "b")].lift == -math.inf and out[("b", "a")].excess == 0.0
    assert ("c", "b") not in {(r.hi, r.lo) for r in co.top_pairs(co.excess_joint(never, F.lit(4)), "lift", 10).collect()}


def test_bag_counts_positions(spark):
    words = "dog cat dog dog".split()
    df = spark.createDataFrame([(0, w) for w in words], "r int, w string")
    want = {}
    for i in range(len(words)):
        for j in range(i, len(words)):
            key = (max(words[i], words[j]), min(words[i], words[j]))
            want[key] = want.get(key, 0) + 1
    assert {(r.hi, r.lo): r.n for r in co.bag_cooccurrence(df, "r", "w").collect()} == want
    plain = {(r.hi, r.lo): r.n for r in co.bag_cooccurrence(df, "r", "w", self_pairs="marginal").collect()}
    assert plain[("dog", "dog")] == 3


def test_cutoff_on_and_inside_a_row(spark, many_slices):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "word string, n long")
    assert {r.word for r in vo.cumulative_cutoff(counts, 5.0).collect()} == {"a"}
    assert {r.word for r in vo.cumulative_cutoff(counts, 6.0).collect()} == {"a", "b"}


def test_whole_word_tokens(spark):
    df = spark.createDataFrame([(["play", "##ing", "dog", "##s", "cat"],)], "t array<string>")
    assert df.select(vo.whole_word_tokens(F.col("t")).alias("k")).first().k == ["cat"]


def test_majority_ties_and_missing_confidence(spark):
    rows = [("p", i, a, c) for i, (a, c) in enumerate([("x-to-y", "confidence_1"), ("y-to-x", "confidence_3"), ("y-to-x", None), ("x-to-y", "confidence_2"), ("z", "confidence_1")])]
    votes = spark.createDataFrame(rows, "pair string, seq int, answer string, confidence string")
    got = {r.setting: r for r in vt.weighted_majority(votes, "pair", "answer", "confidence", "seq").collect()}
    assert got["no_cfdnce_weight"].max_resp == "x-to-y" and got["no_cfdnce_weight"].max_resp_count == 2
    # 1/3 + 2/3 against 1: a tie, the answer seen first wins
    assert got["full_cfdnce_weight"].max_resp == "x-to-y" and got["full_cfdnce_weight"].max_resp_fraction == 0.2


def test_triples_by_number_of_effects(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("b", "y", 2), ("c", "x", 3), ("c", "y", 4), ("c", "z", 5)], "cause string, effect string, o int")
    got = [r.cause for r in vt.confounder_triples(df, "o").collect()]
    assert sorted(got) == ["b", "c", "c", "c"]


def test_known_labels_orientations(spark):
    df = spark.createDataFrame([("x", "y", "x-to-y"), ("u", "v", "y-to-x"), ("p", "q", "z-to-xy")], "x string, y string, resp string")
    got = {(r.effect, r.candidate): r.label for r in vt.known_labels(df, "x", "y", "resp").collect()}
    assert got == {("y", "x"): "cause", ("x", "y"): "effect", ("v", "u"): "effect", ("u", "v"): "cause", ("q", "p"): "mere_correlate", ("p", "q"): "mere_correlate"}
    old = {(r.effect, r.candidate): r.label for r in vt.known_labels(df, "x", "y", "resp", compat=True).collect()}
    assert old[("u", "v")] == "effect"


def exact_random_ap(n, r):
    total = Fraction(0)
    for i in range(1, r + 1):
        for m in range(i, n - r + i + 1):
            p = Fraction(math.comb(r, i) * math.comb(n - r, m - i), math.comb(n, m))
            total += p * Fraction(i, m) ** 2
    return float(total / r)


def test_expected_random_ap(spark):
    cases = [(n, r) for n in (1, 2, 4, 5, 9, 14) for r in range(1, n + 1)]
    df = spark.createDataFrame(cases, "n int, r int")
    for row in df.select("n", "r", ra.expected_random_ap(F.col("n"), F.col("r")).alias("e")).collect():
        assert row.e == pytest.approx(exact_random_ap(row.n, row.r), abs=1e-12)
    h = spark.createDataFrame([(512,), (513,), (100000,)], "n int").select(ra.harmonic(F.col("n")).alias("h")).collect()
    assert [r.h for r in h] == pytest.approx([sum(1 / k for k in range(1, n + 1)) for n in (512, 513, 100000)], abs=1e-12)


def test_retrieval_ranks(spark):
    df = spark.createDataFrame([(1,), (5,), (11,), (None,)], "rank int")
    r = ra.retrieval_recall(df, "rank").first()
    assert (r.r1, r.r5, r.r10) == (25.0, 50.0, 50.0) and r.median_rank == 8 and r.mean_rank == (0 + 4 + 10 + 1000) / 4 + 1


def coco_reference(iou, areas, crowd, g_area, levels, ranges):
    """Loop over ranges, levels, detections and truths in the order the benchmark defines."""
    n_d, n_g = iou.shape
    hit, skip = np.zeros((len(ranges), len(levels), n_d), bool), np.zeros((len(ranges), len(levels), n_d), bool)
    for a, (low, high) in enumerate(ranges):
        off = [bool(crowd[g]) or g_area[g] < low or g_area[g] > high for g in range(n_g)]
        order = [g for g in range(n_g) if not off[g]] + [g for g in range(n_g) if off[g]]
        for t, level in enumerate(levels):
            taken = set()
            for d in range(n_d):
                best, found = min(level, 1 - 1e-10), None
                for g in order:
                    if g in taken and not crowd[g]:
                        continue
                    if found is not None and not off[found] and off[g]:
                        break
                    if iou[d, g] >= best:
                        best, found = iou[d, g], g
                if found is None:
                    skip[a, t, d] = areas[d] < low or areas[d] > high
                else:
                    hit[a, t, d], skip[a, t, d] = True, off[found]
                    taken.add(found)
    return hit, skip


def test_coco_match_against_loops():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n_d, n_g = rng.integers(1, 6), rng.integers(0, 6)

        def boxes(n):
            p = rng.integers(0, 6, (n, 2)).astype(float)
            return np.concatenate([p, p + rng.integers(1, 8, (n, 2))], axis=1)

        d, g = boxes(n_d), boxes(n_g)
        crowd = rng.random(n_g) < 0.2
        size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        args = (ma.iou_matrix(d, g, crowd), size(d), crowd, size(g), [0.25, 0.5, 0.75], [(0, 1e9), (0, 15), (16, 1e9)])
        got, want = ma.coco_match_one(*args), coco_reference(*args)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def detections_frame(spark, seed=3, images=30):
    rng = random.Random(seed)
    dets, truths = [], []
    for i in range(images):
        for k in range(rng.randint(0, 5)):
            x, y = rng.randint(0, 20), rng.randint(0, 20)
            dets.append((i, "c" if rng.random() < 0.8 else "d", f"d{i}-{k}", float(x), float(y), float(x + rng.randint(4, 40)), float(y + rng.randint(4, 40)), rng.random()))
        for k in range(rng.randint(0, 4)):
            x, y = rng.randint(0, 20), rng.randint(0, 20)
            x2, y2 = x + rng.randint(4, 40), y + rng.randint(4, 40)
            truths.append((i, "c" if rng.random() < 0.8 else "d", f"g{i}-{k}", float(x), float(y), float(x2), float(y2), float((x2 - x) * (y2 - y)), rng.random() < 0.1))
    corners = "x1 double, y1 double, x2 double, y2 double"
    return (
        spark.createDataFrame(dets, f"image int, cls string, det_id string, {corners}, score double"),
        spark.createDataFrame(truths, f"image int, cls string, truth_id string, {corners}, area double, iscrowd boolean"),
        dets,
        truths,
    )


def test_coco_ap_against_loops(spark, many_slices):
    dets, truths, d_rows, g_rows = detections_frame(spark)
    areas = {"all": (0.0, 1e10), "small": (0.0, 300.0)}
    flags = ma.coco_match_wide(dets, truths, "image", "cls", "det_id", "score", de.IOU_LEVELS, areas)
    few = {(r.cls, r.area, round(r.threshold, 2)): (r.recall_1, r.recall_2) for r in de.coco_ap(flags, truths, "image", "cls", "score", areas, limits=[1, 2]).collect()}
    got = {(r.cls, r.area, round(r.threshold, 2)): (r.ap, r.recall) for r in de.coco_ap(flags, truths, "image", "cls", "score", areas).collect()}
    for cls, (name, rng_) in itertools.product("cd", areas.items()):
        for t in de.IOU_LEVELS:
            rows, n_pos = [], 0
            for image in range(30):
                d = sorted([r for r in d_rows if r[0] == image and r[1] == cls], key=lambda r: (-r[7], r[2]))
                g = sorted([r for r in g_rows if r[0] == image and r[1] == cls], key=lambda r: r[2])
                n_pos += sum(not r[8] and rng_[0] <= r[7] <= rng_[1] for r in g)
                db, gb = np.array([r[3:7] for r in d]).reshape(-1, 4), np.array([r[3:7] for r in g]).reshape(-1, 4)
                crowd = np.array([r[8] for r in g], bool)
                size = (db[:, 2] - db[:, 0]) * (db[:, 3] - db[:, 1])
                hit, skip = coco_reference(ma.iou_matrix(db, gb, crowd), size, crowd, np.array([r[7] for r in g]), [t], [rng_])
                rows += [(-r[7], image, k, hit[0, 0, k] and not skip[0, 0, k], not hit[0, 0, k] and not skip[0, 0, k]) for k, r in enumerate(d)]
            rows.sort()
            tp, fp = np.cumsum([r[3] for r in rows]), np.cumsum([r[4] for r in rows])
            if not n_pos:
                assert (cls, name, t) not in got
                continue
            precision = np.divide(tp, tp + fp, out=np.zeros(len(tp)), where=(tp + fp) > 0)
            recall = tp / n_pos
            for i in range(len(precision) - 1, 0, -1):
                precision[i - 1] = max(precision[i - 1], precision[i])
            at = np.searchsorted(recall, de.RECALL_LEVELS, side="left")
            ap = np.mean([precision[i] if i < len(precision) else 0.0 for i in at])
            assert got[(cls, name, t)] == pytest.approx((ap, recall[-1] if len(recall) else 0.0), abs=1e-9), (cls, name, t)
            # the limits again by a match of the first detections alone
            for m, value in zip((1, 2), few[(cls, name, t)]):
                found = 0
                for image in range(30):
                    d = sorted([r for r in d_rows if r[0] == image and r[1] == cls], key=lambda r: (-r[7], r[2]))[:m]
                    g = sorted([r for r in g_rows if r[0] == image and r[1] == cls], key=lambda r: r[2])
                    db, gb = np.array([r[3:7] for r in d]).reshape(-1, 4), np.array([r[3:7] for r in g]).reshape(-1, 4)
                    crowd = np.array([r[8] for r in g], bool)
                    size = (db[:, 2] - db[:, 0]) * (db[:, 3] - db[:, 1])
                    hit, skip = coco_reference(ma.iou_matrix(db, gb, crowd), size, crowd, np.array([r[7] for r in g]), [t], [rng_])
                    found += int((hit & ~skip).sum())
                assert value == pytest.approx(found / n_pos, abs=1e-9)


def test_voc_duplicates_difficult_and_missing_class(spark, many_slices):
    corners = "x1 double, y1 double, x2 double, y2 double"
    truths = spark.createDataFrame([(0, "a", "g1", 0.0, 0.0, 9.0, 9.0, False), (1, "a", "g2", 0.0, 0.0, 9.0, 9.0, True), (2, "a", "g3", 0.0, 0.0, 9.0, 9.0, False)], f"image int, cls string, truth_id string, {corners}, difficult boolean")
    dets = spark.createDataFrame([(0, "a", "d1", 0.0, 0.0, 9.0, 9.0, 0.9), (0, "a", "d2", 0.0, 0.0, 9.0, 8.0, 0.8), (1, "a", "d3", 0.0, 0.0, 9.0, 9.0, 0.7), (3, "a", "d4", 0.0, 0.0, 9.0, 9.0, 0.6)], f"image int, cls string, det_id string, {corners}, score double")
    flags = ma.voc_match(dets, truths, "image", "cls", "det_id", "truth_id", "score", [0.5])
    assert {r.det_id: (r.tp, r.fp) for r in flags.collect()} == {"d1": (1, 0), "d2": (0, 1), "d3": (0, 0), "d4": (0, 1)}
    curve = de.precision_recall(flags, ["cls", "threshold"], ["-score", "det_id"], de.count_positives(truths, ["cls"]), ["cls"])
    assert de.average_precision_area(curve, ["cls"]).first().ap == 0.5


def test_optimal_cover_against_loops(spark):
    dets, truths, d_rows, g_rows = detections_frame(spark, seed=5)
    got = {(r.truth_id, r.limit): r.cover for r in ma.optimal_cover(dets, truths, "image", "det_id", "score", [1, 100]).collect()}
    for image, limit in itertools.product(range(30), (1, 100)):
        d = sorted([r for r in d_rows if r[0] == image], key=lambda r: (-r[7], r[2]))[:limit]
        g = [r for r in g_rows if r[0] == image]
        free_d, free_g = set(range(len(d))), set(range(len(g)))
        iou = ma.iou_matrix(np.array([r[3:7] for r in d]).reshape(-1, 4), np.array([r[3:7] for r in g]).reshape(-1, 4))
        values = []
        while free_d and free_g:
            i, j = max(itertools.product(sorted(free_d), sorted(free_g)), key=lambda p: iou[p])
            values.append(iou[i, j])
            free_d.discard(i)
            free_g.discard(j)
        values += [0.0] * len(free_g)
        assert sorted(got[(r[2], limit)] for r in g) == pytest.approx(sorted(values))


def test_keypoint_similarity(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], [1.0, 5.0], [1.0, 2.0], [2, 0]), ([50.0, 2.0], [1.0, 2.0], [1.0, 5.0], [1.0, 2.0], [0, 0])], "dx array<double>, dy array<double>, gx array<double>, gy array<double>, gv array<int>")
    box = tuple(F.lit(v) for v in (0.0, 0.0, 10.0, 10.0))
    oks = ma.keypoint_similarity(F.col("dx"), F.col("dy"), F.col("gx"), F.col("gy"), F.col("gv"), box, F.lit(100.0), [2.5, 2.5])
    got = [r.v for r in df.select(oks.alias("v")).collect()]
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx((math.exp(-(30.0**2) / 0.25 / 100 / 2) + 1) / 2)


def test_lcs_and_rouge(spark):
    rng = random.Random(2)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcd") for _ in range(rng.randint(0, 90))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.n for r in df.select(ca.lcs_length("a", "b").alias("n")).collect()] == [lcs(a, b) for a, b in rows]


def test_caption_scores_same_and_disjoint(spark):
    cands = spark.createDataFrame([("same", "a b c d e".split()), ("none", "v w x y z".split()), ("short", ["a"])], "item string, cand array<string>")
    refs = spark.createDataFrame([("same", 0, "a b c d e".split()), ("none", 0, "a b c d e".split()), ("short", 0, ["a"]), ("same", 1, "q r".split())], "item string, ref_id int, ref array<string>")
    bleu = {r.item: r for r in ca.bleu_per_item(ca.bleu_statistics(cands, refs, "item", "cand", "ref_id", "ref"), "item").collect()}
    assert bleu["same"].bleu4 == pytest.approx(1.0, abs=1e-6) and bleu["none"].bleu1 < 1e-3
    rouge = {r.item: r.rouge_l for r in ca.rouge_l(cands, refs, "item", "cand", "ref").collect()}
    assert rouge == pytest.approx({"same": 1.0, "none": 0.0, "short": 1.0})
    cider = {r.item: r.cider for r in ca.cider(cands, refs, "item", "cand", "ref_id", "ref").collect()}
    assert cider["none"] == 0.0 and cider["same"] > 0


def test_caption_scores_several_references(spark):
    rng = random.Random(8)

    def words(low, high):
        return [rng.choice("abcdefg") for _ in range(rng.randint(low, high))]

    sides = {f"i{k}": (words(0, 12), [words(0, 12) for _ in range(rng.randint(1, 4))]) for k in range(40)}
    cands = spark.createDataFrame([(i, c) for i, (c, _) in sides.items()] + [("alone", ["a"]), (None, ["a"])], "item string, cand array<string>")
    refs = [(i, k, r) for i, (_, rs) in sides.items() for k, r in enumerate(rs)] + [("unsaid", 0, ["a", "b"])]
    table = spark.createDataFrame(refs, "item string, ref_id int, ref array<string>")

    def grams(t, n):
        return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))

    seen = {n: Counter(g for i in {r[0] for r in refs} for g in set().union(*(grams(r[2], n) for r in refs if r[0] == i))) for n in range(1, 5)}
    every = math.log(len({r[0] for r in refs}))

    def weights(t, n):
        return {g: k * (every - math.log(max(seen[n][g], 1))) for g, k in grams(t, n).items()}

    def cosine(c, r, n):
        h, w = weights(c, n), weights(r, n)
        dot = sum(min(h[g], w[g]) * w[g] for g in h.keys() & w.keys())
        norms = math.sqrt(sum(x * x for x in h.values())) * math.sqrt(sum(x * x for x in w.values()))
        return dot / norms if norms else dot

    stats = {r.item: r for r in ca.bleu_statistics(cands, table, "item", "cand", "ref_id", "ref").collect()}
    cider = {r.item: r.cider for r in ca.cider(cands, table, "item", "cand", "ref_id", "ref").collect()}
    assert set(stats) == set(cider) == set(sides)
    for i, (c, rs) in sides.items():
        assert stats[i].testlen == len(c) and stats[i].reflen == min((abs(len(r) - len(c)), len(r)) for r in rs)[1]
        for n in range(1, 5):
            most = {g: max(grams(r, n)[g] for r in rs) for g in grams(c, n)}
            assert stats[i][f"correct{n}"] == sum(min(k, most[g]) for g, k in grams(c, n).items())
            assert stats[i][f"guess{n}"] == max(len(c) - n + 1, 0)
        want = [
            sum(cosine(c, r, n) for n in range(1, 5)) * math.exp(-((max(len(c) - 1, 0) - max(len(r) - 1, 0)) ** 2) / 72) / 4 for r in rs
        ]
        assert cider[i] == pytest.approx(10 * sum(want) / len(want), abs=1e-9)


def test_answer_rules(spark):
    cases = {"Two dogs, please": "2 dogs please", "the U.S.A.": "usa", "dont": "don't", "1,000": "1000", "3.5 m": "3.5 m", "red/blue": "red blue"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.v for r in df.select(an.normalise_answer(F.col("t")).alias("v")).collect()] == list(cases.values())


def test_pair_truncate_lengths(spark):
    rows = [(a, b, m) for a in range(0, 9) for b in range(0, 9) for m in (1, 4, 7, 8)]
    for m in (1, 4, 7, 8):
        df = spark.createDataFrame([(a, b) for a, b, k in rows if k == m], "a int, b int")
        n, k = an.pair_lengths(F.col("a"), F.col("b"), m)
        for r in df.select("a", "b", n.alias("n"), k.alias("k")).collect():
            a, b = r.a, r.b
            while a + b > m:
                if a > b:
                    a -= 1
                else:
                    b -= 1
            assert (r.n, r.k) == (a, b), (r.a, r.b, m)


def test_enclosing_against_loops(spark):
    rng = random.Random(4)
    outer = [(rng.choice("hhhk"), i, s, s + rng.choice([1, 2, 3, 17, 64, 500, 5000])) for i, s in enumerate(rng.randint(-50, 1000) for _ in range(150))]
    inner = [(rng.choice("hhhk"), i, t, t + rng.choice([0, 1, 20])) for i, t in enumerate(rng.randint(-60, 1100) for _ in range(150))]
    o = spark.createDataFrame(outer, "obj string, id int, s long, e long")
    n = spark.createDataFrame(inner, "obj string, kid int, lo long, hi long")
    got = sorted((r.kid, r.id) for r in tr.enclosing(n, o, ["obj"], "lo", "hi", "s", "e").collect())
    assert got == sorted((k[1], m[1]) for k in inner for m in outer if k[0] == m[0] and m[2] < k[2] and m[3] > k[3])


def test_masking_shares_and_labels(spark):
    words = [f"w{i}" for i in range(40)]
    rows = spark.range(0, 500).withColumn("tokens", F.array(*[F.lit(w) for w in words]))
    vocab = F.array(F.lit("v0"), F.lit("v1"))
    m = rows.select("id", F.posexplode(sa.mask_tokens(F.col("tokens"), "id", 1, vocab)).alias("i", "m")).select("i", "m.*").collect()
    chosen = [r for r in m if r.label is not None]
    assert all(r.token == words[r.i] and r.causal == words[r.i] for r in m if r.label is None)
    assert all(r.label == words[r.i] for r in chosen)
    assert len(chosen) / len(m) == pytest.approx(0.15, abs=0.01)
    masked = [r for r in chosen if r.token == "[MASK]"]
    assert len(masked) / len(chosen) == pytest.approx(0.8, abs=0.03) and all(r.causal is None for r in masked)
    assert all(r.token in ("[MASK]", "v0", "v1", words[r.i]) for r in chosen)


def test_negative_samples_differ(spark):
    entries = spark.createDataFrame([(f"k{i}", i % 5, f"cap{i % 5}-{i}") for i in range(25)], "key string, image long, caption string")
    pool = spark.createDataFrame([(i, [i, (i + 1) % 5]) for i in range(5)], "image long, pool array<long>")
    rows = sa.negative_samples(entries, pool, "key", "image", "caption", 3).collect()
    own = {f"k{i}": (i % 5, f"cap{i % 5}-{i}") for i in range(25)}
    assert len(rows) == 100 and sum(r.target for r in rows) == 25
    for r in rows:
        image, caption = own[r.key]
        if r.kind == 0:
            assert (r.image, r.caption) == (image, caption)
        elif r.kind == 1:
            assert r.image == image and not r.caption.startswith(f"cap{image}-")
        elif r.kind == 2:
            assert r.image != image and r.caption == caption
        else:
            assert r.image == image and r.caption.startswith(f"cap{(image + 1) % 5}-")


def test_select_boxes_all_classes_bounds(spark):
    corners = "x1 double, y1 double, x2 double, y2 double"
    rows = []
    for b in range(6):
        for c, s in ((1, 0.9 - 0.1 * b), (2, 0.05)):
            rows.append((0, b, c, s, 20.0 * b, 0.0, 20.0 * b + 10, 10.0))
    df = spark.createDataFrame(rows, f"image int, box int, cls int, score double, {corners}")
    pick = lambda lo, hi, conf: [r.box for r in ma.select_boxes_all_classes(df, "image", "box", "cls", "score", conf, lo, hi).orderBy("rank").collect()]
    assert pick(1, 10, 0.65) == [0, 1, 2] and pick(5, 10, 0.65) == [0, 1, 2, 3, 4] and pick(1, 2, 0.65) == [0, 1]


def test_first_unused_against_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.randint(0, 6), i) for i in range(60)]
    df = spark.createDataFrame(rows, "cls string, image int, at int")
    got = {r.cls: r.image for r in ann.first_unused_examples(df, "cls", "image", "at", 4).collect()}
    want, used = {}, set()
    for c, i, _ in rows:
        if c not in want and i not in used:
            want[c] = i
            used.add(i)
    assert got == want


def test_first_unused_rounds(spark):
    """A class that loses all its first candidates, chains, ties, nulls and repeats; many random tables."""
    lost = [("z", i, 10) for i in range(4)] + [(c, i, 1 + i) for i, c in enumerate("abcd")] + [("z", 9, 99)]
    chain = [("d", 0, 1), ("c", 0, 2), ("c", 1, 3), ("b", 1, 4), ("b", 2, 5), ("a", 2, 6), ("a", 3, 7)]
    tables = [lost, chain, [("a", 1, 1), ("b", 1, 1), ("a", 2, 1), ("b", 2, 1)], [(None, 1, 0), ("a", None, 0), ("a", 1, 5)], []]
    for seed in range(6):
        rng = random.Random(seed)
        tables.append([(rng.choice("abcdefgh"), rng.randint(0, 12), rng.randint(0, 20)) for _ in range(80)])
    for rows in tables:
        df = spark.createDataFrame(rows, "cls string, image int, at int")
        got = {r.cls: r.image for r in ann.first_unused_examples(df, "cls", "image", "at").collect()}
        want, used = {}, set()
        for at, c, i in sorted((at, c, i) for c, i, at in rows if c is not None and i is not None):
            if c not in want and i not in used:
                want[c] = i
                used.add(i)
        assert got == want


def test_whole_words_of_other_scripts(spark, tmp_path):
    """The SQL and the query agree on digits, marks and letters beyond Latin 1."""
    import __spark_entry__ as entry_module
    from compare import compare, duck

    texts = ["mail5 œuvre acting 字字 вода", "Ständing ração123 nation5 tion", "of5 the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas()
    docs.to_parquet(f"{tmp_path}/documents.parquet")
    for name in ("whole_word_tokens", "bad_ending_rate"):
        assert compare(entry_module.queries()[name](spark, str(tmp_path)), duck(str(tmp_path)), entry_module.oracle_sql()[name]) is None


def test_field_selector_errors(spark):
    for bad in ("=3", "a", "a:float=1"):
        with pytest.raises(ValueError):
            ann.field_selector(bad)
    df = spark.createDataFrame([(1, "x"), (5, "y")], "a int, b string")
    assert [r.a for r in df.where(ann.field_selector("a:int=2-9,b=y")).collect()] == [5]
    assert df.where(ann.field_selector("*")).count() == 2


def test_merged_categories_conflict(spark):
    a = spark.createDataFrame([(1, "x")], "k int, n string")
    b = spark.createDataFrame([(1, "y")], "k int, n string")
    with pytest.raises(Exception, match="two names"):
        ann.merged_categories([a, b], "k", "n").collect()


def test_truncate_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    out = df.select(arrays.truncate_pad("a", 2, 0).alias("x"), arrays.truncate_pad("a", 4, 0).alias("y"), arrays.pad_mask("a", 4).alias("m")).collect()
    assert (out[0].x, out[0].y, out[0].m) == ([1, 2], [1, 2, 3, 0], [1, 1, 1, 0]) and out[1].y == [0, 0, 0, 0]


def test_bad_ending_keeps_digits_and_scripts(spark, tmp_path):
    import __spark_entry__ as entry_module

    texts = ["page of5", "see theœ", "end of в", "to the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert entry_module.queries()["bad_ending_rate"](spark, str(tmp_path)).first().rate == 0.25


def test_polygon_areas(spark):
    rings = [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0], [0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 2.0, 0.0], [1.0, 1.0, 2.0, 2.0], [], [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 2.0, 1.0, 0.0, 4.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, ring array<double>")
    assert [r.a for r in df.select("i", polygon_area(F.col("ring")).alias("a")).orderBy("i").collect()] == [6.0, 4.0, 0.0, 0.0, 10.0]
    masks = spark.createDataFrame([(0, [rings[0], rings[1]]), (1, []), (2, None)], "i int, rings array<array<double>>")
    assert [r.a for r in masks.select("i", mask_area(F.col("rings")).alias("a")).orderBy("i").collect()] == [10.0, 0.0, 0.0]


def test_pairs_of_a_long_record(spark):
    df = spark.range(1500).select(F.lit(1).alias("record"), F.col("id").alias("item")).union(spark.createDataFrame([(2, 5), (2, 5), (2, None)], "record int, item long"))
    found = co.set_cooccurrence(df, "record", "item")
    assert found.count() == 1500 * 1501 // 2 and found.where("hi = 5 and lo = 5").first().n == 2
    bags = co.bag_cooccurrence(df.where("record = 2 or item < 40"), "record", "item")
    assert {(r.hi, r.lo): r.n for r in bags.where("hi <= 6 and lo = 5").collect()} == {(5, 5): 1 + 3, (6, 5): 1}


def test_small_right_side_uses_many_keys(spark):
    """One block of items meets many blocks of queries under as many keys as there are groups of query blocks."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 4))
    left = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(vectors)], "q long, v array<double>, target long")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "k long, v array<double>")
    grid = ve.score_grid(left, right, "q", "k", "v", 10)
    assert grid.count() == 40 and "_salt" not in grid.columns
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    items = np.array([r.v for r in right.orderBy("k").collect()])
    scores = np.round(vectors @ items.T, 9)
    got = {r.q: r["rank"] for r in ve.rank_of_target(left, right, "q", "k", "v", "target", 10).collect()}
    for i in range(400):
        mine = scores[i, i % 7]
        assert got[i] == 1 + sum(s > mine or (s == mine and k < i % 7) for k, s in enumerate(scores[i]) if k != i % 7)
