"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import compare, duck
from tokenizers import Tokenizer

import corpus_pipeline
from scenetally.llm import bpe, chat, decontamination, licenses, near_duplicates, personal_data, plans, quality, repeats, toxicity, warc
from scenetally.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, words string, score double"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
EDGE = [None, "", " \n ", "a", "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven", LONG, LONG + " tail", "é" * 300, "x" * 250]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i if i else None, t, None if i == 3 else "en", None, None, 1, 2, "w", 0.5) for i, t in enumerate(EDGE)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare(plans.QUERIES[name](spark, FOLDER), duck(FOLDER), plans.ORACLES[name]) is None


def test_bpe_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, library = bpe.PairIndexBpe(open(path, "rb").read()), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbBhtheinÉé́ \n\tΣσ's<|endoftext|>İß1٣Ⅳ字\0\U0001f600_-.\U00010940") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", "<|startoftext|>hi<|endoftext|>", "a" * 3000, "aaa aaaa aaaaa", *[t or "" for t in EDGE]]
    for text, ids in zip(texts, model.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_edges_and_empty(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.digests(docs, path).count() == len(EDGE)
    assert bpe.digests(docs.limit(0), path).count() == 0
    both = bpe.decode(bpe.encode(docs, path), path).where("doc_id = 3").first()
    assert both.decoded == "a</w>"


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_decontamination_brute_force(spark, docs, block_bytes):
    items = [(1, "two three four"), (2, EDGE[4]), (3, None), (4, " .. "), (None, "one"), (5, "a"), (1, "nine TEN eleven")]
    items = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in ((r.item_id, r.text) for r in items.collect() if r.item_id is not None):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    found = decontamination.search(docs, items, block_bytes=block_bytes).collect()
    assert len(found) == len(EDGE)
    for r in found:
        w, hit, names = words(r.text), set(), set()
        for s, owners in windows.items():
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k : k + len(s)]) == s:
                    hit |= set(range(k, k + len(s)))
                    names |= owners
        runs = {p for a, b in zip(r.hit_runs[::2], r.hit_runs[1::2]) for p in range(a, b)}
        assert (r.n_words, runs, r.item_ids) == (len(w), hit, sorted(names))
    assert decontamination.report(decontamination.search(docs.limit(0), items)).count() == 0
    assert not decontamination.report(decontamination.search(docs, items.limit(0))).where("contaminated").count()


@pytest.mark.parametrize("group", [2, 4096])
def test_repeats_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcdé \0") for _ in range(220)) for _ in range(3)]
    texts = []
    for _ in range(40):
        a = rng.randrange(100)
        texts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + rng.choice(shared)[a : a + rng.randrange(90, 160)] + "q" * rng.randrange(3))
    texts += ["z" * 333, None, "", texts[0], "ab" * 90]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: bytes(r.kept) for r in got}
    seen = set()
    for d, t in enumerate(texts):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cut[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        assert got[d] == bytes(x for x, c in zip(b, cut) if not c), d


def test_repeats_edges(spark, docs):
    out = repeats.report(repeats.remove_repeats(docs.union(docs.where("doc_id = 6")))).where("doc_id = 6").orderBy("n_removed").collect()
    alone = repeats.report(repeats.remove_repeats(docs)).where("doc_id = 6").first().n_removed
    assert [r.n_removed for r in out] == [alone, len(LONG)] and alone < len(LONG)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_near_duplicate_groups(spark, docs):
    found = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert found[5].component_id == 4 and found[7].component_id == 6 and found[6].kept and not found[7].kept
    assert found[2].n_shingles == 0 and found[2].kept and found[None].kept
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    other = np.concatenate([base[:350], rng.integers(0, 2**63, 50).astype(np.uint64)])
    a, b = near_duplicates.sketch(base, 560), near_duplicates.sketch(other, 560)
    assert abs((a == b).mean() - 350 / 450) < 0.08
    assert (near_duplicates.sketch(base[:1], 560) != np.uint64(2**64 - 1)).all()


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (7, 9), (2, 3), (8, 8)], "a long, b long")
    assert {r.id: r.component for r in near_duplicates.components(links).collect()} == {5: 4, 9: 4, 7: 4, 3: 2}
    assert near_duplicates.components(links.limit(0)).count() == 0


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("ab@@..1234500  -+()%_9é") for _ in range(rng.randint(0, 40)))
        assert brute_spans(t) == sorted(personal_data.base_spans(t))


def test_field_adds_and_keeps(spark, docs):
    said = [(i, f"Call +1 ({200 + i}) 555-{1000 + i} or write a{i}@b.org, version 2.{i} of item {i}.") for i in range(200)]
    table = spark.createDataFrame([*said, (900, "Now (321) 555-7788 is it."), (901, None)], "doc_id long, text string")
    model = personal_data.train(personal_data.labelled_runs(table.where("doc_id < 900"), "text"))
    found = {r.doc_id: r for r in personal_data.spans(table, model).collect()}
    assert [(s.kind, s.start, s.end) for s in found[900].spans] == [("phone", 4, 18)] and not found[900].base
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found.values()) and not found[901].spans
    assert personal_data.masked(table, model).where("doc_id = 0").first().text == "Call <PHONE> or write <EMAIL>, version 2.0 of item 0."
    assert personal_data.masked(docs, None).count() == len(EDGE)
    assert personal_data.train(personal_data.labelled_runs(docs.limit(0), "text")) is None


def test_toxicity_held_out(spark, docs):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        words = [f"v{rng.randrange(300)}" for _ in range(40)] + (["rotten", "fool"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.drop("toxic"), table.drop("text"))
    got = toxicity.score(table, model).join(table, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert sum((r.score >= 0.7) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    assert toxicity.score(docs, model).count() == len(EDGE)
    none = toxicity.train(docs, table.drop("text").limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_rules_brute_force(spark, docs):
    texts = [*EDGE, "a b c a b c a b c", "# # |\n# # |\n\n \nx", "l1 x\nl1 x\r\nl1 x"]
    rows = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.judged(rows).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w))
    assert quality.judged(docs.limit(0)).count() == 0 and quality.judged(docs).count() == len(EDGE)


def test_rules_form_feeds_and_lines_of_f(spark):
    texts = ["f\nff\nf\nff", "\f\n\f\nx", "\f\f\nf\nf\n \f"]
    rows = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.id: (r.n_lines, r.n_dup_lines) for r in quality.figures(rows).collect()}
    assert got == {0: (4, 2), 1: (1, 0), 2: (2, 1)}


def test_reply_trees(spark):
    nasty = ["<|im_end|>\\<|<\\|<\\~\n", "\\\\<|", None]
    nodes = [(1, 1, None, "user", nasty[0], 0.0), (1, 2, 1, "assistant", nasty[1], 5.0), (1, 3, 1, "assistant", "no", 1.0)]
    nodes += [(1, 4, 2, "us\ner<|", nasty[2], 0.0), (2, 1, 2, "user", "circle", 0.0), (2, 2, 1, "user", "circle", 0.0), (None, 7, 99, None, "root", None)]
    table = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    out = {r.tree: r for r in chat.read_back(chat.formatted(table)).collect()}
    assert set(out) == {1, None}  # a circle is no conversation
    assert [(t.role, t.text) for t in out[1].turns] == [("user", nasty[0]), ("assistant", nasty[1]), ("us\ner<|", "")]
    assert out[1].loss_text == nasty[1] and out[1].leaf == 4 and out[None].formatted == "<|im_start|>\nroot<|im_end|>\n"
    assert len(chat.formatted(table, n_best=2).where("tree = 1").collect()) == 2
    assert chat.formatted(table.limit(0)).count() == 0


def test_warc_segments_and_damage(spark, tmp_path):
    body = ("<html>é WARC/1.1\r\n\r\n" * 3000).encode()
    pages = spark.createDataFrame(
        [(5, None, body.decode(), 1), (2, "http://a b\r\n", body.decode(), 1), (3, "u", None, 1), (4, "u", "", 1), (9, "u", "x" * 99, 1), (8, "u", "x" * 99, 1)],
        "page_id long, url string, html string, digest int",
    )
    got = {r.page_id: r for r in warc.round_trip(pages, least_bytes=100, folder=str(tmp_path / "a"), segment_bytes=500).collect()}
    assert got[5].record_type == "revisit" and got[5].refers_to == 2 and got[5].payload_bytes == len(body)
    assert got[2].payload_digest == got[5].payload_digest == hashlib.sha256(body).hexdigest()
    assert {k for k, r in got.items() if r.record_type == "response"} == {2, 3, 4, 8, 9} and got[3].payload_bytes == 0
    parts = warc.segments(spark, str(tmp_path / "a"), whole=False)
    assert bytes(warc.reassemble(parts).first().block) == body
    assert warc.reassemble(parts.where("segment <> 2")).first().block is None
    assert warc.round_trip(pages.limit(0), folder=str(tmp_path / "b")).count() == 0


def test_license_families(spark, docs):
    rng = random.Random(6)
    plain = [" ".join(f"u{rng.randrange(400)}" for _ in range(12)) for _ in range(300)]
    rows = [(i, p) for i, p in enumerate(plain)] + [(1000 + k, "Hello there.\n" + n[0]) for k, n in enumerate(licenses.NOTICES.values())]
    table = spark.createDataFrame([*rows, (2000, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert len(got) == len(rows) + 1 and got[2000].n_paragraphs == 0
    for k, family in enumerate(licenses.NOTICES):
        assert got[1000 + k].families == got[1000 + k].confirmed == family
    assert not any(got[i].families for i in range(300))


def test_license_wordings(spark):
    """Every notice of every family is confirmed, other licences and plain lines are not, and cuts come from held-out rows."""
    rng = random.Random(7)
    plain = [" ".join(f"u{rng.randrange(400)}" for _ in range(12)) for _ in range(300)]
    fresh = {
        "apache-2.0": "Code is licensed under the Apache License, Version 2.0, see the file LICENSE.",
        "mit": "(c) 2019 A. Body. Released under the MIT License.",
        "gpl-3.0": "You may redistribute and/or modify it under the terms of the GNU General Public License, version 3.",
        "cc-by-nc": "All texts are shared under CC BY-NC 4.0, for non-commercial use only.",
    }
    wanted = [(f, t) for f in licenses.NOTICES for t in [*licenses.NOTICES[f], *licenses.HELD_OUT[f], fresh[f]]]
    others = ["This software is distributed under the terms of the BSD License.", "Distributed under the GNU GPL, version 2.", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"]
    rows = [*enumerate(plain), *((1000 + i, t) for i, (_, t) in enumerate(wanted)), *((2000 + i, t) for i, t in enumerate(others))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    training = licenses.training_table(table)
    held = {r.label for r in training.where("held_out").select("label").distinct().collect()}
    assert held == {-1, 0, 1, 2, 3}
    got = {r.doc_id: (r.families, r.confirmed) for r in licenses.scan(table).collect()}
    assert [(t, got[1000 + i]) for i, (f, t) in enumerate(wanted) if got[1000 + i] != (f, f)] == []
    assert [(t, got[2000 + i]) for i, t in enumerate(others) if got[2000 + i][1]] == []
    assert not any(got[i][0] for i in range(300))
