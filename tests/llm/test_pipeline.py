"""Each stage of the pipeline against plain loops over its own input, on tables with every odd case."""

import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scenetally.llm import common, personal_data, toxicity
from scenetally.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, _score double, _gone long, _key string,"
    " _dropped long, score string, id int, n long"
)
STAGES = dict(corpus_pipeline.STAGES)


def row(i, text):
    return (i, text, "en" if i else None, None, None, 0.5, i, "k", 1, "s", 1, 2)


@pytest.fixture(scope="module")
def odd(spark):
    """The given documents with clashing columns, nulls, empty and long texts, repeated rows and repeated ids."""
    prepare(spark)
    given = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    extra = [(100_003, a), (100_007, a), (100_007, b), (100_003, a), (None, a), (None, None), (100_008, ""), (100_009, None), (100_010, " \n ")]
    extra += [(100_011, "w " * 50_000 + a[::-1]), (100_012, "write to a.b@c.org or 10.0.0.1"), *given[:5]]
    return spark.createDataFrame([row(*r) for r in [*given, *extra]], SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_toxicity_stage(spark, odd):
    model = toxicity.train(odd, common.read(spark, FOLDER, "labels"))
    want = [tuple(r) for r in odd.collect()]
    texts = sorted({r[1] or "" for r in want})
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    found = toxicity.features([t.encode() for t in texts])
    rejected = {t for t, f in zip(texts, found) if 1 / (1 + 2.718281828459045 ** -(sum(weights.get(p, 0.0) for p in f.tolist()) + model[2])) >= 0.7}
    assert rejected
    out = STAGES["toxicity"](spark, odd, FOLDER)
    assert out.columns == odd.columns and rows_of(out) == sorted((r for r in want if (r[1] or "") not in rejected), key=str)


def test_copies_stage(spark, odd):
    rows = [tuple(r) for r in odd.collect()]
    sets = [(r[0], shingles(r[1])) for r in rows]
    nodes = sorted({i for i, s in sets if i is not None and s})
    least = {i: i for i in nodes}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    by = {}
    for i, s in sets:
        if i is not None and s:
            by.setdefault(s, []).append(i)
    groups = list(by.items())
    whole = {s: min(ids) for s, ids in groups}
    for x, (s, _) in enumerate(groups):
        for t, _ in groups[:x]:
            common_ = len(s & t)
            if 100 * common_ >= 75 * (len(s) + len(t) - common_):
                a, b = sorted((top(whole[s]), top(whole[t])))
                least[b] = a
    want = [r for r, (i, s) in zip(rows, sets) if i is None or not s or top(whole[s]) == i]
    out = STAGES["near_duplicates"](spark, odd, FOLDER)
    assert out.columns == odd.columns and rows_of(out) == sorted(want, key=str)
    assert len([r for r in want if r[0] == 100_007]) == 1 and len(want) < len(rows)


def test_benchmark_stage(spark, odd):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist():
        w = words(item["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[k : k + 10]), set()).add(tuple(w[k : k + 10]))

    def hit(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in held for n, held in windows.items() for i in range(len(w) - n + 1))

    rows = [tuple(r) for r in odd.collect()]
    want = [r for r in rows if not hit(r[1])]
    out = STAGES["decontamination"](spark, odd, FOLDER)
    assert out.columns == odd.columns and rows_of(out) == sorted(want, key=str) and len(want) < len(rows)


def test_personal_data_stage(spark, odd):
    model = personal_data.sampled_model(odd)
    texts = [r.text for r in odd.select("text").collect()]
    _, every = personal_data.find([t or "" for t in texts], model)
    want = []
    for t, spans in zip(texts, every):
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
            if a >= done:
                out += [t[done:a], f"<{personal_data.KINDS[kind].upper()}>"]
            done = max(done, b)
        want.append(None if t is None else "".join([*out, t[done:]]))
    out = STAGES["personal_data"](spark, odd, FOLDER)
    assert out.columns == odd.columns
    got = [(r.text, r.n_chars) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((t, None if t is None else len(t)) for t in want), key=str)
    assert "write to <EMAIL> or <IP>" in want


def test_bpe_stage(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [tuple(r) for r in odd.collect()]
    want = sorted(((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in STAGES["bpe"](spark, odd, FOLDER).collect()), key=str) == want


def test_stages_take_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), FOLDER)
        assert out.count() == 0 and (name == "bpe" or out.columns == odd.columns), name


def test_whole_run(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    end = corpus_pipeline.run(spark, FOLDER)
    assert 0 < end.count() < docs.count() and end.select("doc_id").distinct().count() == end.count()


def test_samples_never_vanish(spark):
    hashed = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    assert hashed.where(common.chosen(F.col("h"), 6000, 5000)).count() == 100_000
    assert 900 < hashed.where(common.chosen(F.col("h"), 1000, 100_000)).count() < 1100
    for total in (10**11, 10**14, 10**18):
        some = spark.sql(f"SELECT {((6000 << 63) // total - 1) * 2}L AS h UNION ALL SELECT -1L")
        assert [r.h for r in some.where(common.chosen(F.col("h"), 6000, total)).collect()] == [((6000 << 63) // total - 1) * 2]
