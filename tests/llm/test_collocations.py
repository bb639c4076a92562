"""Stripes against plain counting of all phrases."""

import random
import re
from collections import Counter

import pytest

from scenetally.llm import collocations
from scenetally.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, prefix string, next string, n long"


def plain(rows, least, first):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    inside = Counter()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in often.items():
        if 100 * inside[lang, w] < 100 * a:
            cuts = [(1000 * a * n[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)
    )


def table(seed):
    rng = random.Random(seed)
    words = ["a", "b", "the", "Of", "é", "字", "x\x1cy", "a b", "q" * 40]
    rows = []
    for i in range(150):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(words) if rng.random() < 0.7 else "one TWO three four five six")
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b", "\r\n"]))
        rows.append((rng.choice(["en", "de", None, ""]), "".join(out)))
    rows += [("en", None), ("en", ""), ("en", " \n "), ("de", "same words here again and again " * 30)]
    return rows + rows[:20]


@pytest.mark.parametrize("least,bits", [(5, 1 << 25), (5, 64), (1, 1 << 25), (40, 1 << 12)])
def test_equals_plain_counts(spark, least, bits):
    prepare(spark)
    rows = table(least)
    df = spark.createDataFrame([(i, t, lang, "p", "x", 1) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)
    found = collocations.stripes(df, least=least, filter_bits=bits)
    got = collocations.ranked(collocations.collocations(found), 50).collect()
    want = plain(rows, least, 50)
    assert sorted(tuple(r) for r in got) == want and len(want) > 10


def test_flushes_change_nothing(spark):
    """Counters that are sent on after every batch and merged by Spark."""
    rows = table(9)
    df = spark.createDataFrame([(i, t, lang, "p", "x", 1) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(2)
    before = collocations.HELD, collocations.KNOWN_WORDS, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        collocations.HELD, collocations.KNOWN_WORDS = 10, 5
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        parts = collocations.word_counts(df.selectExpr("coalesce(lang, 'und')", "text"))
        assert parts.count() > 400
        got = collocations.ranked(collocations.collocations(collocations.stripes(df, least=5)), 50).collect()
    finally:
        collocations.HELD, collocations.KNOWN_WORDS = before[:2]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[2])
    assert sorted(tuple(r) for r in got) == plain(rows, 5, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collocations.ranked(collocations.collocations(collocations.stripes(df))).count() == 0
