"""Adaptive fences against exact fractions over plain lists."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from scenetally.llm import quality

WORDS = [f"w{'abcdefghij'[: k % 10]}{k}" for k in range(300)]


def drawn(seed: int = 5) -> list[tuple]:
    """A large plain group, a group where symbols are usual, small and null groups, and odd texts in each."""
    rng = random.Random(seed)
    rows = []

    def text(n: int, marks: float = 0.0, tail: str = "") -> str:
        return " ".join(rng.choice(WORDS) + ("#" if rng.random() < marks else "") for _ in range(n)) + tail

    for lang, source, n, marks in (("en", "a", 150, 0.0), ("en", "b", 60, 0.5), ("de", None, 30, 0.0), (None, "a", 5, 0.0), ("fr", "x", 1, 0.0)):
        rows += [(text(rng.randrange(50, 400), marks), lang, source) for _ in range(n)]
        rows.append((text(80, 1.0, " ###" * 60), lang, source))
        rows.append((text(60) + "\n" + "\n".join(["one line again"] * 9), lang, source))
        rows.append((" ".join(rng.choice(WORDS) * 5 for _ in range(70)), lang, source))
        rows.append((" ".join(rng.choice("abcdef") for _ in range(70)), lang, source))
    rows += [(None, "en", "a"), ("", "en", "a"), ("too short", "it", "z"), rows[0], rows[0]]
    return [(i, *r) for i, r in enumerate(rows)]


def fences(table):
    return quality.thresholds(quality.keep(quality.sketches(quality.rated(quality.keep(quality.figures(table))))))


def brute_fences(counts: list) -> tuple[dict, dict]:
    def buckets(r) -> dict:
        return {
            "symbol_rate": math.floor(math.log((r.n_symbols + 1) / (r.n_words + 50)) * 100),
            "line_rate": math.floor(math.log((r.n_dup_lines + 1) / (r.n_lines + 10)) * 100),
            "repeat_rate": math.floor(math.log((r.n_repeat_words + 1) / (r.n_words + 50)) * 100),
            "word_length": math.floor(math.log(r.word_chars / r.n_words) * 100),
        }

    passed = [r for r in counts if r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words]
    found = [(r.lang, r.source, buckets(r)) for r in passed]
    out = {}
    for rate in quality.RATES:

        def shares(rows, wider=None):
            n = Counter(b[rate] for _, _, b in rows)
            total = sum(n.values())
            if wider is None:
                return {b: Fraction(k, total) for b, k in n.items()}
            m = total + quality.PRIOR
            return {b: Fraction(n[b], m) + wider.get(b, Fraction(0)) * quality.PRIOR / m for b in {*n, *wider}}

        every = shares(found)
        for lang, source in {(a, b) for a, b, _ in found}:
            wide = shares([x for x in found if x[0] == lang], every)
            own = shares([x for x in found if x[:2] == (lang, source)], wide)

            def at(q):
                reached = Fraction(0)
                for b in sorted(own):
                    reached += own[b]
                    if reached >= q - 1e-9:
                        return b

            high, middle, low = at(quality.UPPER), at(0.5), at(1 - quality.UPPER)
            least = round(math.log(quality.LEAST[rate]) * 100)
            out[lang, source, rate] = (
                low - max(round(quality.REACH * (middle - low)), least),
                high + max(round(quality.REACH * (high - middle)), least),
            )
    return out, {(r.id, r.lang, r.source): buckets(r) for r in passed}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(drawn(), "doc_id long, text string, lang string, source string")


def test_fences_and_verdicts_equal_exact_fractions(table):
    counts = quality.figures(table).collect()
    want, buckets = brute_fences(counts)
    got = {}
    for r in fences(table).collect():
        for rate in quality.RATES:
            got[r.lang, r.source, rate] = r[f"{rate}_most"]
        assert r.word_length_fewest == want[r.lang, r.source, "word_length"][0]
    assert got == {k: v[1] for k, v in want.items()}
    of = {r.id: (r.lang, r.source) for r in counts}
    kept = {r.doc_id: r.kept for r in quality.judged(table).collect()}
    for i, k in kept.items():
        b = buckets.get((i, *of[i]))
        inside = b is not None and all(b[r] <= want[(*of[i], r)][1] for r in quality.RATES)
        assert k == (inside and b["word_length"] >= want[(*of[i], "word_length")][0]), i
    assert 0 < sum(kept.values()) < len(kept)


def test_what_is_usual_in_a_source_stays(table):
    verdicts = quality.judged(table).join(table.drop("text"), "doc_id").collect()
    usual = [r for r in verdicts if r.source == "b" and 0 < r.n_symbols < 250 and not r.base_failed]
    assert len(usual) >= 55 and all(r.kept for r in usual)
    plain = [r for r in verdicts if r.source == "a" and r.lang == "en" and r.n_symbols == 0 and r.n_dup_lines == 0 and not r.base_failed]
    assert sum(r.kept for r in plain) >= 150
    assert not any(r.kept for r in verdicts if r.n_symbols > 200 and r.lang == "en" and r.source == "a")


def test_fences_do_not_depend_on_order_or_parts(spark, table):
    def seen(t):
        return sorted(map(str, fences(t).collect()))

    assert seen(table) == seen(table.orderBy(table.text.desc()).repartition(7))
    more = table.selectExpr("'x' AS _lang", "1 AS bucket", "2 AS rate", "3 AS n", "4 AS high", "*")
    assert sorted(map(str, quality.judged(more).collect())) == sorted(map(str, quality.judged(table).collect()))


def test_no_rows_and_no_passing_row(spark, table):
    assert quality.judged(table.limit(0)).count() == 0
    assert {r.kept for r in quality.judged(table.where("text IS NULL OR length(text) < 20")).collect()} == {False}
