"""Base patterns against plain regular expressions, added spans on planted strings."""

import hashlib
import random
import re
import string

from scenetally.llm import secrets
from scenetally.llm.common import prepare

SCHEMA = "doc_id long, text string, base string, spans string, word string, n long"
ALNUM = string.ascii_letters + string.digits


def plain(text):
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "Key", "toKen", "=", ":", " ", "  ", '"', "'", "\n", "é", "字", "AKIA", "AKIAAKIA", "deadbeef", "0123456789abcdef", "ABCDEFGHIJ012345", "x", ".", "-", "cafe"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "f" * 100_000, "token=" * 3000 + "abcdefghijkl", "tokentoken=abcdefghijkl"]


def test_base_spans_equal_plain_patterns(spark):
    prepare(spark)
    rows = texts(3)
    df = spark.createDataFrame([(i, t, "b", "s", "w", 1) for i, t in enumerate([*rows, None, rows[5]])], SCHEMA)
    found = secrets.report(secrets.spans(df, secrets.identifier_dictionary(df))).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        text = [*rows, None, rows[5]][r.doc_id] or ""
        want = plain(text)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] != "novel"] == [s.split(":") for s in listed.split(",") if s]
        for kind, a, b in spans:
            assert kind != "novel" or not any(s < int(b) and int(a) < e for s, _, e in want)


def planted(seed, n=300):
    rng = random.Random(seed)
    code = [f"    {a} = self.{b}({c}, retries={rng.randint(0, 9)})" for a, b, c in (rng.choices(["handler", "request", "settings", "builder", "session"], k=3) for _ in range(40))]
    out = []
    for i in range(n):
        secret = "".join(rng.choice(ALNUM) for _ in range(rng.randint(18, 40)))
        line = rng.choice(['export AUTH_COOKIE="{}"', "Authorization: Bearer {}", "pwd -> {}", "é credentials ({})"]).format(secret)
        body = rng.choices(code, k=rng.randint(0, 30))
        at = rng.randint(0, len(body))
        out.append(("\n".join([*body[:at], line, *body[at:]]), secret))
    return out


def test_random_strings_are_novel_and_repeated_identifiers_are_not(spark):
    cases = planted(1)
    usual = ['credential = RequestHandlerFactory2.create("SessionSettingsBuilder")'] * 40
    texts_ = [t for t, _ in cases] + usual
    df = spark.createDataFrame([(i, t, "b", "s", "w", 1) for i, t in enumerate(texts_)], SCHEMA)
    words = secrets.identifier_dictionary(df)
    assert b"RequestHandlerFactory" in words and len(words) <= secrets.DICTIONARY + 1
    hit = clean = 0
    for r in secrets.spans(df, words).collect():
        added = [texts_[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "novel"]
        if r.doc_id < len(cases):
            hit += added == [cases[r.doc_id][1]]
        else:
            clean += not added
    assert clean == len(usual) and hit >= 0.95 * len(cases)


def test_whole_texts_and_empty_tables(spark):
    secret = planted(2, 1)[0][1]
    text = "word " * 300_000 + f"\nmy cookie > {secret} " + "token " * 20_000
    df = spark.createDataFrame([(1, text, "b", "s", "w", 1)], SCHEMA)
    words = secrets.identifier_dictionary(df.limit(0))
    spans = secrets.spans(df, words).first().spans
    assert [text[s.start : s.end] for s in spans] == [secret]
    assert secrets.report(secrets.spans(df.limit(0), words)).count() == 0
