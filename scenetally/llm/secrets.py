"""Secrets: base patterns, and novelty under zstandard primed with identifiers.

Base spans (assign, access, hex) are exact rules on the whole text. The method adds strings in a sensitive context that
the patterns miss. A candidate is a token of at least ``LEAST`` characters of two kinds (small letter, capital, digit)
that follows a sensitive word on its line. Its novelty is the number of bytes by which the compressed surrounding code
grows when the candidate stands in its place: the compressor is primed with a dictionary of identifiers, and the
surrounding code is up to ``AROUND`` bytes on either side without the candidates themselves. Identifiers, paths and words
that code repeats compress; a random string does not and is reported at ``NOVEL`` bytes a character or more.

The dictionary holds the identifiers (letters and underscores) that stand around sensitive words in the most documents.
They are counted over all documents; ``DICTIONARY`` bytes of them, the most frequent last, are kept, as is usual for such
dictionaries. Each candidate of every whole text is measured.

Defined results: null text is empty; offsets are code points, end exclusive; spans are listed by start, then kind in the
order of KINDS; an added span never touches a base span; rows that repeat are judged row by row; without identifiers the
dictionary is the built-in one; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import batch_of, frugal, texts

KINDS = ("assign", "access", "hex", "novel")
LEAST = 12
REACH, AROUND = 48, 768
NOVEL = 0.9
DICTIONARY = 32 << 10
LEAST_DOCS = 3
LEVEL = 9

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
# words that make their line sensitive
_SENSITIVE = (
    b"password", b"passwd", b"passphrase", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"accesskey",
    b"access_key", b"access-key", b"privatekey", b"private_key", b"private-key", b"authorization", b"bearer", b"credential",
    b"session_id", b"sessionid", b"cookie", b"signature", b"client_id", b"accountkey", b"connectionstring",
)
_WORD_REST = re.compile(rb"[A-Za-z0-9_]*")
_TOKEN = re.compile(rb"[A-Za-z0-9+/_=~.!@$%%^&*-]{%d,}" % LEAST)
_KINDS_OF = (re.compile(rb"[a-z]"), re.compile(rb"(?<!^)[A-Z]"), re.compile(rb"[0-9]"))
_IDENTIFIER = re.compile(rb"[A-Za-z_]{4,}")
_EDGES = b"+/_=~.!@$%^&*-"
BUILT_IN = (
    b" public static final String return self.config.get(\"\") os.environ[\"\"] import from const let var function"
    b" username password secret token api_key access_key private_key client_id client_secret authorization: Bearer"
    b" abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)

Span = tuple[int, int, int]  # start, kind, end


def _places(low: bytes, words: tuple[bytes, ...]) -> list[int]:
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + 1)
    return sorted(set(out))


def base_spans(text: bytes) -> list[Span]:
    """Byte spans of the base patterns; matches of one kind never overlap, failing ones still use up their text."""
    out: list[Span] = []
    done = 0
    for at in _places(text.lower(), _ASSIGN_WORDS):
        if at >= done and (m := _ASSIGN.match(text, at)):
            done = m.end()
            if len(m[1]) >= 12:
                out.append((at, 0, done))
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    inside = np.concatenate([[False], _HEX[np.frombuffer(text, dtype=np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    long = edges[1::2] - edges[::2] >= 16
    out += [(a, 2, b) for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist())]
    return sorted(out)


def candidates(text: bytes, places: list[int]) -> list[tuple[int, int]]:
    """Tokens of two kinds of characters that begin at most ``REACH`` bytes after a sensitive word of their line."""
    out = set()
    for at in places:
        start = _WORD_REST.match(text, at).end()
        stop = start + REACH + LEAST
        end = text.find(b"\n", start, stop)
        for m in _TOKEN.finditer(text, start, stop if end < 0 else end):
            whole = _TOKEN.match(text, m.start())[0]  # no token holds a line break
            token = whole.strip(_EDGES)
            a = m.start() + whole.index(token)
            if len(token) >= LEAST and sum(bool(k.search(token)) for k in _KINDS_OF) >= 2:
                out.add((a, a + len(token)))
    return sorted(out)


def identifiers(text: bytes, places: list[int]) -> set[bytes]:
    """Identifiers around the sensitive words."""
    out: set[bytes] = set()
    done = 0
    for at in places:
        a, b = max(done, at - AROUND), at + AROUND
        if b > a:
            out.update(_IDENTIFIER.findall(text, a, b))
            done = b
    return out


class Novelty:
    """Marginal compressed bytes under a primed dictionary."""

    def __init__(self, words: bytes):
        primed = zstandard.ZstdCompressionDict(words + BUILT_IN, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.tool = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False)

    def size(self, data: bytes) -> int:
        return len(self.tool.compress(data))

    def of(self, text: bytes, spans: list[tuple[int, int]], i: int) -> int:
        """Bytes that the i-th candidate adds to its surroundings."""
        a, b = spans[i]
        start, end = max(0, a - AROUND), min(len(text), b + AROUND)
        first, last = i, i + 1  # candidates that touch the surroundings
        while first and spans[first - 1][1] > start:
            first -= 1
        while last < len(spans) and spans[last][0] < end:
            last += 1

        def without(start: int, end: int) -> bytes:
            parts, done = [], start
            for s, e in spans[first:last]:
                if s < end and e > done:
                    parts.append(text[done : max(done, s)])
                    done = e
            return b"".join([*parts, text[done:end]])

        before, after = without(start, a), without(b, end)
        return self.size(before + text[a:b] + after) - self.size(before + after)


def find(text: bytes, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans, of one text, in code points."""
    base = base_spans(text)
    every = list(base)
    places = _places(text.lower(), _SENSITIVE)
    if places:
        spans = candidates(text, places)
        starts = [a for a, _, _ in base]
        reach = list(accumulate((b for _, _, b in base), max))
        for i, (a, b) in enumerate(spans):
            k = bisect_left(starts, b)
            if not (k and reach[k - 1] > a) and novelty.of(text, spans, i) >= NOVEL * (b - a):
                every.append((a, 3, b))
    if every and not text.isascii():
        point = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
        base, every = ([(int(point[a]), k, int(point[b])) for a, k, b in spans] for spans in (base, every))
    return base, sorted(every)


# Spark


def identifier_dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> bytes:
    """The identifiers around sensitive words that the most documents have, in ``size`` bytes, the most frequent last."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[bytes] = Counter()
            for text in texts(b.column(0)):
                if places := _places(text.lower(), _SENSITIVE):
                    counts.update(identifiers(text, places))
            if counts:
                yield batch_of(schema, [list(counts), list(counts.values())])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(frugal(run), schema).groupBy("word").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "word").limit(size // 5).collect()
    out, used = [], 0
    for r in often:  # at most size // 5 words of five bytes or more with the blank
        if used + len(r.word) + 1 <= size:
            out.append(bytes(r.word))
            used += len(r.word) + 1
    return b" ".join(reversed(out)) + b" "


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def spans(docs: DataFrame, words: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most DICTIONARY bytes
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", SPANS), T.StructField("spans", SPANS)]
    )

    def named(found: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        for b in batches:
            found = [find(t, novelty) for t in texts(b.column(1))]
            yield batch_of(schema, [b.column(0), [named(x) for x, _ in found], [named(x) for _, x in found]])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(frugal(run), schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of spans()."""
    listed = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        id_col,
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
