"""Phrase collocations by stripes: a prefix of one to four words keys an associative counter of its next words.

Stripes are built in each task and merged elementwise. One structure gives everything: an entry (prefix, next, n) is the
frequency of an extension, and so of every part of a cut; the words alone are the stripe of the empty prefix, whose sum by
language is n; the maxima of entries by prefix, and by the phrase without its first word, tell what a longer phrase
subsumes. A merged stripe is held as rows, so the stripe of a hot word lies in many tasks.

A phrase is as rare as its rarest part, so there are three scans: words; pairs of neighbouring frequent words, by a 64-bit
hash only; phrases of two to five words all of whose pairs are frequent. What reaches ``least`` in the first two sets bits
in a filter of at most ``FILTER_BITS`` bits, all that is broadcast; a full filter or a collision only lets more through.
Phrases are told apart by the 64-bit hashes of their words, with the language; the words come back by a join at the end.

Defined results: null text is empty; null language is ``und``; a word is what lies between blanks and tabs, a phrase never
crosses one of ``.,;:!?`` or a line break (\\n, \\v, \\f, \\r) and never a document; repeated rows count each; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scenetally.llm.common import LOWER, NOT_SPACE, Words, batch_of, frugal, keep, mix, texts

LONGEST = 5
FILTER_BITS = 1 << 25
KNOWN_WORDS = 400_000
HELD = 1 << 20

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else LOWER[b] for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.int64(0xFFFFFFFF)

WORDS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
STRIPES = T.StructType(
    [T.StructField("prefix", T.BinaryType()), T.StructField("next", T.LongType()), T.StructField("n", T.LongType())]
)


class Stripes(NamedTuple):
    """words: (key, lang, word, a); sizes: (lang, n); phrases: (key, a). A key is the 8-byte hashes of the words in a row."""

    words: DataFrame
    sizes: DataFrame
    phrases: DataFrame


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Vocabulary:
    """Numbers of the words of one language that a task has met, and their hashes. 0 is a break."""

    def __init__(self, lang: str):
        self.ids, self.hashes = _Ids({_BREAK: 0}), np.zeros(1, dtype=np.uint64)
        self.salt = np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest()))

    def numbers(self, docs: list[bytes]) -> np.ndarray:
        """Words of all texts, with a break between pieces."""
        words = _BREAK.join(docs).translate(_TABLE).replace(_BREAK, b" \xff ").split()
        old = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.ids) > old:
            fresh = Words([b" ".join(list(self.ids)[old:])], NOT_SPACE).hashes()
            self.hashes = np.concatenate([self.hashes, mix(fresh + self.salt)])
        return out


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    docs, langs = texts(batch.column(1)), batch.column(0).to_pylist()
    for lang in sorted(set(langs)):
        yield lang, [d for d, x in zip(docs, langs) if x == lang]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD + second)


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has each key."""
    at = keys >> np.uint64(64 - (len(bits) * 64 - 1).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n), partly summed; the null word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Vocabulary, list]] = {}

        def out():
            for lang, (v, counts) in held.items():
                n = counts[0][1:]
                words = pa.array(list(v.ids)[1:], type=pa.binary()).cast(pa.string())
                yield batch_of(WORDS, [[lang] * len(n), words, v.hashes[1:].view(np.int64), n])
                yield batch_of(WORDS, [[lang], [None], [None], [int(n.sum())]])
            held.clear()

        for b in batches:
            for lang, docs_ in _by_language(b):
                v, counts = held.setdefault(lang, (Vocabulary(lang), [np.zeros(0, dtype=np.int64)]))
                found = np.bincount(v.numbers(docs_), minlength=len(v.ids))
                found[: len(counts[0])] += counts[0]
                counts[0] = found
            if sum(len(v.ids) for v, _ in held.values()) > KNOWN_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(frugal(run), WORDS)


class _Held:
    """Phrases of one language in a task, as up to five word numbers in three columns, each with its count."""

    def __init__(self, lang: str):
        self.vocabulary, self.parts, self.size = Vocabulary(lang), [], 0

    def add(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> None:
        self.parts.append((first, second, third, np.ones(len(first), dtype=np.int64)))
        self.size += len(first)

    def merge(self) -> None:
        a, b, c, n = (np.concatenate(x) for x in zip(*self.parts))
        scrambled = mix(mix(a.view(np.uint64) + _ODD) + b.view(np.uint64) * _ODD + c.view(np.uint64))
        order = np.argsort(scrambled)  # equal phrases meet; should unequal ones mix, they are only merged less
        a, b, c, n = (x[order] for x in (a, b, c, n))
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        at = np.flatnonzero(fresh)
        self.parts = [(a[at], b[at], c[at], np.add.reduceat(n, at))]
        self.size = len(at)

    def hashed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word hashes, counts) of the phrases of each length."""
        if not self.size:
            return
        self.merge()
        a, b, c, n = self.parts[0]
        words = np.stack([a >> 32, a & _LOW, b >> 32, b & _LOW, c], axis=1)
        length = (words > 0).sum(1)
        for k in range(2, LONGEST + 1):
            at = length == k
            if at.any():
                yield self.vocabulary.hashes[words[at, :k]], n[at]


def stripe_counts(docs: DataFrame, words_filter, pairs_filter=None) -> DataFrame:
    """(prefix, next, n), partly merged: phrases of words and pairs in both filters, or pair hashes under a null prefix."""

    def add(held: _Held, ids: np.ndarray) -> None:
        hashes = held.vocabulary.hashes
        usual = _set(words_filter.value, hashes)
        usual[0] = False
        usual = usual[ids]
        joined = usual[:-1] & usual[1:]
        at = np.flatnonzero(joined)
        if pairs_filter is not None:
            often = _set(pairs_filter.value, _pair(hashes[ids[at]], hashes[ids[at + 1]]))
            joined[at] = often
            at = at[often]
        joined = np.append(joined, [False] * LONGEST)
        first = ids[at] << 32 | ids[at + 1]
        zero = np.zeros(len(at), dtype=np.int64)
        held.add(first, zero, zero)
        if pairs_filter is None:
            return
        second, third = zero, zero
        for k in range(3, LONGEST + 1):
            on = joined[at + k - 2]
            at, first, second, third = at[on], first[on], second[on], third[on]
            if k == 3:
                second = ids[at + 2] << 32
            elif k == 4:
                second = second | ids[at + 3]
            else:
                third = ids[at + 4]
            held.add(first, second, third)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}

        def out():
            for h in held.values():
                for words, n in h.hashed():
                    if pairs_filter is None:
                        yield batch_of(STRIPES, [[None] * len(n), _pair(words[:, 0], words[:, 1]).view(np.int64), n])
                        continue
                    k = words.shape[1] - 1
                    data = pa.py_buffer(words[:, :k].astype(">u8").tobytes())
                    prefix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * k), len(n), [None, data])
                    yield batch_of(STRIPES, [prefix, words[:, k].view(np.int64), n])
            held.clear()

        for b in batches:
            for lang, docs_ in _by_language(b):
                h = held.setdefault(lang, _Held(lang))
                add(h, h.vocabulary.numbers(docs_))
            if sum(h.size for h in held.values()) > HELD:
                for h in held.values():
                    if h.size:
                        h.merge()
            if sum(h.size for h in held.values()) > HELD // 2 or sum(len(h.vocabulary.ids) for h in held.values()) > KNOWN_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(frugal(run), STRIPES)


def filter_of(hashes: DataFrame, most_bits: int = FILTER_BITS):
    """Broadcast bits of a table of one column of hashes; 16 bits a hash, ``most_bits`` at most."""
    size = min(most_bits, max(1 << 12, 1 << (16 * hashes.count()).bit_length()))
    at = F.expr(f"shiftrightunsigned({hashes.columns[0]}, {64 - (size - 1).bit_length()})")
    rows = (
        hashes.select(at.alias("at"))
        .groupBy(F.expr("at div 64").alias("place"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
        .toArrow()  # at most size / 64 rows
    )
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def stripes(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, filter_bits: int = FILTER_BITS
) -> Stripes:
    """Merged stripes: all words and phrases that occur ``least`` times."""
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    often = F.col("a") >= least
    words = keep(word_counts(read).groupBy("lang", "word", "hash").agg(F.sum("n").alias("a")).where(often | F.col("word").isNull()))
    usual = words.where("word is not null")
    words_filter = filter_of(usual.select("hash"), filter_bits)
    pairs = stripe_counts(read, words_filter).groupBy("next").agg(F.sum("n").alias("a")).where(often)
    pairs_filter = filter_of(keep(pairs.select("next")), filter_bits)
    merged = stripe_counts(read, words_filter, pairs_filter).groupBy("prefix", "next").agg(F.sum("n").alias("a")).where(often)
    eight = "unhex(lpad(hex({}), 16, '0'))".format
    return Stripes(
        usual.select(F.expr(eight("hash")).alias("key"), "lang", "word", "a"),
        words.where("word is null").select("lang", F.col("a").alias("n")),
        keep(merged.select(F.expr(f"concat(prefix, {eight('next')})").alias("key"), "a")),
    )


def collocations(found: Stripes) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one subsumes."""
    phrases, words = found.phrases, found.words
    every = words.select("key", "a").union(phrases)
    parts = F.expr("explode(array(substring(key, 1, length(key) - 8), substring(key, 9)))")
    longer = phrases.select(parts.alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    left = phrases.join(longer, "key", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = left.select("key", "a", F.expr("explode(sequence(1, cast(length(key) / 8 as int) - 1))").alias("k")).select(
        "key", "a", "k", F.expr("substring(key, 1, 8 * k)").alias("head"), F.expr("substring(key, 8 * k + 1)").alias("rest")
    )
    sized = cuts.join(every.select(F.col("key").alias("head"), F.col("a").alias("l")), "head").join(
        every.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest"
    )
    # the words of each phrase, and the language of the first
    at = F.expr("explode(sequence(1, cast(length(key) / 8 as int)))")
    spelled = (
        left.select("key", at.alias("i"))
        .withColumn("one", F.expr("substring(key, 8 * i - 7, 8)"))
        .join(words.select(F.col("key").alias("one"), "lang", "word"), "one")
        .groupBy("key", "lang")
        .agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
        .select("key", "lang", F.expr("array_join(transform(w, x -> x.word), ' ')").alias("phrase"))
    )
    sized = sized.join(spelled, "key").join(found.sizes, "lang")
    exact = "cast({} as decimal(17,0))".format
    score = F.expr(f"(1000 * ({exact('a')} * {exact('n')})) div ({exact('l')} * {exact('r')})")
    cut = F.struct(score.cast("long").alias("score"), "k", "l", "r", "n")
    scored = sized.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("cut"))
    return scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def ranked(found: DataFrame, first: int = 2000) -> DataFrame:
    """The first of each language by score, frequency, then phrase in byte order; each task passes on at most as many."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    numbered = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return numbered.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
