"""Byte-pair encoding and decoding with a pair occurrence index.

All new words of a batch lie in one flat symbol list with links to the neighbours. The index maps every mergeable pair
to its positions; active ranks are taken in ascending order, all positions of a rank are merged at once, and only the
lists of the neighbouring pairs are updated. Words do not touch each other, so this equals merging word by word.

Vocabulary files have the public JSON form of a BPE with end-of-word suffix, NFC + white space + lower case
normalisation, the word pattern of the file and byte-level symbols. The file's bytes are broadcast (bound below).

Defined results: null and empty text give no ids and an empty decoded text; strings of special tokens in a text become
the special ids, like in the tokenizers library; other columns are ignored; each input row gives one row.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from scenetally.llm.common import batch_of, frugal

FILE_BYTES = 64 << 20
KEEP_WORDS, KEEP_BYTES = 150_000, 4 << 20
BEYOND = re.compile("[԰-\U0010ffff]")  # every code point below is assigned


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points that Python's Unicode version leaves unassigned."""
    gaps, start = [], None
    for c in range(0x530, 0x110001):
        empty = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if empty and start is None:
            start = c
        elif not empty and start is not None:
            gaps.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile("[" + "".join(gaps) + "]")


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_symbols()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.final = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.pattern, self.content, self.library = pattern, content, None
        names = dict(vocab) | self.special
        self.token = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.token[i] = name.encode()
        self.clear()

    def clear(self) -> None:
        # special tokens are known from the start, under their string behind a NUL
        self.known: dict[str, int] = {"\0" + s: k for k, s in enumerate(self.special)}
        self.pool = np.array(list(self.special.values()), dtype=np.uint32)
        self.begin = np.arange(len(self.special), dtype=np.int64)
        self.length = np.ones(len(self.special), dtype=np.int64)
        self.held = 0

    # text to words

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter on its own: no final sigma
        return text.lower()  # white space only parts words, so it needs no replacement

    def plain(self, text: str) -> list[str]:
        """Words of text without special tokens."""
        if not text.isascii() and BEYOND.search(text) and _unassigned().search(text):
            # code points of a Unicode version that Python does not have: classes and cases of the library's version
            if self.library is None:
                self.library = Tokenizer.from_str(self.content.decode())
                self.split_words = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            normal = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.split_words.pre_tokenize_str(normal)]
        return self.words.findall(self.normalise(text))

    def pieces(self, text: str) -> list[str]:
        """Words, and the strings of special tokens with a leading NUL."""
        if self.split is None or "<|" not in text:
            return self.plain(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self.plain(part)
        return out

    # words to ids

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(flat)
        first = np.cumsum(lengths) - lengths
        last = first + lengths - 1
        symbol = np.full(n + 1, -1, dtype=np.int64)
        symbol[:n] = self.inner[flat]
        symbol[last] = self.final[flat[last]]
        after = np.arange(1, n + 2)
        after[last] = n
        before = np.arange(-1, n)
        before[first] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[after[at] != n]
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            at = at[symbol[at] == self.left[r]]
            at = at[symbol[after[at]] == self.right[r]]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:  # in a chain of equals, every second one from the left
                joined = np.concatenate([[False], at[1:] == after[at[:-1]]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            note(np.unique(np.concatenate([left[left != n], at])))
        live = symbol[:n] >= 0
        count = np.add.reduceat(live, first) if n else np.zeros(0)
        return symbol[:n][live].astype(np.uint32), count.astype(np.int64)

    def encode(self, docs: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > KEEP_WORDS or self.held > KEEP_BYTES:
            self.clear()
        known, fresh, places = self.known, [], []
        for d in docs:  # the words of one text at a time; what stays of them is four bytes each
            words = self.pieces(d)
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
            places.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
        if fresh:
            coded = [w.encode() for w in fresh]
            self.held += sum(map(len, coded))
            ids, count = self.merge(coded)
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(count) - count])
            self.length = np.concatenate([self.length, count])
            self.pool = np.concatenate([self.pool, ids])
        out = []
        for at in places:
            size = self.length[at]
            total = int(size.sum())
            place = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(total)
            out.append(self.pool[place].astype("<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> bytes:
        """The file names no decoder, so tokens are joined by a space."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _shared(df: DataFrame, path: str):
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes, too large to broadcast")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as packed little-endian unsigned 32-bit integers. ``path``: a vocabulary file on the driver."""
    shared = _shared(df, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairIndexBpe(shared.value)  # gone with the task: idle workers take turns, each would keep one
        for b in batches:
            yield batch_of(schema, [b.column(0), model.encode(["" if x is None else x for x in b.column(1).to_pylist()])])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(frugal(run), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of packed ids; null ids give an empty text."""
    shared = _shared(df, path)
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    at = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairIndexBpe(shared.value)  # gone with the task: idle workers take turns, each would keep one
        for b in batches:
            decoded = pa.array([model.decode(x or b"") for x in b.column(at).to_pylist()], type=pa.binary())
            yield batch_of(schema, [*b.columns, decoded.cast(pa.string())])

    return df.select(*[f.name for f in kept]).mapInArrow(frugal(run), schema)


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass, so a task needs one worker with the vocabulary."""
    shared = _shared(df, path)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairIndexBpe(shared.value)  # gone with the task: idle workers take turns, each would keep one
        for b in batches:
            ids = model.encode(["" if x is None else x for x in b.column(1).to_pylist()])
            decoded = pa.array([model.decode(x) for x in ids], type=pa.binary())
            yield batch_of(schema, [b.column(0), ids, decoded.cast(pa.string())])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(frugal(run), schema)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of the decoded text."""
    return encode_and_decode(df, path, id_col, text_col).select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
