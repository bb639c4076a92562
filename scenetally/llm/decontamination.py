"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are windows of ``window`` consecutive item words (an item of fewer words is one window). A text is brought
into the form " w1 w2 ... wn "; a window then occurs exactly where its bytes, with a space on both ends, occur. For a
block of windows there are a shift table over hashed byte blocks (positions that no window can end at are skipped), a
bucket per last block of the common prefix length that selects the test strings, a check of their first bytes, and a
direct comparison. Windows are dealt into machines by length, so one short item does not shorten every shift. Many
places of a text are advanced side by side in numpy.

The items are a stated query set. They are taken in blocks of at most ``block_bytes`` of text; only one block at a time
is on the driver, and its tables (at most about 60 bytes for each byte of text) are what is broadcast. Every block runs
over all documents, without a shuffle.

Defined results: null text has no words; an item with null id or without words has no windows; items of equal id are one
item; ids are returned as strings, each once; repeated documents are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import ALNUM, LOWER, batch_of, frugal, pieces, texts
from scenetally.session import pin

_HASH = np.uint64(0x9E3779B97F4A7C15)
LANE = 1024
SPANS = T.ArrayType(T.IntegerType())
NAMES = T.ArrayType(T.StringType())

_PLAIN = bytes(b if ALNUM[b] else 32 for b in LOWER)  # other bytes become spaces


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_PLAIN).split(b" ") if w]


class Machine:
    """Tables for test strings of similar length."""

    def __init__(self, strings: list[bytes]):
        self.m = min(map(len, strings))
        self.b = min(8, max(2, self.m // 2))
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        self.strings = sorted(strings, key=lambda s: s[self.m - self.b : self.m][::-1])
        per = self.m - self.b + 1
        self.bits = int(min(24, max(12, np.ceil(np.log2(len(strings) * per * 8)))))
        head = np.frombuffer(b"".join(s[: self.m] + bytes(8) for s in self.strings), dtype=np.uint8)
        head = head.reshape(len(strings), self.m + 8)
        self.shift = np.full(1 << self.bits, per, dtype=np.int32)
        last = np.zeros(len(strings), dtype=np.uint64)
        for q in range(per):  # block at q ends m - b - q bytes before the end of the prefix
            key = np.zeros(len(strings), dtype=np.uint64)
            for j in range(self.b):
                key |= head[:, q + j].astype(np.uint64) << np.uint64(8 * j)
            slot = self.slot(key)
            self.shift[slot] = np.minimum(self.shift[slot], per - 1 - q)
            last = key
        by = np.argsort(last, kind="stable")
        self.strings = [self.strings[i] for i in by]
        self.buckets, self.begin = np.unique(last[by], return_index=True)
        self.end = np.append(self.begin[1:], len(strings))
        short = min(8, self.m)
        self.first_mask = np.uint64((1 << 8 * short) - 1)
        self.first = np.array([int.from_bytes(s[:short], "little") for s in self.strings], dtype=np.uint64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, test string) of every occurrence. The text has at least 8 bytes after its last place."""
        n = len(text) - 8
        if n < self.m:
            return []
        view = np.ndarray((n,), dtype="<u8", buffer=text, strides=(1,))  # eight bytes from each place on
        place = np.arange(self.m - 1, n, LANE)
        stop = np.minimum(place + LANE, n)
        found = []
        while len(place):
            step = self.shift[self.slot(view[place - (self.b - 1)] & self.mask)]
            zero = step == 0
            if zero.any():
                found.append(place[zero])
            place = place + np.maximum(step, 1)
            going = place < stop
            place, stop = place[going], stop[going]
        if not found:
            return []
        at = np.sort(np.concatenate(found))
        key = view[at - (self.b - 1)] & self.mask
        k = np.searchsorted(self.buckets, key)
        k[k == len(self.buckets)] = 0
        hit = self.buckets[k] == key
        at, k = at[hit] - self.m + 1, k[hit]
        many = self.end[k] - self.begin[k]
        which = np.repeat(self.begin[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = np.repeat(at, many)
        same = (view[at] & self.first_mask) == self.first[which]
        strings = self.strings
        return [
            (a, strings[w])
            for a, w in zip(at[same].tolist(), which[same].tolist())
            if text.startswith(strings[w], a)
        ]


class Block:
    """Windows of a block of items, and the machines that find them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for name, text in items:
            ws = words_of(text)
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                owners[b" " + b" ".join(ws[i : i + window]) + b" "].add(name)
        self.owners = {s: sorted(o) for s, o in owners.items()}
        classes: dict[int, list[bytes]] = defaultdict(list)
        for s in owners:
            classes[0 if len(s) >= 32 else 1 if len(s) >= 12 else 2].append(s)
        self.machines = [Machine(strings) for strings in classes.values()]

    def search(self, docs: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Per document: number of words, hit runs of words as start, end, ..., and the items found."""
        raw = np.frombuffer((b" " + b" \xff ".join(docs)).translate(LOWER) + b" ", dtype=np.uint8)
        word = ALNUM[raw]
        plain = np.where(word, raw, np.uint8(32))
        keep = np.ones(len(plain), dtype=bool)
        keep[1:] = word[1:] | word[:-1] | (raw[1:] == 255)  # 0xFF is in no text; it parts documents
        plain[raw == 255] = 255
        flat = plain[keep]
        inside = (flat != 32) & (flat != 255)
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        parts = np.flatnonzero(flat == 255)
        first = np.concatenate([[0], np.searchsorted(starts, parts), [len(starts)]])
        counts = np.diff(first)
        edge = np.zeros(len(starts) + 1, dtype=np.int64)
        named: dict[int, set[str]] = defaultdict(set)
        text = flat.tobytes() + bytes(8)
        for machine in self.machines:
            hits = machine.find(text)
            if hits:
                begin = np.searchsorted(starts, np.array([a + 1 for a, _ in hits]))
                doc = np.searchsorted(first, begin, side="right") - 1
                size = np.array([s.count(b" ") - 1 for _, s in hits])
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + size, -1)
                for d, (_, s) in zip(doc.tolist(), hits):
                    named[d].update(self.owners[s])
        runs: list[list[int]] = [[] for _ in docs]
        names: list[list[str]] = [sorted(named.get(d, ())) for d in range(len(docs))]
        if named:
            on = np.cumsum(edge)[:-1] > 0
            for d in named:
                part = np.concatenate([[False], on[first[d] : first[d + 1]], [False]])
                runs[d] = np.flatnonzero(part[1:] != part[:-1]).tolist()
        return counts, runs, names


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Block]:
    rows, size = [], 0
    wanted = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in wanted.where("i is not null and t is not null").toLocalIterator():
        text = r.t.encode()
        if rows and size + len(text) > block_bytes:
            yield Block(rows, window)
            rows, size = [], 0
        rows.append((r.i, text))
        size += len(text)
    if rows:
        yield Block(rows, window)


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[list[int]] = []
    for s, e in sorted([*zip(a[0::2], a[1::2]), *zip(b[0::2], b[1::2])]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [x for pair in out for x in pair]


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """(id, text, n_words, hit_runs, item_ids) of every document: runs of hit words as start, end, start, end, ..."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(text_col, T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_runs", SPANS),
            T.StructField("item_ids", NAMES),
        ]
    )
    context = docs.sparkSession.sparkContext
    none = F.array().cast(SPANS), F.array().cast(NAMES)
    out = docs.select(
        id_col,
        F.col(text_col).cast("string").alias(text_col),
        F.lit(0).cast("long").alias("n_words"),
        none[0].alias("hit_runs"),
        none[1].alias("item_ids"),
    )

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                every = texts(b.column(1))
                before = list(zip(b.column(3).to_pylist(), b.column(4).to_pylist()))
                counts, runs, names = [], [], []
                for i, j in pieces(every):
                    c, r, n = block.search(every[i:j])
                    counts.append(c)
                    runs += r
                    names += n
                for k, (r, n) in enumerate(before):
                    if r:
                        runs[k] = _merged(runs[k], r)
                    if n:
                        names[k] = sorted({*names[k], *n})
                total = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
                yield batch_of(schema, [b.column(0), b.column(1), pa.array(total), runs, names])

        return run

    number = 0
    for block in _blocks(items, item_id_col, item_text_col, block_bytes, window):
        if number and number % 4 == 0:
            out = pin(out)  # a few blocks' tables in a worker at a time
        out = out.mapInArrow(frugal(step(context.broadcast(block))), schema)
        number += 1
    if not number:  # nothing to find, yet words are counted
        out = out.mapInArrow(frugal(step(context.broadcast(Block([], window)))), schema)
    return out


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """All columns of the documents in which no window of an item occurs."""
    context, out = docs.sparkSession.sparkContext, docs
    at, schema = docs.columns.index(text_col), docs.schema

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every = texts(b.column(at))
                stays = [not r for i, j in pieces(every) for r in shared.value.search(every[i:j])[1]]
                yield b.filter(pa.array(stays, type=pa.bool_()))

        return run

    for number, block in enumerate(_blocks(items, "item_id", "text", block_bytes, window)):
        if number and number % 4 == 0:
            out = pin(out)
        out = out.mapInArrow(frugal(step(context.broadcast(block))), schema)
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of a search."""
    hit = F.expr(
        "aggregate(sequence(1, greatest(size(hit_runs), 2), 2), 0L,"
        " (a, i) -> a + coalesce(get(hit_runs, i) - get(hit_runs, i - 1), 0))"
    )
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )
