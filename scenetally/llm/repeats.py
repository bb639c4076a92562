"""Removal of repeated byte strings with a sparse suffix array and deep-shallow sorting.

A byte goes if it is covered by a ``WIDTH``-byte string that also starts earlier (smaller id, or same document and earlier
start), judged on the input.

Anchors. Every string has an anchor: the leftmost of its ``GRAM``-byte grams with the smallest hash, so equal strings have
equal anchors at equal offsets. Neighbouring strings with the same anchor form one record (anchor hash, context hash,
place); there is about one record in 35 bytes. Records whose anchor is unique are done. Of records with equal contexts all
but the first are removed whole. What remains are anchors with several contexts, at the borders of repeats.

Suffixes. For those, the suffixes from the anchor on, and the reversed prefixes before it, are sorted within each anchor:
multikey quicksort on eight-byte characters (whole levels at once) to a shallow depth, then blind tries for groups that
still agree. With the common prefix lengths of both orders, strings at offset j are equal if they fall into the same
class of j left bytes and of WIDTH - j right bytes; the first of a class stays, the others are removed.

Hot anchors. Records are counted before the shuffle; an anchor with more than ``GROUP`` contexts is dealt by context hash
into several groups. The first string of each class in such a group is then compared across groups by a 128-bit hash. No
group, document or list is ever gathered beyond that bound, and a document's own spans.

Defined results: null text is empty; rows that repeat an id are ordered by a hash of their text, and of identical rows
all but one count as later copies; a null id is the smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import batch_of, keep, mix, pieces, texts

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM + 1  # grams in a string
GROUP = 4096
SHALLOW = 16  # bytes sorted by multikey quicksort
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Prefix:
    """Hash of any stretch of a buffer from running sums."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        terms = _BYTES[buffer] * _powers(_P, max(n, 1))[:n]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(_PINV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.uint64(2**64 - 1))
    full[:n] = x
    grid = full.reshape(blocks, w)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def records(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of several documents: document, anchor hash, context hash, anchor place, and its distance to the first and the
    last string start."""
    buffer = np.frombuffer(b"".join(docs), dtype=np.uint8)
    sizes = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
    begin = np.cumsum(sizes) - sizes
    if len(buffer) < WIDTH:
        return (np.zeros(0, dtype=np.int64),) * 6
    prefix = Prefix(buffer)
    grams = np.arange(len(buffer) - GRAM + 1)
    h = mix(prefix.of(grams, grams + GRAM))
    low = np.uint64((1 << 24) - 1)
    anchor = (sliding_least((h & ~low) | grams.astype(np.uint64), REACH) & low).astype(np.int64)
    starts = np.arange(len(anchor))
    owner = np.repeat(np.arange(len(docs)), sizes)[: len(anchor)]
    inside = starts + WIDTH <= (begin + sizes)[owner]
    starts, anchor, owner = starts[inside], anchor[inside], owner[inside]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 6
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, lo, hi, doc = anchor[first], starts[first], starts[last], owner[first]
    shape = ((a - lo) << 8 | (a - hi)).astype(np.uint64)
    context = mix(prefix.of(lo, hi + WIDTH) + mix(shape))
    return doc, h[a].view(np.int64), context.view(np.int64), a - begin[doc], a - lo, a - hi


MAX_PIECE = 8 << 20


def document_records(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """records() in pieces; a document beyond the 24 bits of a place is cut with an overlap of one string less a byte."""
    found = []
    for i, j in pieces(docs):
        if j - i == 1 and len(docs[i]) > MAX_PIECE:
            for at in range(0, len(docs[i]) - WIDTH + 1, MAX_PIECE):
                doc, h, c, p, lo, hi = records([docs[i][at : at + MAX_PIECE + WIDTH - 1]])
                found.append((doc + i, h, c, p + at, lo, hi))
        else:
            doc, *rest = records(docs[i:j])
            found.append((doc + i, *rest))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 6


# deep-shallow sorting


def multikey(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, words) and the class of equals: each level splits all open groups by one eight-byte character."""
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])) if len(order) else order
    for level in range(words.shape[1]):
        size = np.bincount(part)
        open_ = np.flatnonzero(size[part] > 1)  # places of classes with several members
        if not len(open_):
            break
        rows = order[open_]
        by = np.lexsort((words[rows, level], part[open_]))
        order[open_] = rows[by]
        key = words[order, level]
        part = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | ((key[1:] != key[:-1]) & (size[part[1:]] > 1))]))
    return order, part


class BlindTrie:
    """Strings of equal length in order: inner nodes hold the place of a branch only, a leaf holds the string."""

    def __init__(self, first: bytes, item: int):
        self.root: list = [first, [item]]  # a leaf: string, items; a node: place, children by byte

    def insert(self, string: bytes, item: int) -> None:
        at = self.root
        while isinstance(at[0], int):  # blind descent to some leaf
            at = at[1].get(string[at[0]]) or next(iter(at[1].values()))
        other = at[0]
        if other == string:
            at[1].append(item)
            return
        x = int.from_bytes(other, "big") ^ int.from_bytes(string, "big")
        place = len(string) - 1 - (x.bit_length() - 1) // 8
        at, above = self.root, None
        while isinstance(at[0], int) and at[0] < place:
            at, above = at[1][string[at[0]]], (at, string[at[0]])
        if isinstance(at[0], int) and at[0] == place:
            at[1][string[place]] = [string, [item]]
            return
        node = [place, {other[place]: at, string[place]: [string, [item]]}]
        if above is None:
            self.root = node
        else:
            above[0][1][above[1]] = node

    def ordered(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            at = stack.pop()
            if isinstance(at[0], int):
                stack += [at[1][b] for b in sorted(at[1], reverse=True)]
            else:
                yield from at[1]


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width byte rows within groups, and the common prefix with the row before (-1: another group)."""
    n, width = rows.shape
    shallow = np.ascontiguousarray(rows[:, :SHALLOW]).view(">u8").astype(np.uint64)
    order, part = multikey(shallow, group)
    size = np.bincount(part)
    for p in np.flatnonzero(size > 1):  # deep: long common prefixes
        a = int(np.searchsorted(part, p))
        items = order[a : a + size[p]].tolist()
        strings = [rows[i].tobytes() for i in items]
        if len(set(strings)) > 1:
            trie = BlindTrie(strings[0], items[0])
            for s, i in zip(strings[1:], items[1:]):
                trie.insert(s, i)
            order[a : a + size[p]] = list(trie.ordered())
    common = np.full(n, -1, dtype=np.int64)
    if n > 1:
        same = rows[order[1:]] == rows[order[:-1]]
        length = np.where(same.all(1), width, same.argmin(1))
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], length, -1)
    return order, common


def later_strings(contexts: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray):
    """Which strings of the contexts also start earlier within the group.

    A context starts ``lo`` bytes before its anchor; its strings start hi..lo bytes before it. ``rank`` orders the
    contexts by document and place. Returns a table (contexts, REACH) by distance to the anchor: 0 no string, 1 first,
    2 later.
    """
    n = len(contexts)
    right = np.zeros((n, WIDTH), dtype=np.uint8)
    left = np.zeros((n, REACH), dtype=np.uint8)
    for i, c in enumerate(contexts):
        k = int(lo[i])
        tail = c[k : k + WIDTH]
        right[i, : len(tail)] = np.frombuffer(tail, dtype=np.uint8)
        if k:
            left[i, :k] = np.frombuffer(c[k - 1 :: -1], dtype=np.uint8)
    right_order, right_common = deep_shallow(right[:, GRAM:], group)
    left_order, left_common = deep_shallow(left, group)
    right_common = np.where(right_common >= 0, right_common + GRAM, -1)
    by_rank = np.argsort(rank)
    table = np.zeros((n, REACH), dtype=np.uint8)
    for j in range(REACH):
        rows = by_rank[(lo[by_rank] >= j) & (hi[by_rank] <= j)]
        if not len(rows):
            continue
        a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        a[right_order] = np.cumsum(right_common < WIDTH - j)
        b[left_order] = np.cumsum(left_common < j)
        _, first = np.unique(a[rows] * (n + 1) + b[rows], return_index=True)
        table[rows, j] = 2
        table[rows[first], j] = 1
    return table


# Spark


def _anchored(docs: DataFrame) -> DataFrame:
    """(anchor, context, id, version, place): place packs the anchor's position and both distances."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "context", "id", "version", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = (np.asarray(b.column(k)) for k in (0, 1))
            every = texts(b.column(2))
            for i in range(0, len(every), 256):
                doc, h, c, p, lo, hi = document_records(every[i : i + 256])
                yield batch_of(schema, [pa.array(x) for x in (h, c, ids[i + doc], versions[i + doc], p << 16 | lo << 8 | hi)])

    return docs.select("id", "version", "text").mapInArrow(run, schema)


# of a packed place: the start of its first string, and the end of its last
FIRST = "shiftright(place, 16) - (shiftright(place, 8) & 255)"
LAST = f"shiftright(place, 16) - (place & 255) + {WIDTH}"


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, part, parts, id, version, place, bytes) of the wanted records, read from the texts."""
    lists = wanted.groupBy("id", "version").agg(F.collect_list(F.struct("anchor", "part", "parts", "place")).alias("w"))
    joined = docs.join(lists, ["id", "version"]).select("id", "version", "text", "w")
    longs = [T.StructField(n, T.LongType()) for n in ("anchor", "part", "parts", "id", "version", "place")]
    schema = T.StructType([*longs, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v, text, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist()):
                rows = []
                for r in w:
                    at, lo, hi = r["place"] >> 16, r["place"] >> 8 & 255, r["place"] & 255
                    rows.append((r["anchor"], r["part"], r["parts"], i, v, r["place"], text[at - lo : at - hi + WIDTH]))
                for k in range(0, len(rows), 20_000):
                    yield batch_of(schema, zip(*rows[k : k + 20_000]))

    return joined.mapInArrow(run, schema)


_SORTED = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("id", "version", "start", "end")],
        *[T.StructField(n, T.LongType()) for n in ("hash_a", "hash_b")],
    ]
)


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Spans to remove (id, version, start, end); of split anchors also the first string of each class with its hash."""
    dealt = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "id", "version", "place")

    def judged(rows: list[tuple]) -> pa.RecordBatch | None:
        out: list[tuple] = []
        rows = [r for i, r in enumerate(rows) if not i or r[:6] != rows[i - 1][:6]]  # identical rows of the input
        key = {}
        group = np.array([key.setdefault(r[:2], len(key)) for r in rows])
        place = np.array([r[5] for r in rows], dtype=np.int64)
        at, lo, hi = place >> 16, place >> 8 & 255, place & 255
        contexts_ = [r[6] for r in rows]
        table = later_strings(contexts_, group, lo, hi, np.arange(len(rows)))
        later = np.zeros((len(rows), REACH + 2), dtype=bool)
        later[:, 1:-1] = table[:, ::-1] == 2  # by start
        edges = later[:, 1:] != later[:, :-1]
        row, column = np.nonzero(edges)
        for r, a, b in zip(row[::2].tolist(), column[::2].tolist(), column[1::2].tolist()):
            base = int(at[r]) - (REACH - 1)
            out.append((rows[r][3], rows[r][4], base + a, base + b - 1 + WIDTH, None, None))
        split = np.array([r[2] > 1 for r in rows])
        for r, j in zip(*(x.tolist() for x in np.nonzero((table == 1) & split[:, None]))):
            s = np.frombuffer(contexts_[r][lo[r] - j : lo[r] - j + WIDTH], dtype=np.uint8)
            terms = _BYTES[s]
            a = (mix(terms) * _powers(_P, WIDTH)).sum(dtype=np.uint64)
            b = (mix(terms + np.uint64(1)) * _powers(_PINV, WIDTH)).sum(dtype=np.uint64)
            start = int(at[r]) - j
            out.append((rows[r][3], rows[r][4], start, start + WIDTH, int(a.astype(np.int64)), int(b.astype(np.int64))))
        return batch_of(_SORTED, zip(*out)) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            if len(held) > 2 * GROUP:  # whole groups only; the last one may go on in the next batch
                last = held[-1][:2]
                cut = len(held)
                while cut and held[cut - 1][:2] == last:
                    cut -= 1
                if cut:
                    made = judged(held[:cut])
                    held = held[cut:]
                    if made is not None:
                        yield made
        made = judged(held) if held else None
        if made is not None:
            yield made

    return dealt.mapInArrow(run, _SORTED)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, runs, kept) of every row: removed runs as start, end, ... in bytes, and the remaining bytes."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repeated = bool(docs.select(ids.alias("i")).groupBy("i").count().where("count > 1").head(1))
    version = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    source = docs.select(F.col(id_col).alias("given"), ids.alias("id"), version.alias("version"), text.alias("text"))
    plain = source.select("id", "version", "text")
    made = _anchored(plain)
    met = made.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = keep(made.join(met, "anchor", "left_semi"))
    first = found.groupBy("anchor", "context").agg(F.min(F.struct("id", "version", "place")).alias("first"))
    copies = found.join(first, ["anchor", "context"]).where(
        (F.col("id") != F.col("first.id")) | (F.col("version") != F.col("first.version")) | (F.col("place") != F.col("first.place"))
    )
    whole = copies.select("id", "version", F.expr(FIRST).alias("start"), F.expr(LAST).alias("end"))
    many = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / GROUP)
    wanted = first.join(many, "anchor").select(
        "anchor", F.pmod(F.col("context"), parts).alias("part"), parts.alias("parts"), "first.id", "first.version", "first.place"
    )
    border = keep(_sorted_groups(_contexts(plain, wanted)))
    pending = border.where("hash_a is not null")
    start = F.struct("id", "version", "start")
    least = pending.groupBy("hash_a", "hash_b").agg(F.min(start).alias("least"))
    across = pending.join(least, ["hash_a", "hash_b"]).where(start != F.col("least"))
    spans = ["id", "version", "start", "end"]
    removed = (
        whole.select(spans)
        .union(border.where("hash_a is null").select(spans))
        .union(across.select(spans))
        .groupBy("id", "version")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    if repeated:  # of identical rows, those after the first are copies throughout
        from pyspark.sql import Window

        turn = F.row_number().over(Window.partitionBy("id", "version").orderBy(F.lit(0)))
        source = source.withColumn("again", turn > 1)
    else:
        source = source.withColumn("again", F.lit(False))
    joined = source.join(removed, ["id", "version"], "left").select("given", "text", "spans", "again")
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("runs", T.ArrayType(T.LongType())),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = texts(b.column(1))
            runs, kept = [], []
            for text_, spans_, again in zip(every, b.column(2), b.column(3).to_pylist()):
                merged: list[int] = []
                if again and len(text_) >= WIDTH:
                    merged = [0, len(text_)]
                elif spans_.is_valid:
                    flat = spans_.values.flatten()
                    begin, end = np.asarray(flat[0]), np.asarray(flat[1])
                    by = np.argsort(begin, kind="stable")
                    begin, end = begin[by], np.maximum.accumulate(end[by])
                    new = np.concatenate([[True], begin[1:] > end[:-1]])
                    stop = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
                    merged = np.column_stack([begin[new], end[stop]]).ravel().tolist()
                edges = [0, *merged, len(text_)]
                runs.append(merged)
                kept.append(b"".join(text_[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield batch_of(schema, [b.column(0), [len(t) for t in every], runs, kept])

    return joined.mapInArrow(run, schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of a removal."""
    return found.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        (F.size("runs") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
