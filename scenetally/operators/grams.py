"""N-grams of many texts on their way through a shuffle: packed by part, each word once a blob, grams as numbers of words.

A task counts the grams of a chunk of texts, deals them out to numbered parts by their words and compresses what goes to
a part. Equal grams have equal numbers, so the blobs of a number hold all that is known of its grams.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# grams are dealt out by their first words: two, and the third one's remainder, so that a common pair is split
DEALT = 3
THIRDS = 4
LEVEL = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Level(NamedTuple):
    """The distinct grams of one order: each one's first words (its place one order lower), last word and count."""

    parent: np.ndarray
    last: np.ndarray
    count: np.ndarray


def coded(tokens: pa.ListArray, owner: np.ndarray, counts: np.ndarray, n: int) -> tuple[pa.Array, list[Level], Counter]:
    """(words, orders 1..n, odd grams): how many owners have each gram in a row that counts; other rows' grams are there with 0.

    Odd grams, of owners with a null, an empty word or one with a space, are counted as (order, text): there unlike
    grams may have the same text, null tokens being left out of it as by array_join.
    """
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy())
    flat = tokens.flatten().dictionary_encode()
    vocab = flat.dictionary
    word = flat.indices.fill_null(len(vocab)).to_numpy().astype(np.int64)
    unsure = np.append(pc.or_(pc.equal(vocab, ""), pc.match_substring(vocab, " ")).to_numpy(zero_copy_only=False), True)
    odd = np.isin(owner, owner[row[unsure[word]]])
    if odd.any():
        some = _joined(tokens.filter(pa.array(odd)).to_pylist(), owner[odd].tolist(), counts[odd].tolist(), n)
        vocab, levels, _ = coded(tokens.filter(pa.array(~odd)), owner[~odd], counts[~odd], n)
        return vocab, levels, some
    owners = int(owner.max(initial=0)) + 1
    code, parent, last, levels = word, np.zeros(len(vocab), np.int64), np.arange(len(vocab)), []
    for k in range(1, n + 1):
        if k > 1:
            whole = row[k - 1 :] == row[: max(len(row) - k + 1, 0)]
            pair = np.where(whole, code[: len(whole)] * len(vocab) + word[k - 1 :], -1)
            grams = pa.array(pair, mask=~whole).dictionary_encode()
            code, made = grams.indices.fill_null(-1).to_numpy().astype(np.int64), grams.dictionary.to_numpy()
            parent, last = made // max(len(vocab), 1), made % max(len(vocab), 1)
        at = row[: len(code)]
        live = (code >= 0) & counts[at]
        held = np.sort(code[live] * owners + owner[at][live])
        once = held[np.diff(held, prepend=-1) > 0] // owners
        count = np.bincount(once, minlength=len(last))
        levels.append(Level(*(x.astype(np.int32) for x in (parent, last, count))))
    return vocab, levels, Counter()


def _joined(rows: list[list], owners: list[int], counts: list[bool], n: int) -> Counter:
    held = {}
    for tokens, owner, counted in zip(rows, owners, counts):
        for k in range(1, n + 1):
            for i in range(len(tokens or ()) - k + 1):
                those = held.setdefault((k, " ".join(w for w in tokens[i : i + k] if w is not None)), set())
                if counted:
                    those.add(owner)
    return Counter({gram: len(those) for gram, those in held.items()})


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


def _chained(before: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    if k == DEALT:
        word = word % np.uint64(THIRDS)
    mixed = (before + word + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return mixed if k < DEALT else np.where(word == 0, before, mixed)


def _write(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers, each as wide as its largest one and byte by byte, compressed together."""
    head, body = [len(arrays)], []
    for a in arrays:
        most = int(a.max(initial=0))
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        head += [len(a), width]
        body.append(np.ascontiguousarray(a, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    raw = b"".join([np.array(head, "<i8").tobytes(), *body])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _read(blob: bytes) -> list[np.ndarray]:
    """The arrays again, as wide as they were written."""
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2).tolist(), 8 + 16 * n, []
    for length, width in head:
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += length * width
    return out


def _texts_out(words: pa.Array) -> list[np.ndarray]:
    ends, data = words.buffers()[1:]
    ends = np.frombuffer(ends, "<i4", len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    return [np.diff(ends), np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]


def _texts_in(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(lengths)).astype("<i4")
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def packed(vocab: pa.Array, levels: list[Level], odd: Counter, parts: int) -> Iterator[tuple[int, bytes]]:
    """(number, blob) for each of ``parts`` numbers that has grams."""
    # in the order of their texts, so that words which begin alike stand together
    rising = pc.sort_indices(vocab)
    vocab, rank = vocab.take(rising), np.empty(len(vocab), np.int32)
    rank[rising.to_numpy()] = np.arange(len(vocab))
    hashes, strange = _hashes(vocab), {}
    for (k, text), count in odd.items():
        # as the hash of the words this text would have
        chain = np.zeros(1, np.uint64)
        for i, h in enumerate(_hashes(pa.array(text.split(" ")[: min(k, DEALT)], pa.string())), start=1):
            chain = _chained(chain, h, i)
        strange.setdefault(int(chain[0] % np.uint64(parts)), []).append((k, text, count))
    chain, ids, sorted_levels = np.zeros(max(len(vocab), 1), np.uint64), [], []
    place = number = None
    for k, level in enumerate(levels, start=1):
        if k <= DEALT:
            last = rank[level.last]
            chain = _chained(chain[level.parent], hashes[last], k)
            number = (chain % np.uint64(parts)).astype(np.int32)
            ids = [*[w[level.parent] for w in ids], last]
            order = np.argsort(number.astype(np.int64) * (len(vocab) + 1) + ids[0], kind="stable")
            columns, under = [w[order] for w in ids], None
        else:
            number, under = number[level.parent], place[level.parent]
            order = np.argsort(under, kind="stable")
            columns, under = [rank[level.last[order]]], under[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        bounds = np.searchsorted(number[order], np.arange(parts + 1))
        sorted_levels.append((columns, under, level.count[order], bounds))
    for b in range(parts):
        cuts = [slice(int(bounds[b]), int(bounds[b + 1])) for *_, bounds in sorted_levels]
        if not any(c.stop > c.start for c in cuts) and b not in strange:
            continue
        columns = [w[c] for (cols, *_), c in zip(sorted_levels, cuts) for w in cols]
        own = pa.array(np.concatenate(columns)).dictionary_encode()
        words = np.sort(own.dictionary.to_numpy())
        small, at, arrays = np.searchsorted(words, own.dictionary.to_numpy())[own.indices.to_numpy()], 0, []
        for k, ((cols, under, count, _), c) in enumerate(zip(sorted_levels, cuts)):
            for i in range(len(cols)):
                some = small[at : at + c.stop - c.start]
                # first words never fall within a blob
                arrays.append(np.diff(some, prepend=0) if k < DEALT and not i else some)
                at += c.stop - c.start
            if under is not None:
                arrays.append(np.bincount(under[c] - cuts[k - 1].start, minlength=cuts[k - 1].stop - cuts[k - 1].start))
            arrays.append(count[c])
        some = strange.get(b, [])
        rest = [np.array([x[i] for x in some], np.int64) for i in (0, 2)]
        yield b, _write([*_texts_out(vocab.take(pa.array(words))), *_texts_out(pa.array([x[1] for x in some], pa.string())), *rest, *arrays])


class Merged(NamedTuple):
    """Grams of one order in several blobs: of each one there the blob, its place among ``texts`` and its count."""

    blob: np.ndarray
    code: np.ndarray
    count: np.ndarray
    texts: pa.Array


def merged(blobs: Iterable[bytes], n: int) -> Iterator[Merged]:
    """Orders 1..n of the blobs of one number."""
    read = [_read(b) for b in blobs]
    words = [_texts_in(*x[:2]) for x in read]
    held = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    vocab, place = held.dictionary, held.indices.to_numpy().astype(np.int64)
    starts = np.cumsum([0, *[len(w) for w in words]])
    at, code, texts = 6, None, None

    def column(i: int, first: bool = False) -> np.ndarray:
        return np.concatenate([place[s + (np.cumsum(x[i], dtype=np.int64) if first else x[i].astype(np.int64))] for s, x in zip(starts, read)])

    def extended(code: np.ndarray, texts: pa.Array, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        grams = pa.array(code * len(vocab) + last).dictionary_encode()
        made = grams.dictionary.to_numpy()
        both = [texts.take(pa.array(made // max(len(vocab), 1))), vocab.take(pa.array(made % max(len(vocab), 1)))]
        return grams.indices.to_numpy().astype(np.int64), pc.binary_join_element_wise(*both, " ")

    for k in range(1, n + 1):
        if k <= DEALT:
            first = pa.array(column(at, True)).dictionary_encode()
            code, texts = first.indices.to_numpy().astype(np.int64), vocab.take(first.dictionary)
            for i in range(1, k):
                code, texts = extended(code, texts, column(at + i))
            at += k
        else:
            code, texts = extended(np.repeat(code, np.concatenate([x[at + 1] for x in read]).astype(np.int64)), texts, column(at))
            at += 2
        blob = np.repeat(np.arange(len(read)), [len(x[at]) for x in read])
        count = np.concatenate([x[at] for x in read]).astype(np.int64)
        at += 1
        out = Merged(blob, code, count, texts)
        strange = [(i, text, c) for i, x in enumerate(read) if len(x[4]) for text, order, c in zip(_texts_in(*x[2:4]).to_pylist(), x[4], x[5]) if order == k]
        if strange:
            every = pa.concat_arrays([texts, pa.array([x[1] for x in strange], pa.string())]).dictionary_encode()
            same = every.indices.to_numpy().astype(np.int64)
            more = [np.array([x[i] for x in strange], np.int64) for i in (0, 2)]
            out = Merged(np.append(blob, more[0]), np.append(same[: len(texts)][code], same[len(texts) :]), np.append(count, more[1]), every.dictionary)
        yield out


def totals(grams: Merged) -> np.ndarray:
    """The sum of the counts of each text, exact below 2^53."""
    return np.bincount(grams.code, weights=grams.count, minlength=len(grams.texts)).astype(np.int64)


def listed(some: list[tuple[int, np.ndarray, Merged, np.ndarray]]) -> bytes:
    """Texts of (order, totals, grams, places among their texts), rising and with their totals, in one blob."""
    arrays = []
    for k, sums, grams, places in some:
        texts = grams.texts.take(pa.array(places))
        rising = pc.sort_indices(texts)
        arrays += [np.array([k]), *_texts_out(texts.take(rising)), sums[places][rising.to_numpy()]]
    return _write(arrays)


def unlisted(blob: bytes) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(order, texts, totals) again."""
    arrays = _read(blob)
    for i in range(0, len(arrays), 4):
        yield int(arrays[i][0]), _texts_in(*arrays[i + 1 : i + 3]), arrays[i + 3].astype(np.int64)
