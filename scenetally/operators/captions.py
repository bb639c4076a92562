"""Caption metrics: BLEU, ROUGE-L, CIDEr, the joint report and the self-critical reward.

Candidates are (item, tokens), references (item, ref, tokens). Texts are scored whole: the candidates and the references
of an item meet in one row, rows in compressed blocks, and n-grams leave a block, packed, only where the corpus is asked
how common they are.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from scenetally.operators import grams as gr
from scenetally.session import pin

BATCH_ROWS = 65_536  # counts that one batch of a Python worker gives back
BLOCK_TOKENS = 400_000  # words of the items that ask together how common their n-grams are
NUMBER_GRAMS = 10_000_000  # n-grams asked for that are added up together, about
REFERENCE = -1  # side of a reference; candidates are on side 0, 1, ...
SMALL, TINY = 1e-9, 1e-15  # fixed smoothing values of the public scorer


def _texts(cands: DataFrame | list[DataFrame], refs: DataFrame, item: str, cand: str, ref_id: str, ref: str) -> DataFrame:
    """(item, texts, n_tokens): the texts of an item in one row, each distinct one once with the number of its rows.

    Several tables of candidates are told apart by their side. Texts go through one shuffle, as JSON lists of their tokens.
    """
    kind = refs.schema[ref_id].dataType

    def rows(df: DataFrame, side: int, ref: Column, tokens: str) -> DataFrame:
        listed = F.col(tokens).cast("array<string>")
        return df.select(item, F.lit(side).alias("side"), ref.alias("ref"), F.to_json(listed).alias("tokens"), F.size(listed).alias("size"))

    every = rows(refs, REFERENCE, F.col(ref_id), ref)
    for side, own in enumerate(cands if isinstance(cands, list) else [cands]):
        every = every.unionByName(rows(own, side, F.lit(None).cast(kind), cand))
    every = every.where(F.col(item).isNotNull()).repartition(item)
    every = every.groupBy(item, "side", "ref", "tokens", "size").agg(F.count("*").alias("m"))
    # null texts are left out here: as a filter this would stand before the joins behind the tables, and no two sides could share one
    there = F.col("tokens").isNotNull()
    texts = F.collect_list(F.when(there, F.struct("side", "ref", "tokens", "m"))).alias("texts")
    return every.groupBy(item).agg(texts, F.coalesce(F.sum(F.when(there, F.col("size") * F.col("m"))), F.lit(0)).alias("n_tokens"))


def _grams(tokens: list, n: int) -> list[list[str]]:
    """The space-joined n-grams of every order 1..n; null tokens take no part in a text."""
    if None in tokens:
        return [[" ".join(w for w in tokens[i : i + k] if w is not None) for i in range(len(tokens) - k + 1)] for k in range(1, n + 1)]
    out = [tokens]
    for k in range(1, n):
        out.append([g + " " + w for g, w in zip(out[-1], tokens[k:])])
    return out[:n]


def _item_counts(texts: list[dict], n: int) -> tuple[dict, dict]:
    """Counts by order 0..n of every candidate by its side and of every reference by its name; order 0 has the sizes."""
    mine: dict = {}
    theirs: dict = {}
    for x in texts:
        side, name = (theirs, x["ref"]) if x["side"] == REFERENCE else (mine, x["side"])
        counts = side.setdefault(name, [Counter() for _ in range(n + 1)])
        tokens = json.loads(x["tokens"])
        counts[0][""] += len(tokens) * x["m"]
        for k, grams in enumerate(_grams(tokens, n), start=1):
            if x["m"] == 1:
                counts[k].update(grams)
            else:
                counts[k].update({g: c * x["m"] for g, c in Counter(grams).items()})
    return mine, theirs


def _blob(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _opened(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _blocks(texts: DataFrame, most: int) -> DataFrame:
    """(block, n_given, n_tokens, blob): rows of ``_texts`` as they lie, about ``most`` words a block; its items with
    references and words beside it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, first = [], 0, 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            given = sum(any(x["side"] == REFERENCE for x in texts) for texts in rows.column(1).to_pylist())
            values = [first + made, given, size, _blob(rows.select([0, 1]))]
            return pa.RecordBatch.from_pydict({c: pa.array([v], t) for c, v, t in zip(names, values, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

        names = ["block", "n_given", "n_tokens", "blob"]
        for batch in batches:
            ends = size + np.cumsum(batch.column(2).to_numpy())
            at = 0
            while len(ends) and ends[-1] >= most:
                end = int(np.searchsorted(ends, most)) + 1
                held.append(batch.slice(at, end - at))
                size = int(ends[end - 1])
                yield block()
                held, made, at = [], made + 1, end
                ends = np.append(np.zeros(end, np.int64), ends[end:] - size) if end < len(ends) else ends[:0]
                size = 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size = int(ends[-1])
        if held:
            yield block()

    return texts.mapInArrow(cut, "block long, n_given long, n_tokens long, blob binary")


def _unblocked(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, texts) again."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob in rows.column(0).to_pylist():
                yield _opened(blob)

    return blocks.select("blob").mapInArrow(items, StructType(texts.schema.fields[:2]))


def caption_counts(cands: DataFrame, refs: DataFrame, item: str, cand: str, ref_id: str, ref: str, n: int = 4) -> DataFrame:
    """(item, n, gram, c, refs): how often each n-gram is in the candidate (null: not at all) and in which references.

    Only texts are shuffled, by item. ``refs`` is an array of (ref, r), at most one entry a reference. Rows of order 0
    carry the number of tokens of each side, so texts without words stay too.
    """
    texts = _texts(cands, refs, item, cand, ref_id, ref)
    entry = ArrayType(StructType([StructField("ref", refs.schema[ref_id].dataType), StructField("r", LongType())]))
    fields = [StructField("n", IntegerType()), StructField("gram", StringType()), StructField("c", LongType()), StructField("refs", entry)]

    def batch(items: pa.Array, at: list, orders: list, grams: list, c: list, ends: list, ref: list, r: list, ref_type) -> pa.RecordBatch:
        entries = pa.StructArray.from_arrays([pa.array(ref, ref_type), pa.array(r, pa.int64())], names=["ref", "r"])
        columns = [items.take(pa.array(at, pa.int64())), pa.array(orders, pa.int32()), pa.array(grams, pa.string()), pa.array(c, pa.int64())]
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries))
        return pa.RecordBatch.from_arrays(columns, names=[item, "n", "gram", "c", "refs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            items, held = rows.column(0), rows.column(1)
            ref_type = held.type.value_type.field("ref").type
            at, orders, grams, c, ends, ref, r = [], [], [], [], [0], [], []
            for i in range(len(rows)):
                mine, theirs = _item_counts(held[i].as_py(), n)
                for k in range(n + 1):
                    own = mine[0][k] if mine else {}
                    for gram in dict.fromkeys([g for side in (own, *(t[k] for t in theirs.values())) for g in side]):
                        at.append(i)
                        orders.append(k)
                        grams.append(gram)
                        c.append(own.get(gram))
                        for name, counts in theirs.items():
                            if gram in counts[k]:
                                ref.append(name)
                                r.append(counts[k][gram])
                        ends.append(len(ref))
                        if len(at) >= BATCH_ROWS:
                            yield batch(items, at, orders, grams, c, ends, ref, r, ref_type)
                            at, orders, grams, c, ends, ref, r = [], [], [], [], [0], [], []
            if at:
                yield batch(items, at, orders, grams, c, ends, ref, r, ref_type)

    return texts.select(item, "texts").mapInArrow(count, StructType([texts.schema[item], *fields]))


def _bleu_columns(n: int, correct: list[Column], guess: list[Column], test: Column, ref: Column) -> list[Column]:
    ratio = (test + TINY) / (ref + SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, out = F.lit(1.0), []
    for k in range(n):
        product = product * (correct[k] + TINY) / (guess[k] + SMALL)
        out.append((F.pow(product, 1.0 / (k + 1)) * penalty).alias(f"bleu{k + 1}"))
    return out


def bleu_statistics(
    cands: DataFrame, refs: DataFrame, item: str, cand: str, ref_id: str, ref: str, n: int = 4, texts: DataFrame | None = None, side: int = 0
) -> DataFrame:
    """Clipped matches, guesses and lengths per item; the reference length is the nearest one, the shorter on a tie.

    ``texts`` has the texts of the items if they are known, ``side`` tells which of their candidates is meant.
    """
    if texts is None:
        texts = _texts(cands, refs, item, cand, ref_id, ref)
    names = ["testlen", "reflen", *[f"correct{k}" for k in range(1, n + 1)]]

    def clipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, out = [], []
            for i in range(len(rows)):
                sides, theirs = _item_counts(rows.column(1)[i].as_py(), n)
                mine = sides.get(side)
                if mine is None or not theirs:
                    continue
                size = mine[0][""]
                near = min((abs(t[0][""] - size), t[0][""]) for t in theirs.values())[1]
                hits = [sum(min(c, max(t[k][g] for t in theirs.values())) for g, c in mine[k].items()) for k in range(1, n + 1)]
                at.append(i)
                out.append([size, near, *hits])
            columns = [pa.array([o[j] for o in out], pa.int64()) for j in range(n + 2)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), *columns], names=[item, *names])

    fields = [texts.schema[item], *[StructField(c, LongType()) for c in names]]
    stats = texts.select(item, "texts").mapInArrow(clipped, StructType(fields))
    guess = [F.greatest(F.col("testlen") - (k - 1), F.lit(0)).alias(f"guess{k}") for k in range(1, n + 1)]
    return stats.select("*", *guess)


def bleu_per_item(stats: DataFrame, item: str, n: int = 4) -> DataFrame:
    c, g = [F.col(f"correct{k}") for k in range(1, n + 1)], [F.col(f"guess{k}") for k in range(1, n + 1)]
    return stats.select(item, *_bleu_columns(n, c, g, F.col("testlen"), F.col("reflen")))


def bleu_corpus(stats: DataFrame, n: int = 4) -> DataFrame:
    names = ["testlen", "reflen", *[f"{p}{k}" for p in ("correct", "guess") for k in range(1, n + 1)]]
    total = stats.agg(*[F.sum(c).alias(c) for c in names])
    c, g = [F.col(f"correct{k}") for k in range(1, n + 1)], [F.col(f"guess{k}") for k in range(1, n + 1)]
    return total.select(*_bleu_columns(n, c, g, F.col("testlen"), F.col("reflen")))


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays, one machine word of columns at a time."""

    def length(x, y) -> int:
        where: dict = {}
        for i, token in enumerate(x):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            common = row & where.get(token, 0)
            row = ((row + common) | (row - common)) & full
        return len(x) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(cands: DataFrame, refs: DataFrame, item: str, cand: str, ref: str, beta: float = 1.2) -> DataFrame:
    """F of the best LCS precision and the best LCS recall over the references."""
    pairs = cands.select(item, F.col(cand).alias("_a")).join(refs.select(item, F.col(ref).alias("_b")), item)
    scored = pairs.select(item, lcs_length("_a", "_b").alias("lcs"), F.size("_a").alias("na"), F.size("_b").alias("nb"))
    best = scored.groupBy(item).agg(
        F.coalesce(F.max(F.try_divide("lcs", "na")), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.try_divide("lcs", "nb")), F.lit(0.0)).alias("r")
    )
    f = (1 + beta**2) * F.col("p") * F.col("r") / (F.col("r") + beta**2 * F.col("p"))
    return best.select(item, F.when((F.col("p") != 0) & (F.col("r") != 0), f).otherwise(0.0).alias("rouge_l"))


def _known(blocks: DataFrame, n: int, numbers: int) -> DataFrame:
    """(block, known): of the n-grams of a block those that the references of more than one item have, packed.

    A block asks once for each of its n-grams, and hears nothing of what is in no or one item. What it asks is dealt out
    to ``numbers`` and packed; the sum over all blocks holds one number at a time.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, blob in zip(*(rows.column(i).to_pylist() for i in range(2))):
                tokens, owner, counts = [], [], []
                for i, texts in enumerate(_opened(blob).column(1).to_pylist()):
                    for x in texts:
                        tokens.append(json.loads(x["tokens"]))
                        owner.append(i)
                        counts.append(x["side"] == REFERENCE)
                coded = gr.coded(pa.array(tokens, pa.list_(pa.string())), np.array(owner, np.int64), np.array(counts, bool), n)
                for number, grams in gr.packed(*coded, numbers):
                    yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "block": pa.array([block], pa.int64()), "grams": pa.array([grams], pa.binary())})

    def answer(held: pa.Table) -> pa.Table:
        asked = held.column("asked").combine_chunks().flatten()
        told: dict[int, list] = {}
        for k, grams in enumerate(gr.merged(asked.field("grams").to_pylist(), n), start=1):
            df = gr.totals(grams)
            common = np.flatnonzero(df[grams.code] > 1)
            common = common[np.argsort(grams.blob[common], kind="stable")]
            ends = np.searchsorted(grams.blob[common], np.arange(len(asked) + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                told.setdefault(i, []).append((k, df, grams, grams.code[common[ends[i] : ends[i + 1]]]))
        blocks = asked.field("block")
        return pa.table({"block": blocks.take(pa.array(list(told), pa.int64())), "known": pa.array([gr.listed(x) for x in told.values()], pa.binary())})

    asked = blocks.select("block", "blob").mapInArrow(ask, "number int, block long, grams binary")
    asked = asked.repartition("number").groupBy("number").agg(F.collect_list(F.struct("block", "grams")).alias("asked"))
    return asked.groupBy("number").applyInArrow(answer, "block long, known binary")


def _common_grams(blocked: DataFrame, n: int) -> DataFrame:
    """(block, n, gram, df): of the n-grams of a block those that the references of more than one item have."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block in set(rows.column(0).to_pylist()):
                blob = _blob(pa.Table.from_batches([rows]).filter(pc.equal(rows.column(0), block)).select([1, 2]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, grams, df in gr.unlisted(known):
                    same = [pa.array([v] * len(grams), t) for v, t in ((block, pa.int64()), (k, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, grams, pa.array(df)], names=["block", "n", "gram", "df"])

    blocks = blocked.select(F.col("block").cast("long"), *[c for c in blocked.columns if c != "block"]).mapInArrow(pack, "block long, blob binary")
    return _known(blocks, n, 1).mapInArrow(rows, "block long, n int, gram string, df long")


def _ciders(blocks: DataFrame, field: StructField, names: list[str], n: int, sigma: float) -> DataFrame:
    """(item, score of each side by its name) of the items that have a reference and a candidate on every side."""
    n_given, n_tokens = blocks.agg(F.coalesce(F.sum("n_given"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    log_n = math.log(max(n_given, 1))
    known = _known(blocks, n, max(1, n * n_tokens // NUMBER_GRAMS))

    def weights(counts: Counter, shares: dict) -> dict:
        return {g: c * (log_n - math.log(shares.get(g, 1))) for g, c in counts.items()}

    def length(w: dict) -> float:
        return math.sqrt(sum(x * x for x in w.values()))

    def score(mine: list[Counter], theirs: dict, df: list[dict]) -> float:
        own = [weights(mine[k], df[k]) for k in range(1, n + 1)]
        norms, total = [length(w) for w in own], 0.0
        for counts in theirs.values():
            sim = 0.0
            for k, (h, hn) in enumerate(zip(own, norms), start=1):
                r = weights(counts[k], df[k])
                dot, rn = sum(min(h[g], x) * x for g, x in r.items() if g in h), length(r)
                sim += dot / (hn * rn) if hn and rn else dot
            delta = max(mine[0][""] - 1, 0) - max(counts[0][""] - 1, 0)
            total += sim * math.exp(-delta * delta / (2 * sigma**2))
        return total / n / len(theirs) * 10

    def of_block(held: pa.Table, told: pa.Table) -> pa.Table:
        df: list[dict] = [{} for _ in range(n + 1)]
        for blob in told.column("known").to_pylist():
            for k, grams, some in gr.unlisted(blob):
                df[k].update(zip(grams.to_pylist(), some.tolist()))
        parts = []
        for blob in held.column("blob").to_pylist():
            rows = _opened(blob)
            at, scores = [], []
            for i in range(len(rows)):
                mine, theirs = _item_counts(rows.column(1)[i].as_py(), n)
                # an item without a candidate has no difference of lengths
                if len(mine) == len(names) and theirs:
                    at.append(i)
                    scores.append([score(mine[side], theirs, df) for side in range(len(names))])
            columns = [pa.array([x[side] for x in scores], pa.float64()) for side in range(len(names))]
            parts.append(pa.table([rows.column(0).take(pa.array(at, pa.int64())), *columns], names=[field.name, *names]))
        return pa.concat_tables(parts)

    schema = StructType([field, *[StructField(name, DoubleType()) for name in names]])
    return blocks.select("block", "blob").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(of_block, schema)


def cider(
    cands: DataFrame, refs: DataFrame, item: str, cand: str, ref_id: str, ref: str, n: int = 4, sigma: float = 6.0,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Clipped tf-idf cosine over 1..n-grams with a length penalty, averaged over references, times ten.

    The length compared is the number of bigrams, as in the public scorer.
    """
    texts = _texts(cands, refs, item, cand, ref_id, ref)
    if blocks is None:
        blocks = pin(_blocks(texts, BLOCK_TOKENS))
    return _ciders(blocks, texts.schema[item], ["cider"], n, sigma)


def caption_report(cands: DataFrame, refs: DataFrame, item: str, cand: str, ref_id: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """All metrics per item, and the corpus row (BLEU from corpus counts, the others as means)."""
    texts = _texts(cands, refs, item, cand, ref_id, ref)
    blocks = pin(_blocks(texts, BLOCK_TOKENS))
    # both are asked for twice: by the rows of the items and by the corpus row
    stats = pin(bleu_statistics(cands, refs, item, cand, ref_id, ref, texts=_unblocked(blocks, texts)))
    per = pin(
        bleu_per_item(stats, item).join(rouge_l(cands, refs, item, cand, ref), item).join(
            cider(cands, refs, item, cand, ref_id, ref, blocks=blocks), item
        )
    )
    means = per.agg(F.avg("rouge_l").alias("rouge_l"), F.avg("cider").alias("cider"))
    corpus = bleu_corpus(stats)
    long = corpus.unpivot([], corpus.columns, "metric", "value").unionByName(means.unpivot([], means.columns, "metric", "value"))
    return per, long


def self_critical_reward(
    sampled: DataFrame, greedy: DataFrame, refs: DataFrame, item: str, cand: str, ref_id: str, ref: str,
    cider_weight: float = 1.0, bleu_weight: float = 0.0,
) -> DataFrame:
    """Weighted metric of the sampled caption minus that of the greedy one."""

    # both captions of an item in one row: the references are read, and asked for, once
    texts = _texts([sampled, greedy], refs, item, cand, ref_id, ref)
    blocks = pin(_blocks(texts, BLOCK_TOKENS))
    scored = _ciders(blocks, texts.schema[item], ["s", "g"], 4, 6.0).select(item, *[(F.col(x) * cider_weight).alias(x) for x in "sg"])
    if bleu_weight:
        for side, name in enumerate("sg"):
            stats = bleu_statistics(sampled, refs, item, cand, ref_id, ref, texts=_unblocked(blocks, texts), side=side)
            b = bleu_per_item(stats, item).select(item, F.col("bleu4").alias("_bleu4"))
            scored = scored.join(b, item).withColumn(name, F.col(name) + F.col("_bleu4") * bleu_weight).drop("_bleu4")
    return scored.select(item, (F.col("s") - F.col("g")).alias("reward"))
