"""Word counts, vocabularies and encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetally.functions import arrays
from scenetally.operators import grams as gr
from scenetally.operators.ordered import positions, running

WORD = r"[\p{L}\p{M}\p{N}]+"

# text of documents whose grams are counted together
CHUNK_BYTES = 8 << 20
BATCH_ROWS = 65_536


def words(text: Column) -> Column:
    """Lower-case words of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def explode_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word), pos from 0."""
    return df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))


def whole_word_tokens(tokens: Column, nouns: Column | None = None) -> Column:
    """Tokens that are neither a '#' piece nor followed by one, and are nouns when a noun array is given."""

    def kept(every: Column) -> Column:
        def keep(t: Column, i: Column) -> Column:
            following = F.coalesce(F.get(every, i + 1), F.lit(""))
            whole = ~t.startswith("#") & ~following.startswith("#")
            return whole if nouns is None else whole & F.array_contains(nouns, t)

        return F.filter(every, keep)

    return arrays.let(tokens, kept)


def word_counts(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(word).agg(F.count("*").alias("n"))


def noun_frequency(tokens: DataFrame, nouns: DataFrame, word: str = "word") -> DataFrame:
    """Counts of the words that are in the noun lexicon; counted before the join so a frequent word is one row."""
    return word_counts(tokens, word).join(nouns.select(word).distinct(), word, "left_semi")


def cumulative_cutoff(counts: DataFrame, limit: Column | float, word: str = "word", n: str = "n") -> DataFrame:
    """Most frequent words until the running count reaches the limit; the word that crosses it is kept.

    Adds class_id (0-based place in frequency order) and cum_n.
    """
    ranked = running(counts, [], [f"-{n}", word], {"_pos": ("count", None), "cum_n": ("sum", n)})
    bound = limit if isinstance(limit, Column) else F.lit(limit)
    return ranked.where(F.col("cum_n") - F.col(n) < bound).select(
        word, n, (F.col("_pos") - 1).alias("class_id"), "cum_n"
    )


def dense_ids(counts: DataFrame, word: str = "word", n: str = "n", first: int = 0) -> DataFrame:
    return positions(counts, [], [f"-{n}", word], "_pos").select(
        word, n, (F.col("_pos") - 1 + first).alias("word_id")
    )


def ids_by_first_seen(tokens: DataFrame, key: str, pos: str = "pos", word: str = "word", first: int = 2) -> DataFrame:
    """Ids in order of first appearance; 0 and 1 stay free for padding and unknown."""
    seen = tokens.groupBy(word).agg(F.min(F.struct(key, pos)).alias("_at"))
    seen = seen.select(word, F.col(f"_at.{key}").alias("_k"), F.col(f"_at.{pos}").alias("_p"))
    return positions(seen, [], ["_k", "_p"], "_pos").select(word, (F.col("_pos") - 1 + first).alias("word_id"))


def rare_to_unknown(
    tokens: DataFrame, counts: DataFrame, threshold: int, unknown: str = "UNK", word: str = "word"
) -> DataFrame:
    """Words counted at most ``threshold`` times become the unknown word."""
    common = counts.where(F.col("n") > threshold).select(F.col(word).alias("_w"))
    return tokens.join(common, F.col(word) == F.col("_w"), "left").select(
        *[c for c in tokens.columns if c != word], F.coalesce("_w", F.lit(unknown)).alias(word)
    )


def encode(
    tokens: DataFrame, vocab: DataFrame, key: str, length: int | None, unknown_id: int, pad_id: int = 0
) -> DataFrame:
    """One id array per key in word order; with a length also cut and padded, plus the true length."""
    ids = tokens.join(vocab.select("word", "word_id"), "word", "left").select(
        key, "pos", F.coalesce("word_id", F.lit(unknown_id)).alias("_id")
    )
    rows = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_id"))).alias("_t"))
    seq = F.transform("_t", lambda s: s["_id"])
    if length is not None:
        seq = arrays.truncate_pad(seq, length, pad_id)
    return rows.select(key, seq.alias("ids"), F.size("_t").alias("n_tokens"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str, ids: str, bad_endings: list[str] | None = None) -> DataFrame:
    """Words until the first 0, listed endings stripped, '@@ ' joints closed."""
    at = F.array_position(F.col(ids), F.lit(0).cast("long"))
    live = F.when(at > 0, F.slice(ids, 1, at.cast("int") - 1)).otherwise(F.col(ids))
    # an empty caption keeps its row
    long = encoded.select(key, F.posexplode_outer(live).alias("pos", "word_id"))
    named = long.join(vocab.select("word", "word_id"), "word_id", "left")
    rows = named.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "word")))).alias("_w"))
    tokens = F.transform("_w", lambda s: s["word"])
    if bad_endings:
        bad = F.array(*[F.lit(b) for b in bad_endings])
        good = F.transform(tokens, lambda t, i: F.when(~F.array_contains(bad, t), i + 1).otherwise(0))
        last = F.coalesce(F.array_max(good), F.lit(0))
        # a caption of listed endings only is left as it is
        tokens = F.when(last > 0, F.slice(tokens, 1, last)).otherwise(tokens)
    return rows.select(key, F.replace(F.array_join(tokens, " "), F.lit("@@ "), F.lit("")).alias("caption"))


def bad_ending_rate(captions: DataFrame, text: str, endings: list[str]) -> DataFrame:
    last = F.element_at(F.split(F.col(text), " "), -1)
    return captions.agg(F.avg(last.isin(endings).cast("double")).alias("rate"))


def length_histogram(captions: DataFrame, tokens: str) -> DataFrame:
    return captions.groupBy(F.size(tokens).alias("n_tokens")).agg(F.count("*").alias("n"))


def vocabulary_report(counts: DataFrame, threshold: int) -> DataFrame:
    """Vocabulary size, rare share of words and of occurrences."""
    rare = F.col("n") <= threshold
    return counts.agg(
        F.count("*").alias("n_words"),
        F.count_if(rare).alias("n_rare"),
        F.sum("n").alias("n_tokens"),
        F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("n_rare_tokens"),
    )


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, word: str, value: str, default) -> DataFrame:
    """Left lookup with a default for unknown words."""
    return tokens.join(vocab.select(word, value), word, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """The first columns of several batches in one, until there is a chunk of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += batch.column(0).nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _chunks(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """Whole rows of about ``CHUNK_BYTES`` of text, a longer row alone."""
    flat = tokens.flatten()
    sizes = np.cumsum(np.append(0, pc.binary_length(flat).fill_null(0).to_numpy() + 1), dtype=np.int64)
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(sizes[ends] // CHUNK_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(tokens)]):
        yield tokens.slice(a, b - a)


def ngram_document_frequency(
    df: DataFrame, key: str, tokens: str, n: int = 4, rows_per_key: str = "many", parts: int | None = None
) -> DataFrame:
    """Documents holding each 1..n-gram.

    A key may have several rows (captions of one image). With rows_per_key='one' the shuffle by key is left out, the
    rows of a chunk are counted together, and what a chunk has for one of ``parts`` numbers is one compressed value; no
    task holds more than a chunk before the shuffle, nor more than the grams of a number after it.
    """
    if rows_per_key == "many":
        grams = df.select(key, F.explode(arrays.ngrams_up_to(tokens, n, distinct=True)).alias("g"))
        return grams.select(key, "g.n", "g.gram").distinct().groupBy("n", "gram").agg(F.count("*").alias("df"))

    spark = df.sparkSession
    numbers = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _gathered(batches):
            for chunk in _chunks(tokens):
                own = np.arange(len(chunk))
                blobs = list(gr.packed(*gr.coded(chunk, own, np.ones(len(chunk), bool), n), numbers))
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["number", "blob"])

    def add(held: pa.Table) -> pa.Table:
        out = []
        for k, grams in enumerate(gr.merged(held.column("blobs").combine_chunks().flatten().to_pylist(), n), start=1):
            sums = gr.totals(grams)
            for i in range(0, len(sums), BATCH_ROWS):
                part = sums[i : i + BATCH_ROWS]
                columns = [pa.array(np.full(len(part), k, np.int32)), grams.texts.slice(i, BATCH_ROWS), pa.array(part)]
                out.append(pa.RecordBatch.from_arrays(columns, ["n", "gram", "df"]))
        return pa.Table.from_batches(out, pa.schema([("n", pa.int32()), ("gram", pa.string()), ("df", pa.int64())]))

    blobs = df.select(F.col(tokens).cast("array<string>")).mapInArrow(count, "number int, blob binary")
    # dealt out before the sum: a sum ahead of the shuffle would hold, and spill, nearly every gram of its task
    dealt = blobs.repartition(*([parts] if parts else []), "number").groupBy("number").agg(F.collect_list("blob").alias("blobs"))
    return dealt.groupBy("number").applyInArrow(add, "n int, gram string, df long")


def caption_offsets(df: DataFrame, image: str) -> DataFrame:
    """1-based first and last caption index of every image, in image order."""
    per = df.groupBy(image).agg(F.count("*").alias("n"))
    ends = running(per, [], [image], {"end_ix": ("sum", "n")})
    return ends.select(image, (F.col("end_ix") - F.col("n") + 1).alias("start_ix"), "end_ix")
