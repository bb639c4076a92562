"""MinHash near-duplicates with fast similarity sketches.

Sketch. Rounds of hashed bin placement: in round i every shingle goes to a hashed bin with the value i + fraction; a bin
keeps its smallest value. After as many rounds as bins, round bins + b puts all shingles into bin b, so every bin fills.
Equal bins of two sets estimate their similarity with concentration bounds like k independent minima, at the cost of
about bins * ln(bins) placements a text.

Banding. ``BANDS`` bands of ``ROWS`` bins. At the threshold of 0.75 a pair misses every band with probability
(1 - 0.75^7)^80, about 1 in 100,000; more similar pairs far less. Texts with the same shingle set are one class first.

Verification. Inside a band bucket a first pivot (who meets most others) is compared with all members on full shingle sets; buckets
whose members are then in one component are done. In the rest every pair of a bucket across components is compared,
unless its sizes or its distances to the pivot rule the link out (exact bounds), or four bits of every sketch bin differ too often (a pair at the threshold is
lost to that once in 70,000). So no link is lost to a cap, and no pair inside a component is listed. Components come from alternating large and small stars. Buckets, links and components
stay in Spark; counts alone reach the driver. Copies are combined before shuffles, hot bucket keys meet in skew joins.

Defined results: null, empty and word-less texts have an empty set, are linked with nothing and keep their own id; each
row that repeats an id has the set size and class of its own text, and links of that id are confirmed on its smallest
text; a null id is its own row, in no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import LOWER, NOT_SPACE, Words, batch_of, frugal, keep, mix, ngrams, pieces, texts, unused

BANDS, ROWS = 80, 7
_LOW = np.uint64((1 << 40) - 1)
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_sets(docs: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``size``: the whole sequence as one."""
    words = Words([d.translate(LOWER) for d in docs], NOT_SPACE)
    h = words.hashes()
    every = ngrams(h, tuple(range(size)))
    out = []
    for d in range(len(docs)):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], tuple(range(b - a)), salt=1))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes (at least one)."""
    none = np.uint64(2**64 - 1)
    out = np.full(bins, none, dtype=np.uint64)
    per = int(min(64, max(1, 2 * bins // len(items))))
    done = 0
    while done < bins:
        rounds = np.arange(done, min(bins, done + per))
        x = mix(items[None, :] ^ _SEEDS[rounds][:, None])
        place = ((x >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        value = (rounds.astype(np.uint64) << np.uint64(40))[:, None] | (x & _LOW)
        np.minimum.at(out, place.astype(np.int64).ravel(), value.ravel())
        done += len(rounds)
        if not (out == none).any():
            return out
    for b in np.flatnonzero(out == none):  # the fixed rounds
        out[b] = (np.uint64(bins + b) << np.uint64(40)) | (mix(items ^ _SEEDS[bins + b]) & _LOW).min()
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for r in range(rows):
        acc = mix(acc + values.reshape(bands, rows)[:, r])
    return acc.view(np.int64)


def packed(values: np.ndarray) -> np.ndarray:
    """Four bits of every bin, sixteen bins to a 64-bit word."""
    nibbles = np.zeros(-(-len(values) // 16) * 16, dtype=np.uint64)
    nibbles[: len(values)] = mix(values) & np.uint64(15)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(nibbles.reshape(-1, 16) << shifts, axis=1).view(np.int64)


def most_unequal(percent: int, bins: int) -> int:
    """Unequal four-bit bins that a pair at the threshold exceeds by chance about once in 70,000 (4.2 deviations)."""
    p = (1 - percent / 100) * 15 / 16
    return int(bins * p + 4.2 * (bins * p * (1 - p)) ** 0.5) + 1


def _text_key(text_col: str):
    """128-bit hash of a text; null is like empty, which is kept anyway."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, set_a, set_b, bands, bits, key): set size, 128-bit hash of the set, band hashes and packed sketch (null for
    an empty set), and the hash of the text."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("set_a", T.LongType()),
            T.StructField("set_b", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.ArrayType(T.LongType())),
            T.StructField("key", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = texts(b.column(1))
            n, keys, hashed, bits = [], [], [], []
            for i, j in pieces(every):
                for s in shingle_sets(every[i:j], size):
                    n.append(len(s))
                    keys.append([int((mix(s ^ np.uint64(k))).sum(dtype=np.uint64).astype(np.int64)) for k in (0x5555, 0xAAAA)])
                    made = sketch(s, bands * rows) if len(s) else None
                    hashed.append(None if made is None else band_hashes(made, bands, rows))
                    bits.append(None if made is None else packed(made))
            yield batch_of(schema, [b.column(0), n, [k[0] for k in keys], [k[1] for k in keys], hashed, bits, b.column(2)])

    return docs.select(id_col, F.col(text_col).cast("string"), _text_key(text_col)).mapInArrow(frugal(run), schema)


def verified(pairs: DataFrame, text: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, distance, linked) of every pair: Jaccard distance of the full shingle sets, and whether
    100 * intersection >= percent * union. ``text``: (id, text)."""
    schema = T.StructType(
        [
            T.StructField("a", T.LongType()),
            T.StructField("b", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("linked", T.BooleanType()),
        ]
    )
    both = (
        pairs.join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            known: dict[int, np.ndarray] = {}
            for ids, column in ((a, batch.column(2)), (b, batch.column(3))):
                fresh = {i: t for i, t in zip(ids, texts(column)) if i not in known}
                docs = list(fresh.values())
                sets = [s for i, j in pieces(docs) for s in shingle_sets(docs[i:j], size)]
                known.update(zip(fresh, sets))
            union = np.array([len(np.union1d(known[x], known[y])) for x, y in zip(a, b)], dtype=np.int64)
            common = np.array([len(known[x]) + len(known[y]) for x, y in zip(a, b)], dtype=np.int64) - union
            linked = pa.array(100 * common >= percent * union)
            yield batch_of(schema, [batch.column(0), batch.column(1), pa.array(1 - common / np.maximum(union, 1)), linked])

    return both.mapInArrow(frugal(run), schema)


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest reachable id of every id in links (two columns), but for the smallest ids themselves."""
    ends = links.toDF("u", "v")
    edges = keep(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        arms = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(arms).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = keep(small)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _labelled(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that are not in one component yet, with their component."""
    rows = buckets.join(parts, "id", "left").select(*buckets.columns, F.coalesce("component", "id").alias("component"))
    open_ = rows.groupBy("band").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h").select("band")
    return rows.join(open_, "band", "left_semi")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, key) of every row; ids are integers, the key is the hash of the row's text."""
    made = keep(sketches(docs, id_col, text_col, size, bands, rows))
    narrow = made.select("id", "n", "set_a", "set_b", "key")
    classes = narrow.where("n > 0 and id is not null").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"))
    members = keep(narrow.join(classes, ["n", "set_a", "set_b"], "left").select("id", "n", "rep", "key"))
    filled = made.where("bands is not null and id is not null")
    # two classes in a bucket differ in the first half of their set hash
    shared = (
        filled.select(F.explode("bands").alias("band"), "set_a")
        .groupBy("band")
        .agg(F.min("set_a").alias("_l"), F.max("set_a").alias("_h"))
        .where("_l < _h")
        .select("band")
    )
    met = filled.select(F.explode("bands").alias("band"), "id").join(shared, "band", "left_semi")
    reps = members.where("rep is not null").select("id", F.col("rep").cast("long").alias("rep"), "n").distinct()
    buckets = keep(met.join(reps, "id").select("band", F.col("rep").alias("id"), "n").distinct())
    wanted = buckets.select("id").distinct()
    text = keep(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(wanted, "id", "left_semi")
        .groupBy("id")
        .agg(F.min("text").alias("text"))
    )
    # round 0: the member that meets most others is the pivot of a bucket; all members get their distance to it
    sizes = buckets.groupBy("band").agg(F.count("*").alias("m"))
    meets = buckets.join(sizes, "band").groupBy("id").agg(F.sum("m").alias("m"))
    pivots = keep(buckets.join(meets, "id").groupBy("band").agg(F.max_by("id", F.struct("m", "id")).alias("a")))
    pairs = buckets.join(pivots, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    tested = keep(verified(pairs, text, size, percent))
    links = tested.where("linked").select("a", "b")
    far = tested.select("a", F.col("b").alias("id"), "distance")
    buckets = keep(
        buckets.join(pivots, "band").join(far, ["a", "id"], "left").select("band", "id", "n", F.coalesce("distance", F.lit(0.0)).alias("d"))
    )
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parts = components(links)
    left = keep(_labelled(buckets, parts))
    if left.head(1):
        bits = (
            filled.select(F.col("id").cast("long").alias("id"), F.struct("bits", "bands").alias("s"))
            .join(left.select("id").distinct(), "id", "left_semi")
            .groupBy("id")
            .agg(F.min("s").alias("s"))
            .select("id", "s.bits", "s.bands")
        )
        left = left.join(bits, "id")
        other = left.select("band", F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("component", "n", "d", "bits", "bands")])
        # Jaccard distance is a metric: members whose distances to the pivot differ by more than the threshold allows are
        # further apart than it, and so are sets of too different sizes; then the sketches must not be too unequal; last, a
        # pair is listed in the first of its common bands only
        fold = " | ".join(f"shiftrightunsigned(x ^ y, {k})" for k in range(4))
        unequal = f"aggregate(zip_with(bits, _bits, (x, y) -> bit_count(({fold}) & {0x1111111111111111}L)), 0, (s, x) -> s + x)"
        possible = F.expr(
            f"id < b AND component <> _component AND abs(d - _d) <= {1 - percent / 100} + 1e-9"
            f" AND 100 * least(n, _n) >= {percent} * greatest(n, _n) AND {unequal} <= {most_unequal(percent, bands * rows)}"
            " AND array_min(array_intersect(bands, _bands)) = band"
        )
        pairs = left.join(other, "band").where(possible).select(F.col("id").alias("a"), "b").distinct()
        now_tested = keep(verified(pairs.join(tested, ["a", "b"], "left_anti"), text, size, percent))
        # a component is linked to its smallest id, so only new links are added to that
        parts = components(parts.union(now_tested.where("linked").select("a", "b")))
    own = members.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return own.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        "key",
    )


def near_duplicates(docs: DataFrame, *args, **names) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; see judged()."""
    return judged(docs, *args, **names).drop("key")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows that are kept, with all columns. A row goes for its own text: what else has its id does not matter."""
    gone, key = unused(docs, "_gone"), unused(docs, "_key")
    found = judged(docs, id_col, text_col, **settings).where("not kept").select(F.col(id_col).alias(gone), F.col("key").alias(key))
    same = (F.col(id_col) == F.col(gone)) & (_text_key(text_col) == F.col(key))
    return docs.join(found.distinct(), same, "left_anti")
