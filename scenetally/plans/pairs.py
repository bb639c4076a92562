"""Co-occurrence and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.operators import cooccurrence as co
from scenetally.operators import vocabulary as vo
from scenetally.plans.registry import START_PARTS, Tables, query, r, spread
from scenetally.plans.views import BASKETS, DOC_WORDS, baskets, doc_words

PAIR_COUNTS = BASKETS + """,
sets AS (SELECT DISTINCT record, item FROM baskets),
pairs AS (SELECT a.item AS hi, b.item AS lo, count(*) AS n FROM sets a JOIN sets b ON a.record = b.record AND a.item >= b.item GROUP BY ALL),
total AS (SELECT count(DISTINCT record)::DOUBLE AS t FROM sets)"""

EXCESS = PAIR_COUNTS + """,
marg AS (SELECT hi AS item, n FROM pairs WHERE hi = lo),
excess AS (SELECT p.hi, p.lo, p.n, p.n / t AS p_joint, x.n * y.n / (t * t) AS p_indep,
  p.n / t - x.n * y.n / (t * t) AS excess, ln((p.n / t) / (x.n * y.n / (t * t))) AS lift
  FROM pairs p JOIN marg x ON p.hi = x.item JOIN marg y ON p.lo = y.item, total)"""


def excess_frame(t: Tables) -> DataFrame:
    b = baskets(t)
    pairs = co.set_cooccurrence(b, "record", "item")
    total = b.agg(F.count_distinct("record").alias("t")).scalar()
    return co.excess_joint(pairs, total)


@query("set_cooccurrence", f"WITH {PAIR_COUNTS} SELECT hi, lo, n FROM pairs")
def _(t):
    return co.set_cooccurrence(baskets(t), "record", "item")


@query(
    "excess_cooccurrence",
    f"WITH {EXCESS} SELECT hi, lo, n, round(p_joint, 8) AS p_joint, round(p_indep, 8) AS p_indep, round(excess, 8) AS excess, round(lift, 8) AS lift FROM excess",
)
def excess_cooccurrence(t):
    return excess_frame(t).select("hi", "lo", "n", r("p_joint", 8), r("p_indep", 8), r("excess", 8), r("lift", 8))


@query(
    "conditional_probability",
    f"""WITH {PAIR_COUNTS}, marg AS (SELECT hi AS item, n FROM pairs WHERE hi = lo),
    both_ways AS (SELECT hi AS item, lo AS cond, n FROM pairs UNION ALL SELECT lo, hi, n FROM pairs WHERE hi <> lo)
    SELECT b.item, b.cond, b.n, round(b.n / m.n, 8) AS p FROM both_ways b JOIN marg m ON b.cond = m.item""",
)
def _(t):
    p = co.conditional_probability(co.set_cooccurrence(baskets(t), "record", "item"))
    return p.select("item", "cond", "n", r("p", 8))


@query(
    "top_excess_pairs",
    f"""WITH {EXCESS} SELECT hi, lo, n, round(excess, 10) AS excess FROM (
    SELECT * FROM excess WHERE hi <> lo AND hi <> 'Brand#1' AND lo <> 'Brand#1' ORDER BY abs(round(excess, 10)) DESC, hi, lo LIMIT 100)
    WHERE hi <> lo || 's' AND lo <> hi || 's' AND replace(hi, ' ', '') <> replace(lo, ' ', '')""",
)
def _(t):
    rounded = excess_frame(t).withColumn("excess", F.round("excess", 10))
    top = co.top_pairs(rounded, "excess", 100, background="Brand#1")
    # the plural filter follows the cut, so fewer rows may be left
    return top.where(co.not_plural_pair("hi", "lo")).select("hi", "lo", "n", r("excess", 10))


@query(
    "top_lift_pairs_named",
    f"""WITH {EXCESS}, names AS (SELECT p_brand AS k, min(p_name) AS nm FROM part GROUP BY 1), tops AS (
    SELECT hi, lo, n, round(lift, 10) AS lift FROM excess WHERE hi <> lo ORDER BY abs(round(lift, 10)) DESC, hi, lo LIMIT 50)
    SELECT t.*, x.nm AS hi_name, y.nm AS lo_name FROM tops t LEFT JOIN names x ON hi = x.k LEFT JOIN names y ON lo = y.k""",
)
def _(t):
    names = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.min("p_name").alias("nm"))
    top = co.top_pairs(excess_frame(t).withColumn("lift", F.round("lift", 10)), "lift", 50)
    return co.class_names(top, names, "k", "nm").select("hi", "lo", "n", r("lift", 10), "hi_name", "lo_name")


# ---- words -------------------------------------------------------------------------------------------------------

CUT = DOC_WORDS + """,
counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word),
ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS class_id,
  sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_n FROM counts),
nouns AS (SELECT * FROM ranked WHERE cum_n - n < 0.3 * (SELECT sum(n) FROM counts))"""


def noun_table(t: Tables) -> DataFrame:
    """Most frequent words that make up 30 % of all tokens."""
    counts = vo.word_counts(doc_words(t))
    limit = counts.agg((F.sum("n") * 0.3).alias("x")).scalar()
    return vo.cumulative_cutoff(counts, limit)


@query("word_frequency", f"WITH {DOC_WORDS} SELECT word, count(*) AS n FROM doc_words GROUP BY word")
def _(t):
    return vo.word_counts(doc_words(t))


@query("cumulative_cutoff_vocabulary", f"WITH {CUT} SELECT word, n, class_id, cum_n FROM nouns")
def _(t):
    return noun_table(t)


@query(
    "noun_frequency",
    f"""WITH {DOC_WORDS}, lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{vo.WORD}')) AS word FROM benchmark)
    SELECT word, count(*) AS n FROM doc_words SEMI JOIN lex USING (word) GROUP BY word""",
)
def _(t):
    lexicon = vo.explode_words(t.benchmark, "item_id", "text").select("word").distinct()
    return vo.noun_frequency(doc_words(t), lexicon)


@query(
    "noun_set",
    f"""WITH {DOC_WORDS}, lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{vo.WORD}')) AS word FROM benchmark)
    SELECT DISTINCT word FROM doc_words SEMI JOIN lex USING (word)""",
)
def _(t):
    lexicon = vo.explode_words(t.benchmark, "item_id", "text").select("word").distinct()
    return doc_words(t).select("word").distinct().join(lexicon, "word", "left_semi")


@query(
    "bag_cooccurrence",
    f"""WITH {CUT}, c AS (SELECT doc_id, word, count(*) AS n FROM doc_words SEMI JOIN nouns USING (word) GROUP BY ALL)
    SELECT a.word AS hi, b.word AS lo,
      sum(CASE WHEN a.word = b.word THEN a.n * (a.n + 1) // 2 ELSE a.n * b.n END)::BIGINT AS n
    FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.word >= b.word GROUP BY ALL""",
)
def _(t):
    counted = doc_words(t).join(noun_table(t).select("word"), "word", "left_semi")
    return co.bag_cooccurrence(counted, "doc_id", "word")


@query(
    "cross_modal_cooccurrence",
    f"""WITH {CUT}, c AS (SELECT doc_id, word, count(*) AS n FROM doc_words SEMI JOIN nouns USING (word) GROUP BY ALL)
    SELECT word, source AS cls, sum(n)::BIGINT AS n FROM c JOIN (SELECT DISTINCT doc_id, source FROM documents) USING (doc_id) GROUP BY ALL""",
)
def _(t):
    counted = doc_words(t).join(noun_table(t).select("word"), "word", "left_semi")
    classes = t.documents.select("doc_id", F.col("source").alias("cls"))
    return co.cross_cooccurrence(counted, classes, "doc_id", "word", "cls")


@query(
    "cross_modal_conditionals",
    f"""WITH {CUT}, c AS (SELECT doc_id, word, count(*) AS n FROM doc_words SEMI JOIN nouns USING (word) GROUP BY ALL),
    k AS (SELECT DISTINCT doc_id, source AS cls FROM documents WHERE source IS NOT NULL),
    x AS (SELECT word, cls, sum(n)::BIGINT AS n FROM c JOIN k USING (doc_id) GROUP BY ALL),
    mw AS (SELECT word, sum(n * (n + 1) // 2) AS m FROM c GROUP BY 1), mc AS (SELECT cls, count(*) AS m FROM k GROUP BY 1)
    SELECT word, cls, n, round(n / mw.m, 8) AS p_cls_given_word, round(n / mc.m, 8) AS p_word_given_cls FROM x JOIN mw USING (word) JOIN mc USING (cls)""",
)
def _(t):
    words_ = doc_words(t).join(noun_table(t).select("word"), "word", "left_semi")
    classes = t.documents.select("doc_id", F.col("source").alias("cls"))
    cross = co.cross_cooccurrence(words_, classes, "doc_id", "word", "cls")
    class_counts = co.marginals(co.set_cooccurrence(classes, "doc_id", "cls"))
    out = co.cross_conditionals(cross, co.bag_marginals(words_, "doc_id", "word"), class_counts, "word", "cls")
    return out.select("word", "cls", "n", r("p_cls_given_word", 8), r("p_word_given_cls", 8))


@query(
    "whole_word_tokens",
    rf"""WITH l AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(tion|ing)\b', ' #\1', 'g'), '#?{vo.WORD}') AS ws FROM documents),
    e AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM l),
    x AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM e)
    SELECT word, count(*) AS n FROM x WHERE NOT starts_with(word, '#') AND NOT starts_with(coalesce(nxt, ''), '#') GROUP BY word""",
)
def _(t):
    pieces = F.regexp_replace(F.lower("text"), r"(tion|ing)(?![a-zA-Z0-9_])", " #$1")
    tokens = F.regexp_extract_all(pieces, F.lit(f"#?{vo.WORD}"), F.lit(0))
    listed = t.documents.select("doc_id", tokens.alias("tokens"))
    kept = listed.select("doc_id", F.explode(vo.whole_word_tokens(F.col("tokens"))).alias("word"))
    return vo.word_counts(kept)


@query(
    "vocabulary_report",
    f"""WITH {DOC_WORDS}, counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word)
    SELECT count(*) AS n_words, count(*) FILTER (n <= 5) AS n_rare, sum(n)::BIGINT AS n_tokens,
    coalesce(sum(n) FILTER (n <= 5), 0)::BIGINT AS n_rare_tokens FROM counts""",
)
def _(t):
    return vo.vocabulary_report(vo.word_counts(doc_words(t)), 5)


@query(
    "length_histogram",
    f"WITH {DOC_WORDS} SELECT len(ws)::INT AS n_tokens, count(*) AS n FROM doc_lists GROUP BY 1",
)
def _(t):
    return vo.length_histogram(t.documents.select(vo.words(F.col("text")).alias("tokens")), "tokens")


@query(
    "rare_to_unknown",
    f"""WITH {DOC_WORDS}, counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word)
    SELECT CASE WHEN n <= 5 THEN 'UNK' ELSE word END AS word, count(*) AS n FROM doc_words JOIN counts USING (word) GROUP BY 1""",
)
def _(t):
    w = doc_words(t)
    return vo.word_counts(vo.rare_to_unknown(w, vo.word_counts(w), 5))


@query(
    "dense_word_ids",
    f"""WITH {DOC_WORDS}, counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word)
    SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS word_id FROM counts""",
)
def _(t):
    return vo.dense_ids(vo.word_counts(doc_words(t)), first=1)


FIRST_SEEN = DOC_WORDS + """,
seen AS (SELECT word, min(struct_pack(d := doc_id, p := pos)) AS first_at FROM doc_words GROUP BY word),
vocab AS (SELECT word, row_number() OVER (ORDER BY first_at) + 1 AS word_id FROM seen)"""


@query("token_index_first_seen", f"WITH {FIRST_SEEN} SELECT word, word_id FROM vocab")
def _(t):
    return vo.ids_by_first_seen(doc_words(t), "doc_id")


@query(
    "encode_documents",
    f"""WITH {DOC_WORDS}, counts AS (SELECT word, count(*) AS n FROM doc_words GROUP BY word),
    vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS word_id FROM counts WHERE n > 5)
    SELECT doc_id, string_agg(coalesce(word_id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids, count(*)::INT AS n_tokens
    FROM doc_words LEFT JOIN vocab USING (word) GROUP BY doc_id""",
)
def _(t):
    w = doc_words(t)
    vocab = vo.dense_ids(vo.word_counts(w).where("n > 5"), first=2)
    ids = vo.encode(w, vocab, "doc_id", None, unknown_id=1)
    return ids.select("doc_id", F.array_join("ids", " ").alias("ids"), "n_tokens")


@query(
    "encode_padded_decode",
    f"""WITH l AS (SELECT item_id, regexp_extract_all(lower(text), '{vo.WORD}') AS ws FROM benchmark),
    e AS (SELECT item_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM l),
    counts AS (SELECT word, count(*) AS n FROM e GROUP BY word),
    marked AS (SELECT item_id, pos, CASE WHEN n <= 1 THEN 'UNK' ELSE word END AS word FROM e JOIN counts USING (word) WHERE pos < 24),
    lastgood AS (SELECT item_id, max(pos) FILTER (word NOT IN ('the', 'a', 'of', 'and', 'UNK')) AS g, max(pos) AS m FROM marked GROUP BY 1)
    SELECT item_id, any_value(k)::INT AS n_tokens, string_agg(word, ' ' ORDER BY pos) FILTER (pos <= coalesce(g, m)) AS caption
    FROM marked JOIN lastgood USING (item_id) JOIN (SELECT item_id, len(ws) AS k FROM l) USING (item_id) GROUP BY item_id""",
)
def _(t):
    w = vo.explode_words(t.benchmark, "item_id", "text")
    unknown = t.spark.createDataFrame([("UNK", 1)], "word string, word_id long")
    vocab = vo.dense_ids(vo.word_counts(w).where("n > 1"), first=2).select("word", "word_id").unionByName(unknown)
    longest = 24
    ids = vo.encode(w, vocab, "item_id", longest, unknown_id=1)
    text = vo.decode(ids, vocab, "item_id", "ids", bad_endings=["the", "a", "of", "and", "UNK"])
    return text.join(ids.select("item_id", "n_tokens"), "item_id")


@query(
    "bad_ending_rate",
    r"""SELECT round(avg((list_last(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N} ]', '', 'g'), ' ')) IN ('the', 'of', 'and', 'in', 'de', 'la', 'und'))::INT), 8) AS rate FROM documents""",
)
def _(t):
    bare = t.documents.select(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N} ]", "").alias("text"))
    return vo.bad_ending_rate(bare, "text", ["the", "of", "and", "in", "de", "la", "und"]).select(r("rate", 8))


NGRAM_DF = f"""lists AS (SELECT doc_id, regexp_extract_all(lower(text), '{vo.WORD}') AS ws FROM documents),
grams AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, {k} AS n, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i : array_to_string(ws[i:i + {k - 1}], ' '))) AS gram FROM lists"
    for k in range(1, 5)
) + "), freq AS (SELECT n::INT AS n, gram, count(DISTINCT doc_id) AS df FROM grams GROUP BY ALL)"


@query("ngram_document_frequency", f"WITH {NGRAM_DF} SELECT n, gram, df FROM freq")
def _(t):
    scan = t.documents.select("doc_id", "text")
    listed = spread(scan).select("doc_id", vo.words(F.col("text")).alias("tokens"))
    # the grams take some four times the room of the scan packed, and many times that once a number is read
    parts = max(START_PARTS, min(16 * scan.rdd.getNumPartitions(), 2048))
    return vo.ngram_document_frequency(listed, "doc_id", "tokens", 4, rows_per_key="one", parts=parts)


@query(
    "vocab_lookup_unknown",
    f"""WITH {DOC_WORDS}, l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{vo.WORD}')) AS word FROM benchmark)
    SELECT CASE WHEN l.word IS NULL THEN 'UNK' ELSE l.word END AS entry, count(*) AS n FROM doc_words d LEFT JOIN l ON d.word = l.word GROUP BY 1""",
)
def _(t):
    entries = vo.explode_words(t.benchmark, "item_id", "text").select("word").distinct().withColumn("entry", F.col("word"))
    counted = vo.word_counts(doc_words(t))
    return vo.vocab_lookup(counted, entries, "word", "entry", "UNK").groupBy("entry").agg(F.sum("n").alias("n"))


@query(
    "caption_offsets",
    """WITH per AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    e AS (SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id)::BIGINT AS end_ix FROM per)
    SELECT conv_id, end_ix - n + 1 AS start_ix, end_ix FROM e""",
)
def _(t):
    return vo.caption_offsets(t.conversations, "conv_id")
