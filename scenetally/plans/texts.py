"""Caption metrics and text rules on conversation turns, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetally.functions import answers as an
from scenetally.functions import arrays
from scenetally.operators import captions as ca
from scenetally.operators import vocabulary as vo
from scenetally.plans.registry import Tables, query, r
from scenetally.plans.views import REPLIES, replies


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each turn as a caption, the next turn as its one reference."""
    both = replies(t)
    return both.select("item", "cand"), both.select("item", F.lit(0).alias("ref_id"), "ref")


def grams(side: str, name: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT item, {k} AS n, unnest(list_transform(range(1, len({side}) - {k - 2}), lambda i : array_to_string({side}[i:i + {k - 1}], ' '))) AS gram FROM replies"
        for k in range(1, 5)
    )
    return f"{name} AS (SELECT item, n, gram, count(*) AS tf FROM ({parts}) GROUP BY ALL)"


BLEU = REPLIES + f"""{grams('cand', 'cg')}, {grams('ref', 'rg')},
hit AS (SELECT c.item, c.n, sum(least(c.tf, r.tf)) AS h FROM cg c JOIN rg r ON c.item = r.item AND c.n = r.n AND c.gram = r.gram GROUP BY ALL),
st AS (SELECT item, len(cand) AS tl, len(ref) AS rl, """ + ", ".join(
    f"coalesce((SELECT h FROM hit WHERE hit.item = replies.item AND n = {k}), 0) AS c{k}, greatest(len(cand) - {k - 1}, 0) AS g{k}" for k in range(1, 5)
) + " FROM replies)"


def bleu_sql(k: int) -> str:
    product = " * ".join(f"(c{i} + 1e-15) / (g{i} + 1e-9)" for i in range(1, k + 1))
    ratio = "((tl + 1e-15) / (rl + 1e-9))"
    return f"round(pow({product}, 1.0 / {k}) * CASE WHEN {ratio} < 1 THEN exp(1 - 1 / {ratio}) ELSE 1 END, 6) AS bleu{k}"


BLEUS = ", ".join(bleu_sql(k) for k in range(1, 5))


@query("bleu_per_item", f"WITH {BLEU} SELECT item, {BLEUS} FROM st")
def _(t):
    c, refs = sides(t)
    per = ca.bleu_per_item(ca.bleu_statistics(c, refs, "item", "cand", "ref_id", "ref"), "item")
    return per.select("item", *[r(f"bleu{k}") for k in range(1, 5)])


SUMS = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in ["tl", "rl", *[f"{p}{k}" for p in "cg" for k in range(1, 5)]])


@query("bleu_corpus", f"WITH {BLEU}, tot AS (SELECT {SUMS} FROM st) SELECT {BLEUS} FROM tot")
def _(t):
    c, refs = sides(t)
    corpus = ca.bleu_corpus(ca.bleu_statistics(c, refs, "item", "cand", "ref_id", "ref"))
    return corpus.select(*[r(f"bleu{k}") for k in range(1, 5)])


CIDER = REPLIES + f"""{grams('cand', 'cg')}, {grams('ref', 'rg')},
df AS (SELECT n, gram, count(*) AS d FROM rg GROUP BY ALL), nn AS (SELECT ln(count(*)::DOUBLE) AS l FROM replies),
h AS (SELECT c.item, c.n, c.gram, c.tf * (l - ln(greatest(coalesce(d, 1), 1)::DOUBLE)) AS w FROM cg c LEFT JOIN df USING (n, gram), nn),
rr AS (SELECT c.item, c.n, c.gram, c.tf * (l - ln(greatest(coalesce(d, 1), 1)::DOUBLE)) AS w FROM rg c LEFT JOIN df USING (n, gram), nn),
hn AS (SELECT item, n, sqrt(sum(w * w)) AS x FROM h GROUP BY ALL), rn AS (SELECT item, n, sqrt(sum(w * w)) AS x FROM rr GROUP BY ALL),
dot AS (SELECT h.item, h.n, sum(least(h.w, rr.w) * rr.w) AS v FROM h JOIN rr ON h.item = rr.item AND h.n = rr.n AND h.gram = rr.gram GROUP BY ALL),
sim AS (SELECT item, sum(CASE WHEN hn.x <> 0 AND rn.x <> 0 THEN v / (hn.x * rn.x) ELSE v END) AS s FROM dot JOIN hn USING (item, n) JOIN rn USING (item, n) GROUP BY item),
ci AS (SELECT r.item, coalesce(s, 0) * exp(-pow(greatest(len(cand) - 1, 0) - greatest(len(ref) - 1, 0), 2) / 72.0) / 4 * 10 AS cider FROM replies r LEFT JOIN sim USING (item))"""


@query("cider", f"WITH {CIDER} SELECT item, round(cider, 6) AS cider FROM ci")
def _(t):
    c, refs = sides(t)
    return ca.cider(c, refs, "item", "cand", "ref_id", "ref").select("item", r("cider"))


@query("rouge_l")
def _(t):
    c, refs = sides(t)
    return ca.rouge_l(c, refs, "item", "cand", "ref").select("item", r("rouge_l"))


@query("caption_report")
def _(t):
    """Every metric of every item, and those of the whole corpus in the rows without an item."""
    c, refs = sides(t)
    per, corpus = ca.caption_report(c, refs, "item", "cand", "ref_id", "ref")
    each = per.unpivot("item", [m for m in per.columns if m != "item"], "metric", "value")
    whole = corpus.withColumn("item", F.lit(None).cast("string"))
    return each.unionByName(whole).select("item", "metric", r("value"))


IN_ORDER = "list_filter(cand, lambda w, i : list_position(cand, w) = i)"


@query(
    "self_critical_reward",
    f"""WITH a AS (WITH {CIDER} SELECT item, cider FROM ci),
b AS (WITH {CIDER.replace("a.ws AS cand", IN_ORDER.replace("cand", "a.ws") + " AS cand")} SELECT item, cider FROM ci)
SELECT item, round(a.cider - b.cider, 6) AS reward FROM a JOIN b USING (item)""",
)
def _(t):
    """Sampled caption: the whole turn. Greedy caption: its distinct words in order."""
    c, refs = sides(t)
    greedy = c.select("item", F.array_distinct("cand").alias("cand"))
    return ca.self_critical_reward(c, greedy, refs, "item", "cand", "ref_id", "ref").select("item", r("reward"))


# ---- text rules -----------------------------------------------------------------------------------------------------


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_steps() -> str:
    """One subquery per mark, so the text does not double with every step."""
    ctes, previous = ["s0 AS (SELECT doc_id, text AS x, text AS o FROM documents)"], "s0"
    for i, mark in enumerate(an.PUNCTUATION, start=1):
        edge = f"contains(x, {sql_text(mark + ' ')}) OR contains(x, {sql_text(' ' + mark)}) OR regexp_matches(x, '[0-9],[0-9]')"
        ctes.append(f"s{i} AS (SELECT doc_id, x, CASE WHEN {edge} THEN replace(o, {sql_text(mark)}, '') ELSE replace(o, {sql_text(mark)}, ' ') END AS o FROM {previous})")
        previous = f"s{i}"
    return ",\n".join(ctes) + f",\nbare AS (SELECT doc_id, regexp_replace(regexp_replace(o, '\\.+(\\.[0-9])', '\\1', 'g'), '\\.+([^0-9.]|$)', '\\1', 'g') AS o FROM {previous})"


def case_sql(table: dict[str, str]) -> str:
    return "CASE w " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items()) + " ELSE w END"


@query(
    "answer_normalise",
    f"""WITH {strip_steps()},
    ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(o), '[ \\t\\n\\r]+'), lambda w : w <> '') AS l FROM bare),
    e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM ws),
    d AS (SELECT doc_id, i, {case_sql(an.NUMBER_WORDS)} AS w FROM e),
    k AS (SELECT doc_id, i, {case_sql(an.CONTRACTIONS)} AS w FROM d WHERE w NOT IN ('a', 'an', 'the'))
    SELECT documents.doc_id, md5(coalesce(a, '')) AS digest, coalesce(n, 0) AS n_words FROM documents LEFT JOIN
    (SELECT doc_id, replace(string_agg(w, ' ' ORDER BY i), ',', '') AS a, count(*) AS n FROM k GROUP BY 1) USING (doc_id)""",
)
def _(t):
    out = t.documents.select("doc_id", an.normalise_answer(F.col("text")).alias("a"))
    words = F.when(F.col("a") == "", 0).otherwise(F.size(F.split("a", " ")))
    return out.select("doc_id", F.md5("a").alias("digest"), words.cast("long").alias("n_words"))


@query(
    "question_tokens",
    """SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(replace(replace(regexp_replace(lower(text), '[.,''!?"()*#:;]', '', 'g'), '-', ' '), '/', ' '), '[ \\t\\n\\r]+'), lambda w : w <> ''), ' ') AS tokens FROM conversations""".replace("\\\\", "\\"),
)
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(an.question_tokens(F.col("text")), " ").alias("tokens"))


@query("caption_tokens")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(an.caption_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "pair_truncate",
    f"""WITH {REPLIES} l AS (SELECT item, len(cand) AS a, len(ref) AS b FROM replies)
    SELECT item, least(a, greatest(60 - b, 30))::INT AS n_a, least(b, greatest(60 - a, 30))::INT AS n_b FROM l""",
)
def _(t):
    a, b = an.pair_truncate(F.col("cand"), F.col("ref"), 60)
    return replies(t).select("item", F.size(a).alias("n_a"), F.size(b).alias("n_b"))


@query(
    "truncate_pad_mask",
    f"""WITH {REPLIES} l AS (SELECT item, cand FROM replies)
    SELECT item, array_to_string(list_transform(range(1, 38), lambda i : coalesce(cand[i], '[PAD]')), ' ') AS padded, list_sum(list_transform(range(1, 38), lambda i : CASE WHEN i <= len(cand) THEN 1 ELSE 0 END))::BIGINT AS n_real FROM l""",
)
def _(t):
    mask = F.aggregate(arrays.pad_mask("cand", 37), F.lit(0).cast("long"), lambda a, v: a + v)
    return replies(t).select("item", F.array_join(arrays.truncate_pad("cand", 37, "[PAD]"), " ").alias("padded"), mask.alias("n_real"))


@query(
    "split_id_offset",
    """SELECT doc_id, doc_id + CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1000000 ELSE 2000000 END AS number FROM documents""",
)
def _(t):
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "val").otherwise("test")
    return t.documents.select("doc_id", an.split_id(F.concat_ws("-", split, "doc_id")).alias("number"))


@query(
    "extract_link_fields",
    """WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS x FROM pages),
    e AS (SELECT page_id, unnest(range(greatest(len(h), len(x)))) AS i, h, x FROM m)
    SELECT page_id, i::INT AS pos, h[i + 1] AS href, x[i + 1] AS label FROM e""",
)
def _(t):
    fields = an.extract_fields(F.col("html"), {"href": '<a href="([^"]*)">', "label": '<a href="[^"]*">([^<]*)</a>'})
    return t.pages.select("page_id", F.posexplode(fields).alias("pos", "m")).select("page_id", "pos", "m.href", "m.label")


@query(
    "pair_key_split",
    """WITH s AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS x, array_to_string(string_split(p_name, ' ')[2:], ' ') AS y FROM part)
    SELECT p_partkey, x, y, x || ' // ' || y AS pair FROM s""",
)
def _(t):
    from scenetally.operators.votes import pair_key, split_pair

    w = F.split("p_name", " ")
    keyed = t.part.select("p_partkey", pair_key(w[0], F.array_join(F.slice(w, 2, F.size(w)), " ")).alias("pair"))
    x, y = split_pair(F.col("pair"))
    return keyed.select("p_partkey", x.alias("x"), y.alias("y"), "pair")


@query("name_substitution")
def _(t):
    """Words of each turn with every fifth word standing for an object of the turn."""
    objects = F.array(F.lit("person"), F.lit("dog"), F.lit("person"), F.lit("car"), F.lit("tree"))
    names = F.array(*[F.lit(n) for n in ("Ono", "Talu", "Mire", "Sefa")])
    tokens = F.transform(vo.words(F.col("text")), lambda w, i: F.when(i % 5 == 4, F.concat(F.lit("["), i % 7, F.lit("]"))).otherwise(w))
    listed = t.conversations.select("conv_id", "turn", tokens.alias("tokens"))
    text, index = an.substitute_names(F.col("tokens"), objects, names, F.crc32(F.concat_ws("-", "conv_id", "turn")))
    return listed.select("conv_id", "turn", F.array_join(text, " ").alias("tokens"), F.array_join(index, " ").alias("objects"))
