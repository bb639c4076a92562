"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

Base spans (email, ip, card, phone) are exact rules on the whole text. The field adds spans they miss, such as a phone
number without its country code. It reads runs of neighbouring tokens that have a digit or an @; a token of letters only
is outside by definition, so the chain falls apart there and only the runs are decoded, by Viterbi over many runs at
once. Features are the word shape, a coarse shape, and the coarse shapes of both neighbours. The field is trained on a
small labelled table of at most ``TRAIN_RUNS`` runs: runs of at most ``TRAIN_DOCS`` sampled documents with the base spans
as labels, and the same phone numbers without country code. Added spans that touch a base span are dropped.

Defined results: null text is empty; offsets are code points, end exclusive; spans are listed by kind, then start; rows
that repeat are judged row by row; without labelled runs nothing is added; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetally.llm.common import batch_of, chosen, frugal

KINDS = ("email", "ip", "card", "phone")
# outside, then begin and inside of each kind
STATES = 1 + 2 * len(KINDS)
TRAIN_DOCS, TRAIN_RUNS = 6000, 6000
PART = 64  # a longer run is fitted in parts of so many tokens
CELLS = 100_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: what fails there fails at its later digits too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:  # a match holds an @ and starts as far left as its letters go
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if m:
            out.append((0, start, m.end()))
            done = at = m.end()
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


# tokens and runs


def shape(token: str) -> str:
    """Digits by count (up to five and more), letters by case, other marks as they are; repeats are joined."""
    token = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", token)
    return re.sub(r"\d+", lambda m: "ddddd"[: len(m[0])], token)


def coarse(token: str) -> str:
    digits = sum(c.isdigit() for c in token)
    size = bisect_right((0, 1, 3, 4, 6, 8, 12, 15, 19), digits - 1)
    flags = "".join(m if m in token else "." for m in "@-(+")
    return f"{size}{min(4, token.count('.'))}{flags}{any(c.isalpha() for c in token):d}"


Token = tuple[int, int]


def runs_of(text: str) -> list[list[Token]]:
    """Runs of neighbouring tokens with a digit or @, without punctuation around them."""
    out: list[list[Token]] = []
    stop = raw_end = -1
    for m in _MARK.finditer(text):
        if m.start() < stop:
            continue
        start, stop = m.start(), m.end()
        while start > max(raw_end, 0) and not text[start - 1].isspace():
            start -= 1
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        a, b = start, stop
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a == b:
            a, b = start, stop
        if out and start - raw_end <= 2 and text[raw_end:start].isspace():
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
        raw_end = stop
    return out


def labels_of(run: list[Token], spans: list[Span]) -> list[int]:
    out, held = [], None
    for a, b in run:
        hit = next((s for s in spans if s[1] < b and a < s[2]), None)
        out.append(0 if hit is None else 1 + 2 * hit[0] + (hit == held))
        held = hit
    return out


# the field


def padded(runs: list[list[tuple[str, str]]], shapes: dict[str, int], kinds: dict[str, int]):
    """Feature places (runs, length, 4) and the mask of runs of similar length; place 0 is the unknown."""
    longest = max(map(len, runs))
    at = np.zeros((len(runs), longest, 4), dtype=np.int64)
    mask = np.zeros((len(runs), longest), dtype=bool)
    for i, run in enumerate(runs):
        c = [kinds.get(k, 0) for _, k in run]
        n = len(run)
        at[i, :n, 0] = [shapes.get(s, 0) for s, _ in run]
        at[i, :n, 1] = c
        at[i, 1:n, 2] = c[:-1]
        at[i, : n - 1, 3] = c[1:]
        at[i, 0, 2] = at[i, n - 1, 3] = 1  # the edge of a run
        mask[i, :n] = True
    return at, mask


def emissions(at: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return sum(t[at[..., k]] for k, t in enumerate(tables))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(runs: list[list[tuple[str, str]]], labels: list[list[int]], steps: int = 120, rate: float = 0.5, l2: float = 1e-3):
    """Maximum likelihood by AdaGrad on forward-backward gradients over all runs at once."""
    shapes = {s: i for i, s in enumerate(sorted({s for r in runs for s, _ in r}), 1)}
    kinds = {k: i for i, k in enumerate(sorted({k for r in runs for _, k in r}), 2)}
    labels = [y[k : k + PART] for y in labels for k in range(0, len(y), PART)]
    runs = [r[k : k + PART] for r in runs for k in range(0, len(r), PART)]
    at, mask = padded(runs, shapes, kinds)
    n, length = mask.shape
    gold = np.zeros((n, length), dtype=np.int64)
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    sizes = [len(shapes) + 1, *[len(kinds) + 2] * 3]
    params = [np.zeros((s, STATES)) for s in sizes] + [np.zeros((STATES, STATES))]
    squares = [np.full_like(p, 1e-8) for p in params]
    one = np.eye(STATES)
    last = mask.sum(1) - 1
    pairs = mask[:, 1:]
    for _ in range(steps):
        e, move = emissions(at, params[:4]), params[4]
        fore = np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for t in range(1, length):
            fore[:, t] = np.where(mask[:, t, None], _lse(fore[:, t - 1, :, None] + move, 1) + e[:, t], fore[:, t - 1])
        total = _lse(fore[np.arange(n), last], 1)
        back = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], _lse(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        own = np.exp(fore + back - total[:, None, None]) * mask[..., None]
        both = np.exp(
            fore[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * pairs[..., None, None]
        miss = own - one[gold] * mask[..., None]
        steps_of = []
        for k in range(4):
            g = np.zeros_like(params[k])
            np.add.at(g, at[..., k][mask], miss[mask])
            steps_of.append(g)
        steps_of.append(both.sum((0, 1)) - (one[gold[:, :-1]][..., :, None] * one[gold[:, 1:]][..., None, :] * pairs[..., None, None]).sum((0, 1)))
        for p, q, g in zip(params, squares, steps_of):
            g = g / n + l2 * p
            q += g * g
            p -= rate * g / np.sqrt(q)
    return shapes, kinds, params


def viterbi(runs: list[list[tuple[str, str]]], model) -> list[list[int]]:
    shapes, kinds, params = model
    out: list[list[int]] = [[] for _ in runs]
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    while order:
        # runs of similar length together, at most CELLS tokens with padding
        size = len(runs[order[0]])
        take = 1
        while take < len(order) and len(runs[order[take]]) <= 2 * size and (take + 1) * len(runs[order[take]]) <= CELLS:
            take += 1
        part, order = order[:take], order[take:]
        at, mask = padded([runs[i] for i in part], shapes, kinds)
        e, move = emissions(at, params[:4]), params[4]
        score, came = e[:, 0], np.zeros(e.shape, dtype=np.int8)
        for t in range(1, e.shape[1]):
            reach = score[:, :, None] + move
            came[:, t] = reach.argmax(1)
            score = np.where(mask[:, t, None], reach.max(1) + e[:, t], score)
        best = score.argmax(1)
        for row, i in enumerate(part):
            y = [int(best[row])]
            for t in range(len(runs[i]) - 1, 0, -1):
                y.append(int(came[row, t, y[-1]]))
            out[i] = y[::-1]
    return out


def spans_of(run: list[Token], labels: list[int]) -> list[Span]:
    out: list[Span] = []
    before = 0
    for (a, b), y in zip(run, labels):
        if y:
            kind = (y - 1) // 2
            if (y - 1) % 2 and before and (before - 1) // 2 == kind:
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
        before = y
    return out


def find(texts: list[str], model) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and base and added spans, of each text; both by kind, then start."""
    base = [sorted(base_spans(t)) for t in texts]
    if model is None:
        return base, base
    runs = [(d, r) for d, t in enumerate(texts) for r in runs_of(t)]
    features = [[(shape(texts[d][a:b]), coarse(texts[d][a:b])) for a, b in r] for d, r in runs]
    every = [list(b) for b in base]
    by_start = [sorted((s, e) for _, s, e in b) for b in base]
    for (d, run), labels in zip(runs, viterbi(features, model)):
        for kind, a, b in spans_of(run, labels):
            i = bisect_right(by_start[d], (b, -1))  # base spans of several kinds may overlap; few start before b
            if not any(s < b and a < e for s, e in by_start[d][max(0, i - 8) : i]):
                every[d].append((kind, a, b))
    return base, [sorted(e) for e in every]


# Spark


def labelled_runs(docs: DataFrame, text_col: str) -> DataFrame:
    """(tokens, labels): runs with base spans as labels, and phone numbers again without their first token."""
    schema = T.StructType(
        [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, labels = [], []
            for text in b.column(0).to_pylist():
                spans = base_spans(text or "")
                for r in runs_of(text or ""):
                    y = labels_of(r, spans)
                    words = [text[s:e] for s, e in r]
                    tokens.append(words)
                    labels.append(y)
                    phone = 1 + 2 * KINDS.index("phone")
                    if len(y) > 2 and y[0] == phone and y[1] == phone + 1 and y[2] == phone + 1:
                        tokens.append(words[1:])
                        labels.append([phone, *y[2:]])
            yield batch_of(schema, [tokens, labels])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(frugal(run), schema)


def train(labelled: DataFrame, train_runs: int = TRAIN_RUNS):
    """Model from a small labelled table (tokens, labels); it is fitted in one task. None without rows."""
    schema = T.StructType([T.StructField("model", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            rows.sort()
            runs = [[(shape(t), coarse(t)) for t in tokens] for tokens, _ in rows]
            yield batch_of(schema, [[pickle.dumps(fit(runs, [y for _, y in rows]))]])

    small = labelled.orderBy(F.xxhash64("tokens", "labels")).limit(train_runs)
    made = small.repartition(1).mapInArrow(frugal(run), schema).collect()
    return pickle.loads(made[0].model) if made else None


def sampled_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS):
    """The field trained on a sample of about ``train_docs`` documents, chosen by a hash of the id."""
    sample = docs.where(chosen(F.xxhash64(F.col(id_col), F.lit(3)), train_docs, docs.count()))
    return train(labelled_runs(sample, text_col))


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def spans(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few thousand shapes
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", SPANS), T.StructField("spans", SPANS)]
    )

    def named(found: list[list[Span]]) -> list[list[dict]]:
        return [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f] for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = find([x or "" for x in b.column(1).to_pylist()], shared.value)
            yield batch_of(schema, [b.column(0), named(base), named(every)])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(frugal(run), schema)


def masked(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """All columns, with every span of the text replaced by <KIND>; overlapping spans are one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.names.index(text_col)

    def hide(text: str | None, found: list[Span]) -> str | None:
        if not found:
            return text
        out, done = [], 0
        for kind, a, b in sorted(found, key=lambda s: (s[1], s[0])):
            if a >= done:
                out += [text[done:a], f"<{KINDS[kind].upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            _, every = find([x or "" for x in texts], shared.value)
            columns = list(b.columns)
            columns[at] = [hide(t, f) for t, f in zip(texts, every)]
            yield batch_of(schema, columns)

    return docs.mapInArrow(frugal(run), schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of spans()."""
    listed = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        id_col,
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
