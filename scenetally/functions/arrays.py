"""Array helpers built on Spark higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column | str, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas inside the body refer to it."""
    return F.transform(F.array(_c(value)), lambda v: body(v))[0]


def truncate_pad(values: Column | str, n: int, fill) -> Column:
    """First n values, then ``fill`` up to length n."""
    cut = F.slice(_c(values), 1, n)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), n - F.size(cut))))


def pad_mask(values: Column | str, n: int) -> Column:
    """1 for a real entry, 0 for padding."""
    real = F.least(F.size(_c(values)), F.lit(n))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= real, 1).otherwise(0))


def argmax(values: Column | str) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(_c(values), F.array_max(_c(values))) - 1


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-8) -> Column:
    """Cosine with the norm product held above ``floor``."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v * v))


def mean_vector(vectors: Column | str, width: int) -> Column:
    """Element-wise mean of an array of vectors."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(
        _c(vectors), zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double"))
    )
    return F.transform(total, lambda t: F.try_divide(t, F.size(_c(vectors)).cast("double")))


def weighted_mean_vectors(a: Column | str, weight_a: Column, b: Column | str, weight_b: Column) -> Column:
    total = weight_a + weight_b
    return F.zip_with(_c(a), _c(b), lambda x, y: F.try_divide(x * weight_a + y * weight_b, total))


def _ngrams(t: Column, n: int) -> Column:
    last = F.size(t) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, n), " "))


def ngrams(tokens: Column | str, n: int) -> Column:
    """All n-grams in order, as space-joined text."""
    return let(tokens, lambda t: _ngrams(t, n))


def ngrams_up_to(tokens: Column | str, n: int, distinct: bool = False) -> Column:
    """Structs (n, gram) for all orders 1..n; distinct is taken on the texts, where Spark hashes instead of comparing."""

    def tagged(t: Column, k: int) -> Column:
        grams = F.array_distinct(_ngrams(t, k)) if distinct else _ngrams(t, k)
        return F.transform(grams, lambda g: F.struct(F.lit(k).alias("n"), g.alias("gram")))

    return let(tokens, lambda t: F.flatten(F.array(*[tagged(t, k) for k in range(1, n + 1)])))


def exploded_pairs(df: DataFrame, items: str, first: str = "lo", second: str = "hi", with_self: bool = True) -> DataFrame:
    """Rows (first, second) for every two places of an array, the later one second.

    Made in two steps, a member beside the rest of its array, then the rest row by row, so the largest value is one array
    and a record of many items never holds all its pairs at once.
    """
    skip = 1 if with_self else 2
    members = df.select(F.col(items).alias("_all"), F.posexplode(items).alias("_at", first))
    rest = F.slice("_all", F.col("_at") + skip, F.size("_all"))
    return members.select(first, F.explode(rest).alias(second))
