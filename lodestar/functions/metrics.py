"""Vector metrics as Catalyst expressions; sums are in double precision, from left to right."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal vector, which Catalyst folds."""
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<double>")


def _total(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def square_norm(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(square_norm(a))


def l2_score(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; smaller is nearer."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot_score(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_score(a: Column, b: Column) -> Column:
    """Negated cosine; -1 is best; 0 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(-dot(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clamped to [0, 2]; 1 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale)))


def normalized(a: Column) -> Column:
    """Unit vector in 32-bit floats; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<float>")).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


SCORES: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_score, "l2": l2_score, "dot_product": dot_score}


def prepared_score(metric: str, column: Column, query: Sequence[float]) -> Column:
    """Score of a column against one query whose own norm is computed here, once."""
    q = [float(x) for x in query]
    if metric != "cosine":
        return SCORES[metric](column, vector(q))
    own = math.sqrt(sum(x * x for x in q))
    if own == 0:
        return F.lit(0.0)
    n = norm(column)
    return F.when(n == 0, F.lit(0.0)).otherwise(-dot(column, vector(q)) / (n * F.lit(own)))


def shown(score: Column, digits: int = 6) -> Column:
    """Rounded for display; a negative zero becomes zero."""
    return F.round(score, digits) + F.lit(0.0)


def fnv1a(key: Column) -> Column:
    """FNV-1a, 32 bits, of the key's UTF-8 bytes, as a long."""
    h, n = F.hex(F.encode(key, "UTF-8")), F.octet_length(key)
    byte = lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    data = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n), byte))
    # The offset basis and prime of the hash.
    return F.aggregate(data, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def shard_of(key: Column, shards: int) -> Column:
    return (fnv1a(key) % shards).cast("int")


def number_text(x: float) -> str:
    """Up to eight significant digits."""
    return format(x, ".8g")


def vector_text(values: Sequence[float]) -> str:
    return "[" + ", ".join(map(number_text, values)) + "]"
