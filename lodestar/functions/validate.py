"""Checks of keys and vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..schema import Guardrails


def has_key(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def has_dimension(embedding: Column, dimension: int) -> Column:
    return embedding.isNotNull() & (F.size(embedding) == dimension)


def is_finite(embedding: Column) -> Column:
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def violation(key: Column, embedding: Column, dimension: int, key_only: Column | None = None) -> Column:
    """What is wrong first: key, dimension, then finiteness; null if nothing is. Where key_only holds, only the key is judged."""
    judged = F.when(~has_key(key), F.lit("key is required"))
    if key_only is not None:
        judged = judged.when(key_only, F.lit(None))
    return judged.when(~F.coalesce(has_dimension(embedding, dimension), F.lit(False)), F.lit(f"embedding must have {dimension} components")).when(~is_finite(embedding), F.lit("embedding must be finite"))


def check_vector(values: Sequence[float], dimension: int) -> list[float]:
    if len(values) != dimension:
        raise InvalidArgument(f"embedding must have {dimension} components, not {len(values)}")
    for i, x in enumerate(values):
        if x is None or not math.isfinite(x):
            raise InvalidArgument(f"embedding[{i}] must be finite")
    return [float(x) for x in values]


def check_search(values: Sequence[float], top_k: int, ef_search: int, dimension: int, limits: Guardrails) -> list[float]:
    if top_k <= 0:
        raise InvalidArgument("top_k must be positive")
    if top_k > limits.max_top_k:
        raise InvalidArgument(f"top_k is over {limits.max_top_k}")
    if ef_search > limits.max_ef_search:
        raise InvalidArgument(f"ef_search is over {limits.max_ef_search}")
    return check_vector(values, dimension)
