"""Approximate search over inverted lists: rows by nearest centroid; a query reads the nearest lists only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .search import blocks, exact_scores, left_side, matrix, nearest, right_side


def fit_centroids(rows: DataFrame, lists: int, sample: int = 20_000, steps: int = 10, seed: int = 11) -> list[list[float]]:
    """k-means on a bounded sample by hash of the key (numpy, on the driver: sample x dimension doubles)."""
    drawn = rows.select("embedding").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    x = np.array([r[0] for r in drawn], float)
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(steps):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c.tolist()


def centroid_rows(spark, centroids: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(centroids)), "list_id int, centroid array<double>")


def assign(rows: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """rows (key, embedding) with the list_id of their nearest centroid, ties to the smaller id, found within the scan.

    A matrix product leaves the centroids that may be nearest, and these are measured exactly, left to right in doubles.
    """
    c = np.array(centroids, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, cc = right_side("l2", c), (c * c).sum(axis=1)
        for b in blocks(batches):
            x = matrix(b.column(1), c.shape[1])
            far = left_side("l2", x) @ right.T
            slack = 1e-10 * ((x * x).sum(axis=1) + cc.max())
            i, j = np.nonzero(~(far > (far.min(axis=1) + 2 * slack)[:, None]))
            d = exact_scores("l2", x[i], c[j])
            order = np.lexsort((j, d, i))
            first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j[first].astype(np.int32))], names=["key", "embedding", "list_id"])

    ship(rows.sparkSession)
    given = rows.select("key", "embedding")
    kinds = dict(given.dtypes)
    return given.mapInArrow(run, f"key {kinds['key']}, embedding {kinds['embedding']}, list_id int")


def probe(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int, metric: str = "cosine") -> DataFrame:
    """knn over the `probes` lists nearest to each query; lists (list_id, key, embedding) may be partitioned by list_id.

    The lists of a query are found where the queries are, ties to the smaller id; rows are compared as in knn(), whatever list they are of.
    """
    c = sorted((r["list_id"], r["centroid"]) for r in centroids.select("list_id", "centroid").collect())
    ids, at = np.array([i for i, _ in c], np.int64), np.array([x for _, x in c], float)

    def wanted(q: np.ndarray) -> np.ndarray:
        far = np.stack([exact_scores("l2", q, x) for x in at], axis=1)
        return ids[np.argsort(far, axis=1, kind="stable")[:, :probes]]

    return nearest(lists.select("key", "embedding", "list_id"), queries, k, metric, wanted=wanted)
