"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import prepared_score, shown
from ..shipping import ship

#: Bytes of queries that are taken to a task at once; more are searched in slices of that size.
QUERY_BYTES = 32 << 20

#: Rows of a task that are compared together, pairs in a tile of scores, pairs that are scored exactly at once, and found pairs that a task holds.
BLOCK, TILE, PAIRS, ENTRIES = 4096, 1 << 21, 1 << 15, 1 << 21


def top_k(rows: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", include_embedding: bool = False) -> DataFrame:
    """The k nearest rows (key, score) by (score, key): a bounded sort in each task, then one merge; no shuffle."""
    scored = rows.select("key", *["embedding"] * include_embedding, prepared_score(metric, F.col("embedding"), query).alias("score"))
    return scored.orderBy("score", "key").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """hits, at most a few hundred, with their 1-based rank."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("score", "key")))


def knn(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """For each query (query_id, query) the k nearest rows (key, embedding), with rank.

    The queries are taken to every task, QUERY_BYTES at a time; rows are dealt once to all cores. A task compares
    by matrix products in tiles of bounded size, scores exactly what may be among a query's k best so far, left to
    right in doubles, and sends on only the k best of each query.
    """
    return nearest(rows.select("key", "embedding"), queries, k, metric, exclude_self)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool = False, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """knn() over rows (key, embedding); with wanted, over rows (key, embedding, list_id), each query in its lists only.

    wanted gives the lists of queries: an array of list_ids a query, of one length.
    """
    ship(rows.sparkSession)
    kind = dict(queries.dtypes)["query_id"]
    ids, q = asked(queries)
    if not len(ids):
        return rows.select(F.lit(None).cast(kind).alias("query_id"), "key", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    rows, schema = spread(rows), f"query_id {kind}, key string, score double"
    scored = None
    for lo in range(0, len(ids), most := max(1, QUERY_BYTES // max(1, q[:1].nbytes))):
        some = q[lo : lo + most]
        part = rows.mapInArrow(_compare(ids.slice(lo, most), some, k, metric, exclude_self, None if wanted is None else wanted(some)), schema)
        scored = part if scored is None else scored.unionByName(part)
    by_query = Window.partitionBy("query_id").orderBy("score", "key")
    return scored.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def asked(queries: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Queries' ids, and their vectors as a matrix of doubles."""
    found = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
    ids, q = (pa.chunked_array(found.column(i).chunks, found.schema.types[i]).combine_chunks() for i in (0, 1))
    return ids.cast(to_arrow_type(queries.schema["query_id"].dataType)), q.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all cores: a table of one file, or of one large group of rows, is read by one task."""
    return rows.repartition(2 * max(rows.sparkSession.sparkContext.defaultParallelism, 1))


def _compare(ids: pa.Array, q: np.ndarray, k: int, metric: str, exclude_self: bool, lists: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        names = ids.cast(pa.string())
        askers = None if lists is None else {int(v): np.flatnonzero((lists == v).any(axis=1)) for v in np.unique(lists)}
        right, qq = right_side(metric, q), (q * q).sum(axis=1)
        for b in blocks(batches):
            keys, x = b.column(0), matrix(b.column(1), q.shape[1])
            own = np.full(len(x), -1)
            if exclude_self:
                own = pc.fill_null(pc.index_in(keys, names), -1).to_numpy(zero_copy_only=False)
            left, xx = left_side(metric, x), (x * x).sum(axis=1)
            at = [(np.arange(len(x)), np.arange(len(ids)))]
            if askers is not None:
                in_list = b.column(2).to_numpy(zero_copy_only=False)
                at = [(np.flatnonzero(in_list == v), askers[int(v)]) for v in np.unique(in_list) if v in askers]
            for some, who in at:
                these = left[some]
                for lo in range(0, len(who), width := max(1, TILE // len(some))):
                    js = who[lo : lo + width]
                    near = these @ right[js].T
                    mine = np.flatnonzero((own[some] >= js[0]) & (own[some] <= js[-1]))
                    to = np.searchsorted(js, own[some][mine])
                    same = js[to] == own[some][mine]
                    near[mine[same], to[same]] = np.inf
                    slack = margin(metric, xx[some], qq[js])
                    new = np.flatnonzero(np.isinf(best.limit[js]))
                    if len(new) and len(some) >= k:
                        kth = np.partition(near if len(new) == len(js) else near[:, new], k - 1, axis=0)[k - 1]
                        best.limit[js[new]] = np.fmin(kth + slack[new], np.inf)
                    # what is not a number, or left out, is never near
                    i, j = np.divmod(np.flatnonzero(near <= np.fmin(best.limit[js] + slack, np.finfo(float).max)), len(js))
                    i, j = some[i], js[j]
                    for c in range(0, len(i), PAIRS):
                        best.found(j[c : c + PAIRS], exact_scores(metric, x[i[c : c + PAIRS]], q[j[c : c + PAIRS]]), keys.take(pa.array(i[c : c + PAIRS])))
            best.sorted()
            if len(best.query) > ENTRIES:
                yield from best.given(ids)
        best.sorted()
        yield from best.given(ids)

    return run


class Best:
    """The k best rows of each query so far, and for each query a score that its k best don't exceed."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.limit = k, np.full(queries, np.inf)
        self.clear()

    def clear(self) -> None:
        self.query, self.score, self.keys = np.empty(0, np.int64), np.empty(0), None
        self.more: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def found(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        self.more.append((query, score, keys))
        self.held += len(query)
        if self.held > ENTRIES:
            self.sorted()

    def sorted(self) -> None:
        """What was found is ranked with what was held, ties by key, and the k best of each query stay."""
        if not self.more:
            return
        query, score = (np.concatenate([mine, *(x[c] for x in self.more)]) for c, mine in enumerate((self.query, self.score)))
        keys = pa.concat_arrays([*([self.keys] if len(self.query) else []), *(x[2] for x in self.more)])
        order = np.lexsort((score, query))
        twin = (query[order][1:] == query[order][:-1]) & (score[order][1:] == score[order][:-1])
        if twin.any():
            tied, place = order[np.r_[False, twin] | np.r_[twin, False]], np.zeros(len(order), np.int64)
            place[tied] = pc.rank(keys.take(pa.array(tied)), tiebreaker="dense").to_numpy()
            order = np.lexsort((place, score, query))
        starts = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        last, kept = order[rank == self.k - 1], order[rank < self.k]
        self.limit[query[last]] = np.fmin(self.limit[query[last]], score[last])
        self.query, self.score, self.keys, self.more, self.held = query[kept], score[kept], keys.take(pa.array(kept)), [], 0

    def given(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """What is held, as rows; limits stay."""
        for lo in range(0, len(self.query), PAIRS):
            part = slice(lo, lo + PAIRS)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(self.query[part])), self.keys.slice(lo, PAIRS), pa.array(self.score[part])], names=["query_id", "key", "score"])
        self.clear()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to BLOCK rows; the last one may have fewer."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            room = BLOCK - sum(x.num_rows for x in held)
            held.append(b.slice(0, room))
            b = b.slice(room)
            if sum(x.num_rows for x in held) == BLOCK:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as doubles; a null one holds no number."""
    out = np.full((len(vectors), width), np.nan)
    out[vectors.is_valid().to_numpy(zero_copy_only=False)] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def left_side(metric: str, x: np.ndarray) -> np.ndarray:
    """Rows such that left_side(x) @ right_side(q).T is, but for rounding, all rows' scores by all queries."""
    if metric == "l2":
        return np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
    return unit(x) if metric == "cosine" else x


def right_side(metric: str, q: np.ndarray) -> np.ndarray:
    if metric == "l2":
        return np.column_stack([-2 * q, np.ones(len(q)), (q * q).sum(axis=1)])
    return -unit(q) if metric == "cosine" else -q


def margin(metric: str, xx: np.ndarray, qq: np.ndarray) -> np.ndarray:
    """For each query, of squared norm qq, more than the product's scores of rows can be off by."""
    most = xx[np.isfinite(xx)].max(initial=0)
    if metric == "l2":
        return 1e-10 * (most + qq)
    return np.full(len(qq), 1e-10) if metric == "cosine" else 1e-10 * np.sqrt(most * qq)


def exact_scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of pairs, with the same order of additions as the metrics' expressions."""
    total = lambda products: np.add.accumulate(products, axis=1)[:, -1]
    if metric == "l2":
        return total((x - q) * (x - q))
    if metric != "cosine":
        return -total(x * q)
    scale = np.sqrt(total(x * x)) * np.sqrt(total(q * q))
    return np.where(scale > 0, -total(x * q) / np.where(scale > 0, scale, 1), 0.0)


def knn_sliced(rows: DataFrame, queries: DataFrame, k: int, dimension: int, metric: str = "cosine") -> DataFrame:
    """knn(), which takes any number of queries, for vectors of one dimension."""
    return knn(rows, queries, k, metric)


def sharded_top_k(rows: DataFrame, shard: Column, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """Top k of each shard, then of all: the same rows as top_k()."""
    scored = rows.select("key", shard.alias("shard_id"), prepared_score(metric, F.col("embedding"), query).alias("score"))
    by_shard = Window.partitionBy("shard_id").orderBy("score", "key")
    partial = scored.withColumn("r", F.row_number().over(by_shard)).where(F.col("r") <= k).drop("r")
    return partial.drop("shard_id").orderBy("score", "key").limit(k)


def recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of each query's k exact neighbours that the approximate result has."""
    both = exact.join(approximate.select("query_id", "key").withColumn("hit", F.lit(1)), ["query_id", "key"], "left")
    return both.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(float(k))).alias("recall"))


def displayed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", shown(F.col("score")))
