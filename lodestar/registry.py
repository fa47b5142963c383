"""Queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import validate as V
from .operators import changes as ch
from .operators import hnsw, ivf, search
from .plans.statements import parse
from .sources.jsonl import parsed
from .sources.storage import shared_root

Query = Callable[[SparkSession, str], DataFrame]
K, ONE, PROBED = 10, 7, 4
METRICS = ("cosine", "l2", "dot_product")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "vec_id", "embedding", "label")


def one_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, found through a pushed-down filter."""
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == ONE).select("embedding").first()[0])


def some_queries(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes: key is the user, an error is a deletion, the vector is made of the value."""
    e = read(spark, sf_dir, "events")
    value = F.col("value")
    vec = F.array(value, value * 0.5 + 1, F.lit(1.0)).cast("array<float>")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("key"), vec.alias("embedding"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("embedding"))


# -- search ----------------------------------------------------------------------------------


def topk(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.displayed(search.top_k(vectors(spark, sf_dir), one_vector(spark, sf_dir), K, metric))

    return query


def topk_include_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.ranked(search.top_k(vectors(spark, sf_dir), one_vector(spark, sf_dir), K, "l2", include_embedding=True))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return hits.select("rank", "key", M.shown(F.col("score")).alias("score"), F.size("embedding").alias("dimension"), M.shown(total).alias("total"))


def knn_batch(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return search.displayed(search.knn(v, some_queries(v), K, metric)).select("query_id", "rank", "key", "score")

    return query


def knn_self_join_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.displayed(search.knn(v, some_queries(v), 5, "cosine", exclude_self=True)).select("query_id", "rank", "key", "score")


def lineitem_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    key = [c for c in li.columns if c.startswith("l_")]
    scored = li.select(*key, M.prepared_score("l2", F.col("embedding"), [25.0, 40000.0, 0.05, 0.04]).alias("score"))
    return scored.orderBy("score", *key).limit(20).withColumn("score", M.shown(F.col("score")))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.displayed(search.sharded_top_k(vectors(spark, sf_dir), M.shard_of(F.col("key"), 8), one_vector(spark, sf_dir), K))


def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy(M.shard_of(F.col("key"), 8).alias("shard_id")).agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))


def statement_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = one_vector(spark, sf_dir)
    s = parse(f"SEARCH TOPK {K} EMBEDDING [{', '.join(f'{x:.17f}' for x in q)}];")
    return search.displayed(search.top_k(vectors(spark, sf_dir), s.args["embedding"], s.args["top_k"], "cosine"))


# -- scalar functions ------------------------------------------------------------------------


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = items(spark, sf_dir)
    unit = M.normalized(F.col("embedding").cast("array<float>"))
    shown = [(F.round(unit[i].cast("double"), 4) + F.lit(0.0)).alias(f"x{i}") for i in (0, 1)]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *shown)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("key", M.shown(M.norm(F.col("embedding"))).alias("norm"), M.shown(M.square_norm(F.col("embedding"))).alias("square"))


def cosine_distance_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.transform("embedding", lambda x: x * 0)
    q = M.vector(one_vector(spark, sf_dir))
    e = F.when(F.col("label") == 0, zero).otherwise(F.col("embedding"))
    return vectors(spark, sf_dir).select("key", M.shown(M.cosine_distance(e, q)).alias("distance"))


def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows spoilt in stated ways, counted by what is wrong first."""
    v = vectors(spark, sf_dir)
    e = F.col("embedding")
    spoilt = F.when(F.col("vec_id") % 11 == 0, F.slice(e, 1, 63)).when(F.col("vec_id") % 13 == 0, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 17 == 0, F.transform(e, lambda x: F.lit(float("inf")).cast("float"))).otherwise(e)
    key = F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.col("key"))
    what = F.coalesce(V.violation(key, spoilt, 64), F.lit("ok"))
    return v.select(what.alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


# -- lookups and changes ---------------------------------------------------------------------


def get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.point(ch.live(changelog(spark, sf_dir)), "42").select("key", "seq", M.shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 400, 5).select(F.col("id").cast("string").alias("key"))
    return ch.among(ch.live(changelog(spark, sf_dir)), wanted).select("key", "seq")


def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changelog(spark, sf_dir)
    return ch.resolve_ids(c, c.where("seq % 3 = 0").select("seq"))


def is_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 400, 5).select(F.col("id").cast("string").alias("key"))
    return ch.missing(ch.live(changelog(spark, sf_dir)), wanted)


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.live(changelog(spark, sf_dir)).select("key", "seq", M.shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.live(changelog(spark, sf_dir)).agg(F.count("*").alias("n"))


def tombstoned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.tombstoned(changelog(spark, sf_dir)).select("key", "seq")


def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.upsert_report(changelog(spark, sf_dir))


def delete_then_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live key deleted, and each third one inserted again, after the log's end."""
    c = changelog(spark, sf_dir)
    last = ch.live(c)
    gone = last.select((F.col("seq") + 10_000_000).alias("seq"), F.lit("delete").alias("op"), "key", "embedding")
    again = last.where(F.col("key").cast("long") % 3 == 0).select((F.col("seq") + 20_000_000).alias("seq"), F.lit("upsert").alias("op"), "key", "embedding")
    return ch.live(c.unionByName(gone).unionByName(again)).select("key", "seq")


def search_after_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.displayed(search.top_k(ch.live(changelog(spark, sf_dir)), [50.0, 26.0, 1.0], K, "l2")).withColumn("score", F.round("score", 3) + F.lit(0.0))


def seal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.sealed(changelog(spark, sf_dir), 1000).groupBy("segment_id").agg(F.count("*").alias("keys"), F.count_if(F.col("op") == "delete").alias("deleted"), F.max("seq").alias("last_seq"))


def merge_segments_equals_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments sealed, the four oldest merged, the rest folded: the current rows."""
    return ch.live(ch.merged(ch.sealed(changelog(spark, sf_dir), 1000), 4).drop("segment_id")).select("key", "seq")


# -- approximate search ----------------------------------------------------------------------


def fixed_centroids(v: DataFrame) -> list[list[float]]:
    """The first sixteen vectors."""
    return [list(r["embedding"]) for r in v.where("vec_id < 16").orderBy("vec_id").select("embedding").collect()]


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.assign(v, fixed_centroids(v)).select("key", "list_id")


def probed(spark: SparkSession, sf_dir: str, probes: int, centroids: list[list[float]] | None = None) -> DataFrame:
    v = vectors(spark, sf_dir)
    c = centroids or fixed_centroids(v)
    return ivf.probe(ivf.assign(v, c), some_queries(v), ivf.centroid_rows(spark, c), K, probes)


def ivf_full_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.displayed(probed(spark, sf_dir, 16)).select("query_id", "rank", "key", "score")


def ivf_partial_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.displayed(probed(spark, sf_dir, PROBED)).select("query_id", "rank", "key", "score")


def ivf_trained_full_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists around centroids fitted on a bounded sample, stored by list and read again; all of them are probed."""
    v = vectors(spark, sf_dir)
    centroids = ivf.fit_centroids(v, 12)
    path = f"{shared_root(spark)}/lists-{uuid.uuid4().hex}"
    ivf.assign(v, centroids).write.partitionBy("list_id").parquet(path)
    lists = spark.read.parquet(path)
    return search.displayed(ivf.probe(lists, some_queries(v), ivf.centroid_rows(spark, centroids), K, len(centroids))).select("query_id", "rank", "key", "score")


def ann_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = search.recall(probed(spark, sf_dir, PROBED), search.knn(v, some_queries(v), K), K)
    return found.select("query_id", M.shown(F.col("recall")).alias("recall"))


def hnsw_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of segments of 1000 rows propose, the exact score ranks."""
    v, q = vectors(spark, sf_dir), one_vector(spark, sf_dir)
    rows = v.select(F.floor(F.col("vec_id") / 1000).cast("long").alias("segment_id"), F.col("vec_id").alias("seq"), "key", "embedding")
    graphs = hnsw.build_graphs(rows, "cosine", hnsw.GraphSettings(16, 100), least=1)
    return search.displayed(search.top_k(hnsw.search_graphs(graphs, q, K, "cosine", ef=128), q, K, "cosine"))


# -- ingest ----------------------------------------------------------------------------------


def jsonl_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes written as JSON lines (as a column) and read again by the line parser, then folded by order."""
    c = changelog(spark, sf_dir).where("op = 'upsert'")
    lines = c.select(F.col("seq").alias("ordinal"), F.to_json(F.struct("key", "embedding")).alias("value"))
    rows = parsed(lines).where("problem is null")
    last = ch.latest_per_key(rows.select(F.col("ordinal").alias("seq"), "key", "embedding"))
    return last.select("key", "seq", M.shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def stream_ingest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, appended batch by batch, then folded."""
    from .streaming.ingest import current, ingest

    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    vec = F.array(F.col("value")).cast("array<float>")
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("key"), vec.alias("embedding"))
    ingest(changes, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return current(spark, f"{root}/changes").select("key", "seq", M.shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def queries() -> dict[str, Query]:
    named = (
        topk_include_embedding, knn_self_join_exclude_self, lineitem_vector_topk, shard_histogram, statement_search, normalize_vectors, vector_norms, cosine_distance_clamped, validate_vectors,
        get_by_key, multi_get, resolve_ids, is_deleted, latest_per_key, live_count, tombstoned_keys, upsert_report, delete_then_reinsert, search_after_upserts, seal_segments, merge_segments_equals_live,
        ivf_assign, ivf_full_probe_topk, ivf_partial_probe_topk, ivf_trained_full_probe_topk, ann_recall_at_k, hnsw_candidates_topk, jsonl_ingest_roundtrip, stream_ingest_latest,
    )
    short = {"cosine": "cosine", "l2": "l2", "dot_product": "dot"}
    out: dict[str, Query] = {f"topk_{short[m]}": topk(m) for m in METRICS} | {f"knn_batch_{short[m]}": knn_batch(m) for m in METRICS}
    return out | {"shard_partial_topk_merge": sharded} | {f.__name__: f for f in named}


# -- SQL -------------------------------------------------------------------------------------

INNER = {
    "cosine": "-list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))",
    "l2": "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "dot_product": "-list_inner_product({a}, {b})",
}
E_SQL = "SELECT CAST(vec_id AS VARCHAR) AS key, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"
C_SQL = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, CAST(user_id AS VARCHAR) AS key, CAST(value AS FLOAT) AS x0, CAST(value * 0.5 + 1 AS FLOAT) AS x1 FROM events"
LAST = f"c AS ({C_SQL}), l AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(x0, seq) AS x0, arg_max(x1, seq) AS x1 FROM c GROUP BY key), live AS (SELECT * FROM l WHERE op = 'upsert')"
FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, octet_length(encode({k})) + 1), lambda i: ('0x' || substr(hex(encode({k})), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


def score_sql(metric: str, a: str, b: str) -> str:
    return INNER[metric].format(a=a, b=b)


def topk_sql(metric: str) -> str:
    return f"WITH v AS ({E_SQL}), q AS (SELECT e AS qe FROM v WHERE vec_id = {ONE}), s AS (SELECT key, {score_sql(metric, 'e', 'qe')} AS raw FROM v, q) SELECT key, round(raw, 6) + 0 AS score FROM s ORDER BY raw, key LIMIT {K}"


def knn_sql(metric: str, k: int = K, more: str = "") -> str:
    return (
        f"WITH v AS ({E_SQL}), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0), s AS (SELECT query_id, key, {score_sql(metric, 'e', 'qe')} AS raw FROM v, q WHERE true {more}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, key) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, key, round(raw, 6) + 0 AS score FROM r WHERE rank <= {k}"
    )


def oracle_sql() -> dict[str, str]:
    wanted = "SELECT CAST(i AS VARCHAR) AS key FROM range(0, 400, 5) t(i)"
    assigned = f"WITH v AS ({E_SQL}), c AS (SELECT CAST(vec_id AS INTEGER) AS list_id, e AS ce FROM v WHERE vec_id < 16) SELECT key, arg_min(list_id, {{'d': {score_sql('l2', 'e', 'ce')}, 'i': list_id}}) AS list_id FROM v, c GROUP BY key"
    probed = (
        f"WITH v AS ({E_SQL}), c AS (SELECT CAST(vec_id AS INTEGER) AS list_id, e AS ce FROM v WHERE vec_id < 16), a AS (SELECT key, e, arg_min(list_id, {{'d': {score_sql('l2', 'e', 'ce')}, 'i': list_id}}) AS list_id FROM v, c GROUP BY key, e), "
        f"q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0), w AS (SELECT query_id, qe, list_id, row_number() OVER (PARTITION BY query_id ORDER BY {score_sql('l2', 'qe', 'ce')}, list_id) AS r FROM q, c), "
        f"s AS (SELECT query_id, key, {score_sql('cosine', 'e', 'qe')} AS raw FROM w JOIN a ON w.list_id = a.list_id WHERE r <= {PROBED}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, key) AS rank FROM s) WHERE rank <= {K})"
    )
    top = topk_sql("cosine")
    return {
        "topk_cosine": top,
        "topk_l2": topk_sql("l2"),
        "topk_dot": topk_sql("dot_product"),
        "statement_search": top,
        "shard_partial_topk_merge": top,
        "hnsw_candidates_topk": top,
        "topk_include_embedding": f"WITH v AS ({E_SQL}), q AS (SELECT e AS qe FROM v WHERE vec_id = {ONE}), s AS (SELECT key, e, {score_sql('l2', 'e', 'qe')} AS raw FROM v, q), r AS (SELECT *, row_number() OVER (ORDER BY raw, key) AS rank FROM s) SELECT CAST(rank AS INTEGER) AS rank, key, round(raw, 6) + 0 AS score, CAST(len(e) AS INTEGER) AS dimension, round(list_sum(e), 6) + 0 AS total FROM r WHERE rank <= {K}",
        "knn_batch_cosine": knn_sql("cosine"),
        "knn_batch_l2": knn_sql("l2"),
        "knn_batch_dot": knn_sql("dot_product"),
        "ivf_full_probe_topk": knn_sql("cosine"),
        "ivf_trained_full_probe_topk": knn_sql("cosine"),
        "ivf_partial_probe_topk": f"{probed} SELECT query_id, CAST(rank AS INTEGER) AS rank, key, round(raw, 6) + 0 AS score FROM f",
        "ann_recall_at_k": f"{probed}, t AS ({knn_sql('cosine')}) SELECT t.query_id, round(count(f.key) / {K}.0, 6) + 0 AS recall FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.key = f.key GROUP BY t.query_id",
        "knn_self_join_exclude_self": knn_sql("cosine", 5, "AND key <> CAST(query_id AS VARCHAR)"),
        "lineitem_vector_topk": f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {score_sql('l2', '[l_quantity, l_extendedprice, l_discount, l_tax]', '[25.0::DOUBLE, 40000.0, 0.05, 0.04]')} AS raw FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(raw, 6) + 0 AS score FROM s ORDER BY raw, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20",
        "shard_histogram": f"SELECT CAST({FNV.format(k='CAST(vec_id AS VARCHAR)')} % 8 AS INTEGER) AS shard_id, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY 1",
        "normalize_vectors": "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_extendedprice, l_discount, l_tax]::FLOAT[]::DOUBLE[] AS e FROM lineitem), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM f) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((e[1] / n)::FLOAT::DOUBLE, 4) + 0 AS x0, round((e[2] / n)::FLOAT::DOUBLE, 4) + 0 AS x1 FROM n",
        "vector_norms": f"WITH v AS ({E_SQL}) SELECT key, round(sqrt(list_inner_product(e, e)), 6) + 0 AS norm, round(list_inner_product(e, e), 6) + 0 AS square FROM v",
        "cosine_distance_clamped": f"WITH v AS ({E_SQL}), q AS (SELECT e AS qe FROM v WHERE vec_id = {ONE}) SELECT key, CASE WHEN label = 0 THEN 1.0 ELSE round(1.0 - greatest(-1.0, least(1.0, -({score_sql('cosine', 'e', 'qe')}))), 6) + 0 END AS distance FROM v, q",
        "validate_vectors": "SELECT CASE WHEN vec_id % 7 = 0 THEN 'key is required' WHEN vec_id % 11 = 0 THEN 'embedding must have 64 components' WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 'embedding must be finite' ELSE 'ok' END AS problem, count(*) AS n FROM embeddings GROUP BY 1",
        "get_by_key": f"WITH {LAST} SELECT key, seq, round(x0::DOUBLE, 3) + 0 AS x0 FROM live WHERE key = '42'",
        "multi_get": f"WITH {LAST} SELECT key, seq FROM live WHERE key IN ({wanted})",
        "resolve_ids": f"WITH {LAST} SELECT seq AS id, key FROM live WHERE seq % 3 = 0",
        "is_deleted": f"WITH {LAST}, w AS ({wanted}) SELECT key FROM w WHERE key NOT IN (SELECT key FROM live)",
        "latest_per_key": f"WITH {LAST} SELECT key, seq, round(x0::DOUBLE, 3) + 0 AS x0 FROM live",
        "live_count": f"WITH {LAST} SELECT count(*) AS n FROM live",
        "tombstoned_keys": f"WITH {LAST} SELECT key, seq FROM l WHERE op = 'delete'",
        "upsert_report": f"WITH c AS ({C_SQL}), s AS (SELECT key, op, seq, lag(op) OVER w AS old_op, lag(seq) OVER w AS old FROM c WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq AS id, coalesce(old_op = 'upsert', false) AS had_old, CASE WHEN old_op = 'upsert' THEN old END AS old_id FROM s WHERE op = 'upsert'",
        "delete_then_reinsert": f"WITH {LAST} SELECT key, seq + 20000000 AS seq FROM live WHERE CAST(key AS BIGINT) % 3 = 0",
        "search_after_upserts": f"WITH {LAST}, s AS (SELECT key, {score_sql('l2', '[x0::DOUBLE, x1::DOUBLE, 1.0]', '[50.0::DOUBLE, 26.0, 1.0]')} AS raw FROM live) SELECT key, round(round(raw, 6), 3) + 0 AS score FROM s ORDER BY raw, key LIMIT {K}",
        "seal_segments": f"WITH c AS ({C_SQL}), s AS (SELECT CAST(floor(seq / 1000) AS BIGINT) AS segment_id, key, max(seq) AS seq, arg_max(op, seq) AS op FROM c GROUP BY 1, 2) SELECT segment_id, count(*) AS keys, count(*) FILTER (op = 'delete') AS deleted, max(seq) AS last_seq FROM s GROUP BY 1",
        "merge_segments_equals_live": f"WITH {LAST} SELECT key, seq FROM live",
        "ivf_assign": assigned,
        "jsonl_ingest_roundtrip": f"WITH c AS ({C_SQL}) SELECT key, max(seq) AS seq, round(arg_max(x0, seq)::DOUBLE, 3) + 0 AS x0 FROM c WHERE op = 'upsert' GROUP BY key",
        "stream_ingest_latest": f"WITH {LAST} SELECT key, seq, round(x0::DOUBLE, 3) + 0 AS x0 FROM live",
    }

