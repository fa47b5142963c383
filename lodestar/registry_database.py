"""Queries that go through collections as a user would: load, change, search, maintain; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metrics import shown
from .plans.database import Database
from .plans.statements import Session
from .registry import C_SQL, E_SQL, K, LAST, ONE, changelog, one_vector, read, score_sql, some_queries, vectors
from .schema import Config, Storage
from .sources.storage import shared_root
from .streaming.ingest import ingest_into

Query = Callable[[SparkSession, str], DataFrame]


def database(spark: SparkSession, **storage: int) -> Database:
    """An empty database in the shared folder."""
    return Database(spark, f"{shared_root(spark)}/collections-{uuid.uuid4().hex}", Config(storage=Storage(**storage)))


def filled(spark: SparkSession, sf_dir: str, metric: str = "l2", **storage: int) -> Database:
    """Collection `v` of embeddings: the even ids, then all of them, then without the one that is asked for."""
    db, v = database(spark, **storage), vectors(spark, sf_dir)
    db.create_collection("v", 64, metric)
    db.load("v", v.where("vec_id % 2 = 0").select("key", (F.col("embedding")).alias("embedding"), "vec_id"), F.col("vec_id"))
    db.load("v", v, F.col("vec_id"))
    db.delete("v", str(ONE))
    return db


def evented(spark: SparkSession, sf_dir: str, **storage: int) -> Database:
    """Collection `e` of all events as changes, in one commit: ids are places by event_id."""
    db = database(spark, **storage)
    db.create_collection("e", 3, "l2")
    c = changelog(spark, sf_dir)
    db.apply("e", c, F.col("seq"))
    return db


# -- changes ---------------------------------------------------------------------------------


def database_load_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, v = database(spark), vectors(spark, sf_dir)
    db.create_collection("v", 64, "cosine")
    n = db.load("v", v)
    ids = db.changes("v").agg(F.countDistinct("seq").alias("ids"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    return ids.withColumn("loaded", F.lit(n).cast("long")).withColumn("current", F.lit(db.count("v")).cast("long"))


def json_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines: the upserts among the events, in order."""
    path = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    c = changelog(spark, sf_dir).where("op = 'upsert'")
    c.orderBy("seq").select(F.to_json(F.struct("key", "embedding")).alias("value")).write.text(path)
    return path


def database_load_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.create_collection("e", 3, "l2")
    db.load_file("e", json_lines(spark, sf_dir))
    return db.live("e").select("key", "seq", shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def database_overwrite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that arrive in another order than they count in."""
    db = database(spark)
    db.create_collection("e", 3, "l2")
    db.apply("e", changelog(spark, sf_dir).repartition(7, "key"), F.col("seq"))
    return db.live("e").select("key", "seq", shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def database_upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evented(spark, sf_dir).upsert_report("e")


def database_delete_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three smallest live keys deleted one by one, the first of them inserted again."""
    db = evented(spark, sf_dir)
    least = [r["key"] for r in db.live("e").orderBy(F.col("key").cast("long")).limit(3).collect()]
    for key in least:
        db.delete("e", key)
    for key in least[:1]:
        db.insert("e", key, [1.0, 2.0, 3.0])
    return db.live("e").select("key", "seq", shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def database_batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a hundred items as a client sends them; nations' keys, then again with other values."""
    db = database(spark)
    db.create_collection("n", 2, "dot_product")
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey", "n_regionkey").collect()
    db.batch_insert("n", [(r[0], [r[1], r[2]]) for r in rows])
    db.batch_insert("n", [(r[0], [r[2], r[1]]) for r in rows if r[1] % 2])
    return db.live("n").select("key", "seq", F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"))


def database_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files into a collection; running the stream again changes nothing."""
    db = database(spark)
    db.create_collection("e", 3, "l2")
    schema = read(spark, sf_dir, "events").schema
    for _ in range(2):
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
        ingest_into(db, "e", changelog_of(events), f"{db.files.root}/checkpoint", "events").awaitTermination()
    return db.live("e").select("key", "seq")


def changelog_of(events: DataFrame) -> DataFrame:
    value = F.col("value")
    vec = F.array(value, value * 0.5 + 1, F.lit(1.0)).cast("array<float>")
    return events.select(F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("key"), vec.alias("embedding"))


# -- lookups ---------------------------------------------------------------------------------


def database_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key's current row, read from its shard, after the segments were merged."""
    db = evented(spark, sf_dir)
    db.compact("e")
    return db.point(db.manifest("e"), "42").select("key", "seq", shown(F.col("embedding")[0].cast("double"), 3).alias("x0"))


def database_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evented(spark, sf_dir).multi_get("e", [str(i) for i in range(0, 400, 5)]).select("key", "seq")


def database_resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = evented(spark, sf_dir)
    return db.resolve_ids("e", range(0, db.manifest("e")["next_seq"], 3))


def database_all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evented(spark, sf_dir).all_ids("e")


# -- search ----------------------------------------------------------------------------------


def hits(db: Database, spark: SparkSession, sf_dir: str, ef_search: int = 0) -> DataFrame:
    found = db.search("v", one_vector(spark, sf_dir), K, ef_search)
    return found.select("rank", "key", shown(F.col("score").cast("double"), 3).alias("score"))


def database_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(filled(spark, sf_dir), spark, sf_dir)


def database_search_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = filled(spark, sf_dir, merge_over=2, merge_width=2, seal_ops=100)
    db.optimize("v")
    return hits(db, spark, sf_dir)


def database_search_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = filled(spark, sf_dir)
    db.compact("v")
    db.vacuum("v")
    return hits(db, spark, sf_dir)


def database_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs, and a row written and one deleted after they were built."""
    db = filled(spark, sf_dir, index_min_rows=100, seal_ops=1000)
    db.insert("v", str(ONE), one_vector(spark, sf_dir))
    db.create_index("v", 16, 100)
    db.build_index("v")
    db.delete("v", str(ONE))
    db.insert("v", "0", one_vector(spark, sf_dir))
    db.insert("v", "0", list(read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]))
    return hits(db, spark, sf_dir, 256)


def database_search_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = filled(spark, sf_dir, index_min_rows=100)
    db.create_index("v")
    db.build_index("v")
    db.drop_index("v")
    return hits(db, spark, sf_dir)


def database_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = filled(spark, sf_dir)
    queries = some_queries(vectors(spark, sf_dir)).select("query_id", "query")
    return db.batch_search("v", queries, 5).select("query_id", "rank", "key", shown(F.col("score"), 3).alias("score"))


def database_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of statements: create, use, load lines, delete, search."""
    s = Session(database(spark))
    for text in ("CREATE COLLECTION Events DIM 3 METRIC l2;", "USE events;", f"BATCH INSERT FILE '{json_lines(spark, sf_dir)}';"):
        s.run(text)
    least = s.db.live("Events").orderBy(F.col("key").cast("long")).first()["key"]
    s.run(f"DELETE KEY '{least}';")
    s.run(f"INSERT KEY 'new {least}' EMBEDDING [50, 26, 1];")
    return s.db.search("Events", [50.0, 26.0, 1.0], K).select("rank", "key", shown(F.col("score").cast("double"), 2).alias("score"))


# -- catalog and lifecycle -------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> Database:
    db = evented(spark, sf_dir)
    db.create_collection("V", 64)
    db.load("V", vectors(spark, sf_dir))
    db.create_index("V", 24, 90)
    db.create_collection("gone", 5, "dot_product")
    db.delete_collection("gone")
    return db


def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).list_collections()


def describe_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).describe("v")


def database_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection's manifest keeps, read by another session of the database."""
    db = catalog(spark, sf_dir)
    m = Database(spark, db.files.root).manifest("V")
    return spark.createDataFrame([(m["name"], m["dimension"], m["metric"], m["shard_count"], m["index"]["m"], m["index"]["ef_construction"], m["next_seq"])], "name string, dimension int, metric string, shard_count int, index_m int, index_ef int, next_id long")


def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a start finds: segments, changes, the largest segment, whether a tail is open."""
    return filled(spark, sf_dir).report()


def database_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by shard folder, as written."""
    return evented(spark, sf_dir).changes("e").groupBy("shard_id").agg(F.count("*").alias("n"))


def database_optimized_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven loads of events, sealed and merged in between: the current rows stay the same."""
    db, c = database(spark, merge_over=3, merge_width=2, seal_ops=50), changelog(spark, sf_dir)
    db.create_collection("e", 3, "l2")
    top = c.agg(F.max("seq")).first()[0] or 0
    for i in range(5):
        db.apply("e", c.where((F.col("seq") > top * i / 5 - (i == 0)) & (F.col("seq") <= top * (i + 1) / 5)), F.col("seq"))
        db.optimize("e")
    return db.live("e").select("key", "seq")


def queries() -> dict[str, Query]:
    named = (
        database_load_count, database_load_file, database_overwrite_order, database_upsert_report, database_delete_reinsert, database_batch_insert, database_stream_ingest, database_point, database_multi_get,
        database_resolve_ids, database_all_ids, database_search, database_search_optimized, database_search_compacted, database_search_indexed, database_search_unindexed, database_batch_search, database_statements,
        list_collections, describe_collection, database_settings, recovery_report, database_shards, database_optimized_live,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .registry import FNV

    numbered = f"c AS (SELECT op, key, x0, x1, row_number() OVER (ORDER BY seq) - 1 AS seq FROM ({C_SQL}))"
    last = f"{numbered}, l AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(x0, seq) AS x0, arg_max(x1, seq) AS x1 FROM c GROUP BY key), live AS (SELECT * FROM l WHERE op = 'upsert')"
    upserts = f"c AS (SELECT key, x0, x1, row_number() OVER (ORDER BY seq) - 1 AS seq FROM ({C_SQL}) WHERE op = 'upsert'), live AS (SELECT key, max(seq) AS seq, arg_max(x0, seq) AS x0, arg_max(x1, seq) AS x1 FROM c GROUP BY key)"
    current = "SELECT key, seq, round(x0::DOUBLE, 3) + 0 AS x0 FROM live"
    l2 = score_sql("l2", "e", "qe")
    top = (
        f"WITH v AS ({E_SQL}), q AS (SELECT e AS qe FROM v WHERE vec_id = {ONE}), s AS (SELECT key, {l2} AS raw FROM v, q WHERE vec_id <> {ONE}), r AS (SELECT *, row_number() OVER (ORDER BY raw, key) AS rank FROM s) "
        f"SELECT CAST(rank AS INTEGER) AS rank, key, round(raw::FLOAT::DOUBLE, 3) + 0 AS score FROM r WHERE rank <= {K}"
    )
    coll = f"WITH {LAST} SELECT 'V' AS name, 64 AS dimension, 'cosine' AS metric, (SELECT count(*) FROM embeddings) AS count, true AS has_index UNION ALL SELECT 'e', 3, 'l2', (SELECT count(*) FROM live), false"
    sizes = f"SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS a, (SELECT count(*) FROM embeddings) AS b"
    return {
        "database_load_count": "SELECT count(*) AS loaded, count(*) AS current, count(*) AS ids, 0::BIGINT AS first, count(*) - 1 AS last FROM embeddings",
        "database_load_file": f"WITH {upserts} {current}",
        "database_overwrite_order": f"WITH {last} {current}",
        "database_upsert_report": f"WITH {numbered}, s AS (SELECT key, op, seq, lag(op) OVER w AS old_op, lag(seq) OVER w AS old FROM c WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq AS id, coalesce(old_op = 'upsert', false) AS had_old, CASE WHEN old_op = 'upsert' THEN old END AS old_id FROM s WHERE op = 'upsert'",
        "database_delete_reinsert": f"WITH {last}, k AS (SELECT key, row_number() OVER (ORDER BY CAST(key AS BIGINT)) AS r FROM live) SELECT key, seq, round(x0::DOUBLE, 3) + 0 AS x0 FROM live WHERE key NOT IN (SELECT key FROM k WHERE r <= 3) UNION ALL SELECT key, (SELECT count(*) FROM c) + (SELECT count(*) FROM k WHERE r <= 3) AS seq, 1.0 AS x0 FROM k WHERE r = 1",
        "database_batch_insert": "WITH n AS (SELECT n_name AS key, n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS seq FROM nation), o AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 + (SELECT count(*) FROM n) AS later FROM n WHERE n_nationkey % 2 = 1) SELECT key, seq, n_nationkey::DOUBLE AS x0, n_regionkey::DOUBLE AS x1 FROM n WHERE n_nationkey % 2 = 0 UNION ALL SELECT key, later, n_regionkey::DOUBLE, n_nationkey::DOUBLE FROM o",
        "database_stream_ingest": f"WITH {last} SELECT key, seq FROM live",
        "database_point": f"WITH {last} {current} WHERE key = '42'",
        "database_multi_get": f"WITH {last} SELECT key, seq FROM live WHERE key IN (SELECT CAST(i AS VARCHAR) FROM range(0, 400, 5) t(i))",
        "database_resolve_ids": f"WITH {last} SELECT seq AS id, key FROM live WHERE seq % 3 = 0",
        "database_all_ids": f"WITH {last} SELECT seq AS id FROM live",
        "database_search": top,
        "database_search_optimized": top,
        "database_search_compacted": top,
        "database_search_indexed": top,
        "database_search_unindexed": top,
        "database_batch_search": f"WITH v AS ({E_SQL}), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0), s AS (SELECT query_id, key, {l2} AS raw FROM v, q WHERE vec_id <> {ONE}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw, key) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, key, round(round(raw, 6), 3) + 0 AS score FROM r WHERE rank <= 5",
        "database_statements": f"WITH {upserts}, k AS (SELECT key FROM live ORDER BY CAST(key AS BIGINT) LIMIT 1), a AS (SELECT key, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM live WHERE key NOT IN (SELECT key FROM k) UNION ALL SELECT 'new ' || key, 50.0, 26.0 FROM k), s AS (SELECT key, (x0 - 50) * (x0 - 50) + (x1 - 26) * (x1 - 26) AS raw FROM a), r AS (SELECT *, row_number() OVER (ORDER BY raw, key) AS rank FROM s) SELECT CAST(rank AS INTEGER) AS rank, key, round(raw::FLOAT::DOUBLE, 2) + 0 AS score FROM r WHERE rank <= {K}",
        "list_collections": f"SELECT * FROM ({coll}) ORDER BY name",
        "describe_collection": f"SELECT * FROM ({coll}) WHERE name = 'V'",
        "database_settings": "SELECT 'V' AS name, 64 AS dimension, 'cosine' AS metric, 8 AS shard_count, 24 AS index_m, 90 AS index_ef, count(*) AS next_id FROM embeddings",
        "recovery_report": f"SELECT 3::BIGINT AS segments, a + b + 1 AS changes, greatest(a, b) AS largest, true AS open_tail FROM ({sizes})",
        "database_shards": f"WITH c AS ({C_SQL}) SELECT CAST({FNV.format(k='key')} % 8 AS INTEGER) AS shard_id, count(*) AS n FROM c GROUP BY 1",
        "database_optimized_live": f"WITH {last} SELECT key, seq FROM live",
    }
