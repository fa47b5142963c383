import pytest
from pyspark.sql import functions as F

from lodestar.errors import AlreadyExists, Conflict, InvalidArgument, NotFound, ResourceExhausted
from lodestar.plans.database import Database
from lodestar.schema import Config, Guardrails, Storage


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db", Config(storage=Storage(shard_count=4)))


def hits(df):
    return [(r["key"], round(r["score"], 6)) for r in df.collect()]


def test_cosine_scores_and_normalized_reads(db):
    db.create_collection("c", 3)
    assert db.batch_insert("c", [("north", [0, 5, 12]), ("east", [12, 0, 5])]) == 2
    assert hits(db.search("c", [0, 10, 24], 2)) == [("north", -1.0), ("east", round(-60 / 169, 6))]
    assert db.get("c", "north") == pytest.approx([0, 5 / 13, 12 / 13])
    again = Database(db.spark, db.files.root)
    assert again.get("c", "east") == pytest.approx([12 / 13, 0, 5 / 13]) and again.key_id("c", "east") == 1
    with pytest.raises(InvalidArgument):
        again.open_collection("c", 4, "cosine")
    with pytest.raises(InvalidArgument):
        again.open_collection("c", 3, "dot_product")


def test_batch_overwrite_and_report(db):
    db.create_collection("c", 2, "l2")
    assert db.batch_insert("c", [("p", [7, 1]), ("q", [0.5, 3]), ("p", [-4, 6]), ("p", [8, 8])]) == 4
    report = {r["id"]: (r["key"], r["had_old"], r["old_id"]) for r in db.upsert_report("c").collect()}
    assert report == {0: ("p", False, None), 1: ("q", False, None), 2: ("p", True, 0), 3: ("p", True, 2)}
    assert db.count("c") == 2 and db.get("c", "p") == [8, 8]


def test_overwrite_delete_and_ids(db):
    db.create_collection("c", 2, "l2")
    db.batch_insert("c", [("p", [1, 0]), ("q", [0, 7])])
    db.insert("c", "p", [3, -9])
    assert hits(db.search("c", [0, 1], 1)) == [("q", 36.0)]
    db.delete("c", "q")
    assert hits(db.search("c", [0, 1], 1)) == [("p", 109.0)]
    with pytest.raises(NotFound):
        db.get("c", "q")
    with pytest.raises(NotFound):
        db.delete("c", "q")
    assert [(r["id"], r["key"]) for r in db.resolve_ids("c", [0, 1, 2, 77]).collect()] == [(2, "p")]
    assert db.is_deleted("c", 1) and not db.is_deleted("c", 2) and db.count("c") == 1


def test_ties_and_shards(db):
    db.create_collection("c", 2, "dot_product")
    db.batch_insert("c", [("far", [1, -2]), ("twin b", [4, 4]), ("near", [9, 1]), ("twin a", [4, 4])])
    assert [k for k, _ in hits(db.search("c", [1, 1], 4))] == ["near", "twin a", "twin b", "far"]
    point = db.point(db.manifest("c"), "near")
    assert "PartitionFilters: [isnotnull(shard_id" in point._jdf.queryExecution().toString()


def test_validation_and_guardrails(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", Config(Guardrails(max_top_k=2, max_batch_size=2)))
    db.create_collection("c", 2, "l2")
    for bad in ([("a", [1, 2])] * 3, [], [("", [1, 2])], [("a", [1])], [("a", [1, float("inf")])], [("a", [1, float("nan")])]):
        with pytest.raises(InvalidArgument):
            db.batch_insert("c", bad)
    for k, q in ((0, [1, 1]), (3, [1, 1]), (1, [1]), (1, [1, float("nan")])):
        with pytest.raises(InvalidArgument):
            db.search("c", q, k)
    with pytest.raises(InvalidArgument):
        db.search("c", [1, 1], 1, ef_search=5000)
    for name in ("", "..", "a/b"):
        with pytest.raises(InvalidArgument):
            db.create_collection(name, 2)
    with pytest.raises(AlreadyExists):
        db.create_collection("c", 2)
    with pytest.raises(InvalidArgument):
        db.create_collection("d", 0)
    with pytest.raises(InvalidArgument):
        db.create_collection("d", 2, "manhattan")
    with pytest.raises(NotFound):
        db.search("none", [1, 1], 1)
    assert db.count("c") == 0 and hits(db.search("c", [1, 1], 1)) == []


def test_data_limit(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", Config(Guardrails(max_data_dir_bytes=1)))
    db.create_collection("c", 2)
    with pytest.raises(ResourceExhausted):
        db.insert("c", "a", [1, 2])


def test_include_embedding_and_zero_vector(db):
    db.create_collection("c", 2)
    db.batch_insert("c", [("zero", [0, 0]), ("a", [1, 0])])
    assert "embedding" not in db.search("c", [1, 0], 1).columns
    rows = db.search("c", [1, 0], 2, include_embedding=True).collect()
    assert [(r["rank"], r["key"], list(r["embedding"]), r["score"]) for r in rows] == [(1, "a", [1, 0], -1.0), (2, "zero", [0, 0], 0.0)]


def test_catalog(db):
    db.create_collection("B", 2, "l2")
    db.create_collection("a", 3)
    db.batch_insert("B", [("x", [0, 0])])
    db.create_index("B", m=24, ef_construction=90)
    assert [tuple(r) for r in db.list_collections().collect()] == [("B", 2, "l2", 1, True), ("a", 3, "cosine", 0, False)]
    assert db.describe("b").first()["name"] == "B" and db.use("b") == "B"
    assert Database(db.spark, db.files.root).manifest("B")["index"] == {"m": 24, "ef_construction": 90, "ef_search": 50}
    db.drop_index("B")
    assert db.manifest("B")["index"] is None
    with pytest.raises(InvalidArgument):
        db.create_index("B", m=1)
    db.delete_collection("B")
    assert db.names() == ["a"]


def test_seal_merge_and_vacuum_keep_what_is_live(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", Config(storage=Storage(shard_count=2, seal_ops=4, merge_over=2, merge_width=2)))
    db.create_collection("c", 1, "l2")
    expected = {}
    for i in range(7):
        db.batch_insert("c", [(f"k{i % 3}", [i]), (f"only{i}", [i])])
        expected |= {f"k{i % 3}": i, f"only{i}": i}
        if i % 3 == 2:
            db.delete("c", f"only{i}")
            del expected[f"only{i}"]
        db.optimize("c")
        assert {r["key"]: r["embedding"][0] for r in db.live("c").collect()} == expected
    report = db.report().first()
    assert report["changes"] == 16
    db.compact("c")
    assert db.vacuum("c") > 0
    assert {r["key"]: r["embedding"][0] for r in db.live("c").collect()} == expected


def test_load_keeps_order_of_arrival_and_batch_search(db, spark):
    db.create_collection("c", 2, "l2")
    rows = spark.range(3000).select((F.col("id") % 500).cast("string").alias("key"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"), "id")
    assert db.load("c", rows, F.col("id")) == 3000
    assert db.count("c") == 500 and db.get("c", "7") == [2507, 0]
    found = db.batch_search("c", spark.createDataFrame([(1, [2500.0, 0.0]), (2, [2999.0, 0.0])], "query_id int, query array<double>"), 2)
    assert [(r["query_id"], r["rank"], r["key"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, "0"), (1, 2, "1"), (2, 1, "499"), (2, 2, "498")]
    with pytest.raises(InvalidArgument, match="item 5"):
        db.load("c", rows.withColumn("key", F.when(F.col("id") >= 5, "").otherwise(F.col("key"))), F.col("id"))


def test_indexed_search_agrees_with_exact(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", Config(storage=Storage(index_min_rows=50, index_ef_construction=60)))
    db.create_collection("c", 8)
    rows = spark.range(300).select(F.col("id").cast("string").alias("key"), F.array(*(F.sin(F.col("id") * (i + 1)).cast("float") for i in range(8))).alias("embedding"), "id")
    db.load("c", rows, F.col("id"))
    exact = hits(db.search("c", [0.3] * 8, 5))
    db.create_index("c")
    assert db.build_index("c") == 300
    db.insert("c", "new", [0.3] * 8)  # after the graphs were built
    db.delete("c", exact[1][0])
    found = hits(db.search("c", [0.3] * 8, 5))
    assert found[0][0] == "new" and found[1] == exact[0] and exact[1][0] not in dict(found)


@pytest.mark.parametrize("partitions, advisory", [(3, "64k"), (16, "1m"), (40, "64m")])
def test_load_keeps_every_row(spark, tmp_path, partitions, advisory):
    """50,000 rows of 64 components; numbers and vectors of very different width, so that adaptive execution has much to coalesce."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        db = Database(spark, f"file://{tmp_path}/db")
        db.create_collection("c", 64, "l2")
        n = 50_000
        rows = spark.range(n, numPartitions=7).select(F.concat(F.lit("k"), F.col("id") % 40_000).alias("key"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * F.col("id")).cast("float")).alias("embedding"), (n - F.col("id")).alias("back"))
        assert db.load("c", rows, F.col("back")) == n and db.load("c", rows) == n
        seen = db.changes("c").agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
        assert tuple(seen) == (2 * n, 2 * n, 0, 2 * n - 1) and db.count("c") == 40_000
        first = db.changes("c").where(F.col("seq") < n)
        assert first.where(F.col("embedding")[1] != n - F.col("seq") - 1).count() == 0  # by ordinal: the largest id came first
        assert db.manifest("c")["next_seq"] == 2 * n and db.files.names("c/staging") == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_search_of_merged_rows_has_no_shuffle(db, spark):
    db.create_collection("c", 2, "l2")
    rows = spark.range(400).select((F.col("id") % 300).cast("string").alias("key"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), "id")
    db.load("c", rows, F.col("id"))
    folded = db.search("c", [10, 1], 3)
    assert "Exchange hashpartitioning" in folded._jdf.queryExecution().executedPlan().toString()
    expected = hits(folded)
    db.compact("c")
    merged = db.search("c", [10, 1], 3)
    assert "Exchange hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString() and hits(merged) == expected
    db.insert("c", "new", [10, 1])
    db.delete("c", expected[0][0])
    tail = db.search("c", [10, 1], 3)
    assert hits(tail) == [("new", 0.0), *expected[1:]]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_apply_changes_once(db, spark):
    db.create_collection("c", 1, "l2")
    batch = spark.createDataFrame([(1, "upsert", "a", [1.0]), (0, "delete", "a", None), (2, "upsert", "b", [2.0]), (3, "delete", "b", None), (4, "delete", "never", None)], "o long, op string, key string, embedding array<double>")
    for _ in range(2):
        db.apply("c", batch, F.col("o"), "stream", 0)
    assert db.apply("c", batch, F.col("o"), "stream", 1) == 5 and db.manifest("c")["next_seq"] == 10
    assert [(r["key"], r["seq"]) for r in db.live("c").collect()] == [("a", 6)]
    for wrong in (("upsert", "a", None), ("upsert", None, [1.0]), ("flag", "a", [1.0]), ("upsert", "a", [1.0, 2.0]), (None, "a", [1.0])):
        with pytest.raises(InvalidArgument, match="item 1"):
            db.apply("c", batch.limit(1).coalesce(1).unionByName(spark.createDataFrame([(9, *wrong)], batch.schema)), F.col("o"))
    assert db.load("c", batch.limit(0)) == 0 and db.count("c") == 1


def test_index_follows_merges(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", Config(storage=Storage(index_min_rows=20, merge_over=2, merge_width=3, seal_ops=100)))
    db.create_collection("c", 4, "l2")
    rows = spark.range(250).select(F.col("id").cast("string").alias("key"), F.array(*(F.sin(F.col("id") * (i + 1)).cast("float") for i in range(4))).alias("embedding"), "id")
    db.load("c", rows, F.col("id"))
    db.create_index("c")
    assert db.build_index("c") == 250
    query = [0.2, 0.4, 0.1, 0.3]
    best = hits(db.search("c", query, 2))
    for key, _ in best:
        db.delete("c", key)
    exact = hits(search_exactly(db, query))
    assert hits(db.search("c", query, 2)) == exact
    assert db.optimize("c")["indexed"] and db.manifest("c")["graphs"] and hits(db.search("c", query, 2)) == exact
    graphs = db._candidates(db.manifest("c"), query, 2, 0)
    assert "Exchange" not in graphs._jdf.queryExecution().executedPlan().toString()


def search_exactly(db, query):
    from lodestar.operators.search import ranked, top_k

    return ranked(top_k(db.live("c"), query, 2, "l2"))


def test_second_writer_of_a_version_conflicts(db):
    db.create_collection("c", 1, "l2")
    stale = db.manifest("c")
    db.insert("c", "a", [1])
    with pytest.raises(Conflict):
        db._publish("c", stale)
    assert db.count("c") == 1 and not [x for x in db.files.names("c") if x.endswith(".tmp")]
