"""Collections in a folder: versioned manifests, an immutable changelog, exact and indexed search.

A collection's folder holds `manifest-<version>.json` (the highest version counts) and Parquet
segments of changes, laid out by shard_id. A write makes its segment first and publishes the next
manifest after; a reader of one version sees it whole, and a failed write is never seen.

Once the oldest segments are merged they hold one current row a key (`folded`). Reads then fold only
what was written later, and leave those keys out of the merged rows: no shuffle of all rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, Corrupt, InvalidArgument, NotFound, ResourceExhausted
from ..functions.metrics import normalized, shard_of, shown
from ..functions.validate import check_search, check_vector, violation
from ..operators import changes as ch
from ..operators import hnsw, search
from ..schema import CHANGE, COLLECTIONS, ITEM, Config, collection_name, compression_name, metric_name
from ..sources.jsonl import read_jsonl
from ..sources.storage import Storage

FILE_BYTES = 128 << 20  # intended size of a segment's files
KEY_BYTES = 32 << 20  # changed keys are broadcast only up to so many bytes
PLACE_BITS = 33  # of monotonically_increasing_id(): a row's place in its partition


class Database:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()) -> None:
        self.spark, self.config, self.files = spark, config, Storage(spark, root)
        self.current: str | None = None

    # -- catalog -----------------------------------------------------------------------------

    def _versions(self, name: str) -> list[str]:
        return [x for x in self.files.names(name) if x.startswith("manifest-") and x.endswith(".json")]

    def manifest(self, name: str) -> dict:
        found = self._versions(collection_name(name))
        if not found:
            raise NotFound(f"collection {name}")
        return json.loads(self.files.read(f"{name}/{found[-1]}"))

    def _publish(self, name: str, manifest: dict) -> None:
        manifest["version"] += 1
        self.files.publish(f"{name}/manifest-{manifest['version']:012d}.json", json.dumps(manifest))

    def _room(self) -> None:
        limit = self.config.guardrails.max_data_dir_bytes
        if limit and self.files.size() >= limit:
            raise ResourceExhausted(f"the data folder holds {limit} bytes or more")

    def create_collection(self, name: str, dimension: int, metric: str = "cosine", compression: str | None = None, shard_count: int | None = None) -> dict:
        collection_name(name)
        if not 1 <= dimension <= self.config.guardrails.max_collection_dim:
            raise InvalidArgument(f"dimension must be 1 to {self.config.guardrails.max_collection_dim}")
        if self._versions(name):
            raise AlreadyExists(f"collection {name}")
        self._room()
        manifest = {
            "name": name, "dimension": dimension, "metric": metric_name(metric, strict=True), "compression": compression_name(compression or self.config.storage.compression),
            "shard_count": shard_count or self.config.storage.shard_count, "index": None, "version": 0, "next_seq": 0, "segments": [], "graphs": None,
        }
        self._publish(name, manifest)
        return manifest

    def open_collection(self, name: str, dimension: int, metric: str) -> dict:
        """The manifest, if the collection has this shape."""
        m = self.manifest(name)
        if m["dimension"] != dimension or m["metric"] != metric_name(metric, strict=True):
            raise InvalidArgument(f"collection {name} has dimension {m['dimension']} and metric {m['metric']}")
        return m

    def delete_collection(self, name: str) -> None:
        self.manifest(name)
        self.files.delete(name)
        if self.current == name:
            self.current = None

    def names(self) -> list[str]:
        return [n for n in self.files.names() if self._versions(n)]

    def _info(self, made: list[dict]) -> DataFrame:
        """name, dimension, metric, count, has_index of some collections; all counts come from one aggregation."""
        info = self.spark.createDataFrame([(m["name"], m["dimension"], m["metric"], 0, m["index"] is not None) for m in made], COLLECTIONS).drop("count")
        counts = None
        for m in made:
            if m["segments"]:
                one = self._live(m).select(F.lit(m["name"]).alias("name"))
                counts = one if counts is None else counts.unionByName(one)
        counted = info.withColumn("count", F.lit(0).cast("long")) if counts is None else info.join(counts.groupBy("name").count(), "name", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
        return counted.select("name", "dimension", "metric", "count", "has_index").orderBy("name")

    def list_collections(self) -> DataFrame:
        return self._info([self.manifest(n) for n in self.names()])

    def resolve(self, name: str) -> str:
        """Canonical name of a collection named in any case."""
        found = [n for n in self.names() if n == name] or [n for n in self.names() if n.lower() == name.lower()]
        if not found:
            raise NotFound(f"collection {name}")
        return found[0]

    def describe(self, name: str) -> DataFrame:
        return self._info([self.manifest(self.resolve(name))])

    def use(self, name: str) -> str:
        self.current = self.resolve(name)
        return self.current

    # -- changes -----------------------------------------------------------------------------

    def _changes(self, m: dict, segments: list[dict] | None = None) -> DataFrame:
        """All changes, or those of some segments, with their segment_id."""
        segments = m["segments"] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], CHANGE).withColumn("segment_id", F.lit(None).cast("long"))
        out = None
        for s in segments:
            one = self.spark.read.schema(CHANGE).parquet(self.files.path(f"{m['name']}/{s['path']}")).withColumn("segment_id", F.lit(s["id"]).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out.select(*CHANGE.names, "segment_id")

    def changes(self, name: str) -> DataFrame:
        return self._changes(self.manifest(name)).drop("segment_id")

    def _without(self, rows: DataFrame, after: DataFrame, segments: list[dict]) -> DataFrame:
        """rows whose key isn't among the folded changes of some segments; their keys are broadcast if the manifest says that they are few bytes."""
        keys = after.select("key")
        few = sum(s["key_bytes"] + 64 * s["ops"] for s in segments) <= KEY_BYTES
        return rows.join(F.broadcast(keys) if few else keys, "key", "left_anti")

    def _live(self, m: dict) -> DataFrame:
        base = [s for s in m["segments"][:1] if s["folded"]]
        tail = m["segments"][len(base) :]
        if not base:
            return ch.live(self._changes(m).drop("segment_id"))
        rows = self._changes(m, base).drop("segment_id")
        if not tail:
            return rows
        after = ch.latest_per_key(self._changes(m, tail).drop("segment_id"))
        return self._without(rows, after, tail).unionByName(after.where("op = 'upsert'"))

    def live(self, name: str) -> DataFrame:
        """Current rows: key, seq, embedding (normalized if the metric is cosine), shard_id."""
        return self._live(self.manifest(name)).select("key", "seq", "embedding", "shard_id")

    def _dealt(self, m: dict, rows: DataFrame, n: int) -> DataFrame:
        """Rows dealt by shard, so that a lookup reads one shard's folder; a large shard gets several files."""
        if n < 10_000:
            return rows.coalesce(1)
        files = max(1, -(-n * (4 * m["dimension"] + 64) // (FILE_BYTES * m["shard_count"])))
        return rows.repartition(m["shard_count"] * files, "shard_id", F.pmod(F.xxhash64("key"), F.lit(files)))

    def _append(self, m: dict, rows: DataFrame, n: int, key_bytes: int) -> None:
        """rows (seq, op, key, embedding) as one segment, checked, then the manifest that makes it visible."""
        path = f"segments/{uuid.uuid4().hex}"
        rows = rows.withColumn("shard_id", shard_of(F.col("key"), m["shard_count"])).select(*CHANGE.names)
        self._dealt(m, rows, n).write.partitionBy("shard_id").parquet(self.files.path(f"{m['name']}/{path}"))
        first, last = m["next_seq"], m["next_seq"] + n - 1
        seqs = self.spark.read.schema(CHANGE).parquet(self.files.path(f"{m['name']}/{path}")).select("seq")
        got = seqs.agg(F.count("*"), F.count("seq"), F.min("seq"), F.max("seq"), F.sum(F.col("seq").cast("decimal(38,0)"))).first()
        if tuple(got) != (n, n, first, last, n * (first + last) // 2):
            self.files.delete(f"{m['name']}/{path}")
            raise Corrupt(f"a segment of {n} rows from {first} on was stored as {tuple(got)}")
        m["segments"].append({"id": 1 + max((s["id"] for s in m["segments"]), default=-1), "path": path, "ops": n, "key_bytes": key_bytes, "last": last, "sealed": False, "folded": False})
        m["next_seq"] += n
        self._publish(m["name"], m)

    def _stored(self, m: dict, rows: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<float>")
        return rows.withColumn("embedding", normalized(e) if m["metric"] == "cosine" else e)

    def load(self, name: str, rows: DataFrame, ordinal: Column | None = None) -> int:
        """Upsert any number of rows (key, embedding) as one commit; the last of a key by ordinal, or by place in the
        partitions, wins. Returns the number of rows."""
        return self.apply(name, rows.withColumn("op", F.lit("upsert")), ordinal)

    def apply(self, name: str, rows: DataFrame, ordinal: Column | None = None, stream: str | None = None, batch_id: int = -1) -> int:
        """Changes (op, key, embedding; op is upsert or delete) as one commit. A batch of a stream that was applied before is skipped.

        Rows are evaluated once, into a staging table that holds each one's partition and place in it; these
        give consecutive numbers without a global sort. Deleting a key that isn't there changes nothing.
        """
        m = self.manifest(name)
        if stream is not None and m.get("streams", {}).get(stream, -1) >= batch_id:
            return 0
        self._room()
        taken = rows.select("op", "key", "embedding", *([] if ordinal is None else [ordinal.alias("ordinal")]))
        if ordinal is not None:
            taken = taken.repartitionByRange("ordinal").sortWithinPartitions("ordinal").drop("ordinal")
        place = F.monotonically_increasing_id()
        staging = f"{name}/staging/{uuid.uuid4().hex}"
        taken.withColumn("at", place).write.parquet(self.files.path(staging))
        try:
            staged = self.spark.read.parquet(self.files.path(staging))
            staged = staged.select("op", "key", "embedding", F.shiftright("at", PLACE_BITS).alias("part"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"))
            wrong = F.when(F.coalesce(F.col("op").isin("upsert", "delete"), F.lit(False)), violation(F.col("key"), F.col("embedding"), m["dimension"], F.col("op") == "delete")).otherwise(F.lit("op must be upsert or delete"))
            found = staged.select("part", F.octet_length("key").alias("bytes"), F.when(wrong.isNotNull(), F.struct("place", wrong.alias("problem"))).alias("bad"))
            parts = found.groupBy("part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("bad").alias("bad")).orderBy("part").collect()
            offsets, n = [], 0
            for r in parts:
                if r["bad"] is not None:
                    raise InvalidArgument(f"item {n + r['bad']['place']}: {r['bad']['problem']}")
                offsets.append((r["part"], m["next_seq"] + n))
                n += r["n"]
            if stream is not None:
                m.setdefault("streams", {})[stream] = batch_id
            if n:
                base = F.broadcast(self.spark.createDataFrame(offsets, "part long, base long"))  # one row a task of the load
                numbered = staged.join(base, "part").withColumn("seq", F.col("base") + F.col("place")).drop("part", "place", "base")
                self._append(m, self._stored(m, numbered), n, sum(r["bytes"] for r in parts))
            elif stream is not None:
                self._publish(name, m)
            return n
        finally:
            self.files.delete(staging)

    def batch_insert(self, name: str, items: Sequence[tuple[str, Sequence[float]]]) -> int:
        """Upsert at most max_batch_size items, all or none; returns their number."""
        m = self.manifest(name)
        if not items:
            raise InvalidArgument("the batch is empty")
        if len(items) > self.config.guardrails.max_batch_size:
            raise InvalidArgument(f"the batch is over {self.config.guardrails.max_batch_size} items")
        for i, (key, values) in enumerate(items):
            if not key:
                raise InvalidArgument(f"item {i}: key is required")
            try:
                check_vector(values, m["dimension"])
            except InvalidArgument as e:
                raise InvalidArgument(f"item {i}: {e}") from None
        self._room()
        numbered = [(i, "upsert", k, [float(x) for x in v]) for i, (k, v) in enumerate(items, m["next_seq"])]
        self._append(m, self._stored(m, self.spark.createDataFrame(numbered, ITEM)), len(items), sum(len(k.encode()) for k, _ in items))
        return len(items)

    def insert(self, name: str, key: str, embedding: Sequence[float]) -> None:
        self.batch_insert(name, [(key, embedding)])

    def load_file(self, name: str, path: str) -> int:
        """Upsert a JSON-lines file in one commit."""
        return self.load(name, read_jsonl(self.spark, path), F.col("ordinal"))

    def delete(self, name: str, key: str) -> None:
        m = self.manifest(name)
        if not key:
            raise InvalidArgument("key is required")
        self._row(m, key)
        self._append(m, self.spark.createDataFrame([(m["next_seq"], "delete", key, None)], ITEM), 1, len(key.encode()))

    # -- lookups -----------------------------------------------------------------------------

    def _shard(self, m: dict, key: str) -> int:
        h = 2166136261
        for b in key.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h % m["shard_count"]

    def point(self, m: dict, key: str) -> DataFrame:
        """The key's current row; the shard predicate prunes folders, the key's is pushed to the files."""
        c = self._changes(m).drop("segment_id").where((F.col("shard_id") == self._shard(m, key)) & (F.col("key") == key))
        return ch.live(c)

    def _row(self, m: dict, key: str):
        found = self.point(m, key).first()
        if found is None:
            raise NotFound(f"key {key}")
        return found

    def get(self, name: str, key: str) -> list[float]:
        if not key:
            raise InvalidArgument("key is required")
        return list(self._row(self.manifest(name), key)["embedding"])

    def multi_get(self, name: str, keys: Iterable[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return ch.among(self.live(name), wanted)

    def key_id(self, name: str, key: str) -> int:
        return self._row(self.manifest(name), key)["seq"]

    def resolve_ids(self, name: str, ids: Iterable[int]) -> DataFrame:
        return ch.resolve_ids(self.changes(name), self.spark.createDataFrame([(i,) for i in ids], "seq long"))

    def is_deleted(self, name: str, row_id: int) -> bool:
        """Whether an id isn't the current one of its key."""
        return self.resolve_ids(name, [row_id]).limit(1).count() == 0

    def all_ids(self, name: str) -> DataFrame:
        return self.live(name).select(F.col("seq").alias("id"))

    def upsert_report(self, name: str) -> DataFrame:
        return ch.upsert_report(self.changes(name))

    def count(self, name: str) -> int:
        return self.live(name).count()

    # -- search ------------------------------------------------------------------------------

    def search(self, name: str, embedding: Sequence[float], top_k: int, ef_search: int = 0, include_embedding: bool = False) -> DataFrame:
        """rank, key, score (float), embedding if asked for; ascending by (score, key)."""
        m = self.manifest(name)
        query = check_search(embedding, top_k, ef_search, m["dimension"], self.config.guardrails)
        hits = None
        if m["index"] and m["graphs"]:
            near = search.top_k(self._candidates(m, query, top_k, ef_search), query, top_k, m["metric"], include_embedding)
            best = near.collect()  # top_k rows at most
            hits = self.spark.createDataFrame(best, near.schema) if len(best) == top_k else None
        if hits is None:
            hits = search.top_k(self._live(m), query, top_k, m["metric"], include_embedding)
        return search.ranked(hits).select("rank", "key", F.col("score").cast("float").alias("score"), *["embedding"] * include_embedding).orderBy("rank")

    def _candidates(self, m: dict, query: list[float], top_k: int, ef_search: int) -> DataFrame:
        """Current rows that the graphs propose, and all rows written after them. The graphs hold the rows, so nothing else is read."""
        upto = m["graphs"]["upto"]
        graphs = self.spark.read.schema(hnsw.SIDECAR).parquet(self.files.path(f"{m['name']}/{m['graphs']['path']}"))
        settings = hnsw.GraphSettings(m["index"]["m"], m["index"]["ef_construction"], m["index"]["ef_search"])
        found = hnsw.search_graphs(graphs, query, top_k, m["metric"], settings, ef_search).select("key", "embedding")
        tail = [s for s in m["segments"] if s["last"] >= upto]
        if not tail:
            return found
        after = ch.latest_per_key(self._changes(m, tail).drop("segment_id").where(F.col("seq") >= upto))
        return self._without(found, after, tail).unionByName(after.where("op = 'upsert'").select("key", "embedding"))

    def batch_search(self, name: str, queries: DataFrame, top_k: int) -> DataFrame:
        """For each query (query_id, query) its top_k: query_id, rank, key, score."""
        m = self.manifest(name)
        if not 0 < top_k <= self.config.guardrails.max_top_k:
            raise InvalidArgument(f"top_k must be 1 to {self.config.guardrails.max_top_k}")
        return search.knn_sliced(self._live(m), queries, top_k, m["dimension"], m["metric"]).select("query_id", "rank", "key", shown(F.col("score")).alias("score"))

    # -- index -------------------------------------------------------------------------------

    def create_index(self, name: str, m: int = 0, ef_construction: int = 0) -> None:
        """Idempotent; parameters not given come from the settings, other ones than before rebuild the graphs."""
        man, s = self.manifest(name), self.config.storage
        index = {"m": m or s.index_m, "ef_construction": ef_construction or s.index_ef_construction, "ef_search": s.index_ef_search}
        hnsw.GraphSettings(**index)
        self._room()
        if man["index"] == index:
            return
        man["index"], man["graphs"] = index, None
        self._publish(name, man)

    def drop_index(self, name: str) -> None:
        man = self.manifest(name)
        if man["index"] is None:
            raise NotFound(f"collection {name} has no index")
        man["index"] = man["graphs"] = None
        self._publish(name, man)

    def build_index(self, name: str) -> int:
        """Graphs of all current rows, by segment; returns how many rows they hold."""
        man = self.manifest(name)
        if man["index"] is None:
            raise NotFound(f"collection {name} has no index")
        # a segment larger than the seal threshold is cut by seq, so that one task never builds a graph without bound
        rows = self._live(man).select(F.floor(F.col("seq") / self.config.storage.seal_ops).cast("long").alias("segment_id"), "seq", "key", "embedding")
        path = f"graphs/{uuid.uuid4().hex}"
        settings = hnsw.GraphSettings(**man["index"])
        hnsw.build_graphs(rows, man["metric"], settings, self.config.storage.index_min_rows).write.parquet(self.files.path(f"{name}/{path}"))
        man["graphs"] = {"path": path, "upto": man["next_seq"]}
        self._publish(name, man)
        return self.spark.read.schema(hnsw.SIDECAR).parquet(self.files.path(f"{name}/{path}")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # -- lifecycle ---------------------------------------------------------------------------

    def _rewrite(self, man: dict, chosen: list[dict], sealed: bool) -> None:
        """The chosen segments as one: the last change of each key by seq. Deletions stay unless there is nothing older that they hide."""
        rows = ch.latest_per_key(self._changes(man, chosen).drop("segment_id"))
        oldest = chosen == man["segments"][: len(chosen)]
        if oldest:
            rows = rows.where("op = 'upsert'")
        path = f"segments/{uuid.uuid4().hex}"
        ops, key_bytes = sum(s["ops"] for s in chosen), sum(s["key_bytes"] for s in chosen)
        self._dealt(man, rows.select(*CHANGE.names), ops).sortWithinPartitions("shard_id", "key").write.partitionBy("shard_id").parquet(self.files.path(f"{man['name']}/{path}"))
        ids = {s["id"] for s in chosen}
        one = {"id": min(ids), "path": path, "ops": ops, "key_bytes": key_bytes, "last": max(s["last"] for s in chosen), "sealed": sealed, "folded": oldest}
        man["segments"] = sorted([s for s in man["segments"] if s["id"] not in ids] + [one], key=lambda s: s["id"])
        if oldest and man["graphs"] and one["last"] >= man["graphs"]["upto"]:
            man["graphs"] = None  # deletions that came after the graphs are gone
        self._publish(man["name"], man)

    def _reindex(self, name: str, had: bool) -> bool:
        """Graphs again, if a rewrite has dropped them."""
        man = self.manifest(name)
        if had and man["index"] and not man["graphs"]:
            self.build_index(name)
            return True
        return False

    def optimize(self, name: str) -> dict:
        """Seal the open tail once it is large enough; merge the oldest segments once there are too many; mend the index."""
        man, s = self.manifest(name), self.config.storage
        done, had = {"sealed": 0, "merged": 0, "indexed": False}, man["graphs"] is not None
        tail = [x for x in man["segments"] if not x["sealed"]]
        ops = sum(x["ops"] for x in tail)
        if tail and (ops >= s.seal_ops or 4 * man["dimension"] * ops >= s.seal_bytes):
            self._rewrite(man, tail, sealed=True)
            done["sealed"] = len(tail)
        while len(man["segments"]) > s.merge_over:
            oldest = man["segments"][: s.merge_width]
            self._rewrite(man, oldest, sealed=True)
            done["merged"] += len(oldest)
        done["indexed"] = self._reindex(name, had)
        return done

    def compact(self, name: str) -> None:
        """All segments as one, of one row a key."""
        man = self.manifest(name)
        had = man["graphs"] is not None
        if len(man["segments"]) > 1 or any(not s["folded"] for s in man["segments"]):
            self._rewrite(man, man["segments"], sealed=True)
            self._reindex(name, had)

    def vacuum(self, name: str) -> int:
        """Delete segments, graphs, manifests and staged rows that the latest version doesn't use; no write may be under way."""
        man, gone = self.manifest(name), 0
        used = {s["path"].split("/")[1] for s in man["segments"]} | ({man["graphs"]["path"].split("/")[1]} if man["graphs"] else set())
        for kind in ("segments", "graphs", "staging"):
            for x in self.files.names(f"{name}/{kind}"):
                if x not in used:
                    gone += self.files.delete(f"{name}/{kind}/{x}")
        for x in self._versions(name)[:-1]:
            gone += self.files.delete(f"{name}/{x}")
        return gone

    def report(self) -> DataFrame:
        """What a start would find, over all collections: segments, changes, the most changes in a segment, and whether a tail is open."""
        rows = [(s["ops"], not s["sealed"]) for n in self.names() for s in self.manifest(n)["segments"]]
        seen = self.spark.createDataFrame(rows, "ops long, open boolean")
        return seen.agg(F.count("*").alias("segments"), F.coalesce(F.sum("ops"), F.lit(0)).alias("changes"), F.coalesce(F.max("ops"), F.lit(0)).alias("largest"), F.coalesce(F.bool_or("open"), F.lit(False)).alias("open_tail"))
