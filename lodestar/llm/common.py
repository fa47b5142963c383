"""What the operators share: reading tables, shared storage, shipping code, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

#: Rows and bytes of an Arrow batch between Spark and Python, unless the session sets them: a worker and its executor hold one or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}

#: Whether an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A side is broadcast only if its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let workers import this package, and set batches to moderate sizes."""
    for name, (default, ours) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    return shipping.ship(spark)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches], *caches: dict) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, on a worker that gives memory back when a task ends: caches are emptied, freed pages go to the system."""

    def tidy(batches: Batches) -> Batches:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            if caches:
                gc.collect()  # what a cache held may be in cycles
            trim()

    return tidy


def trim() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def sliced(batches: Batches, column: int = 1, rows: int = 1024, size: int = 4 << 20) -> Batches:
    """Batches cut into ones of at most `rows` rows, and of at most about `size` bytes in a column of texts or blobs."""
    for b in batches:
        if not b.num_rows:
            continue
        held = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            before = held[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(held, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); a local one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lodestar_shared", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="lodestar-shared-")
        sc._lodestar_shared = configured
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. release() removes what was written.

    The shuffles of the write go as it ends: nothing else reads them, and else they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before is None:  # a Spark without it
        df.write.parquet(path)
    else:
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    made = getattr(spark.sparkContext, "_lodestar_made", None)
    if made is None:
        made = spark.sparkContext._lodestar_made = []
    made.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lodestar_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of write_table() that nothing reads any more: all that was made of it is stored."""
    path = getattr(table, "_lodestar_path", None)
    if path:
        _delete(table.sparkSession, path)
        table.sparkSession.sparkContext._lodestar_made.remove(path)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def made_so_far(spark: SparkSession) -> int:
    """A mark for release(): tables made later can be told from those made before."""
    return len(getattr(spark.sparkContext, "_lodestar_made", []))


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Delete the tables that write_table() made in this context (since a mark; all but one); results that read them must be stored first."""
    made = getattr(spark.sparkContext, "_lodestar_made", [])
    gone = [x for x in made[since:] if x != getattr(but, "_lodestar_path", None)]
    for x in gone:
        made.remove(x)
    return sum(_delete(spark, x) for x in gone)


def small_or_whole(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its size stays under limit; as it is (a shuffle join) otherwise.

    row_bytes is what a row takes at least; what its texts and lists hold is measured. df should be a
    stored table: it is counted here, up to the limit, and read again by the join.
    """
    most = max(1, limit // row_bytes)
    if df.limit(most + 1).count() > most:
        return df
    wide = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct", "string", "binary"))]
    held = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*wide)))), F.lit(0)), F.count("*")).first() if wide else (0, 0)
    return F.broadcast(df) if held[0] + row_bytes * held[1] <= limit else df


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


