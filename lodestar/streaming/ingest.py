"""Continuous upserts into a changelog, read again as the current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import live
from ..plans.database import Database


def ingest(changes: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of changes (seq, op, key, embedding) to target, one folder a batch.

    foreachBatch may run a batch again; it then overwrites the batch's own folder, so that each
    change is stored once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_into(db: Database, name: str, changes: DataFrame, checkpoint: str, stream: str, once: bool = True, maintain: bool = True) -> StreamingQuery:
    """Apply a stream of changes (ordinal, op, key, embedding) to a collection, one commit a batch, and seal and merge after each.

    The collection keeps the last batch of each stream, by name, so that a batch that is run again isn't applied again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        db.apply(name, batch, F.col("ordinal"), stream, batch_id)
        if maintain:
            db.optimize(name)

    writer = changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark, target: str) -> DataFrame:
    return live(spark.read.parquet(target).drop("batch_id"))


def stored(spark, target: str) -> DataFrame:
    return spark.read.parquet(target).withColumn("batch_id", F.col("batch_id").cast("long"))
