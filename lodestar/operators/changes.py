"""Folding a changelog (seq, op, key, embedding): the last change of a key decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(changes: DataFrame, *by: Column | str) -> DataFrame:
    """Last change of each key, deletions included: one aggregation, combined before the shuffle."""
    rest = [c for c in changes.columns if c != "key" and c not in by]
    last = changes.groupBy(*by, "key").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select(*by, "key", *(F.col(f"last.{c}").alias(c) for c in rest))


def live(changes: DataFrame) -> DataFrame:
    return latest_per_key(changes).where("op = 'upsert'")


def tombstoned(changes: DataFrame) -> DataFrame:
    return latest_per_key(changes).where("op = 'delete'")


def point(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key)


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("key"), "key", "left_semi")


def missing(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of keys those that have no row: deleted or never there."""
    return keys.select("key").join(rows.select("key"), "key", "left_anti")


def resolve_ids(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the ids (seq of an upsert) those that are current, with their keys."""
    return live(changes).join(ids, "seq", "left_semi").select(F.col("seq").alias("id"), "key")


def upsert_report(changes: DataFrame) -> DataFrame:
    """For each upsert: its id, and the id that it replaced, if the key was live just before."""
    before = Window.partitionBy("key").orderBy("seq")
    seen = changes.select("key", "op", "seq", F.lag("op").over(before).alias("old_op"), F.lag("seq").over(before).alias("old"))
    had = F.coalesce(F.col("old_op") == "upsert", F.lit(False))
    return seen.where("op = 'upsert'").select("key", F.col("seq").alias("id"), had.alias("had_old"), F.when(had, F.col("old")).alias("old_id"))


def sealed(changes: DataFrame, ops: int) -> DataFrame:
    """Changes cut into segments of `ops` by seq, each with the last change of each key, deletions included."""
    return latest_per_key(changes.withColumn("segment_id", F.floor(F.col("seq") / ops)), "segment_id")


def merged(segments: DataFrame, lowest: int) -> DataFrame:
    """The `lowest` oldest segments as one: the last change by seq wins, whatever segment it is in; deletions stay."""
    oldest = segments.select("segment_id").distinct().orderBy("segment_id").limit(lowest)
    inside = segments.join(F.broadcast(oldest), "segment_id", "left_semi")  # at most `lowest` rows
    others = segments.join(F.broadcast(oldest), "segment_id", "left_anti")
    one = latest_per_key(inside.drop("segment_id")).withColumn("segment_id", F.lit(-1).cast("long"))
    return others.unionByName(one)
