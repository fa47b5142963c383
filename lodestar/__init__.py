"""Keyed vector collections on Spark: upserts, exact and approximate nearest neighbours, compaction, ingest."""
