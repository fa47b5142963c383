"""Operators: exact and approximate search, folding of changes, compaction."""
