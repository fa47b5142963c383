"""Schemas and settings."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

from .errors import InvalidArgument

VECTOR = T.ArrayType(T.FloatType(), False)
CHANGE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("shard_id", T.IntegerType()),
])
ITEM = T.StructType(CHANGE.fields[:4])
COLLECTIONS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("dimension", T.IntegerType()), T.StructField("metric", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("has_index", T.BooleanType()),
])

# Accepted names of metrics and compressions.
METRICS = {"cosine": "cosine", "l2": "l2", "dot": "dot_product", "dot_product": "dot_product", "dotproduct": "dot_product"}
COMPRESSIONS = {"int8": "int8", "scalar8": "int8", "scalar_int8": "int8"}


def metric_name(name: str | None, strict: bool = False) -> str:
    """Canonical metric; an unknown one is an error if strict, else cosine."""
    found = METRICS.get((name or "cosine").strip().lower())
    if found is None and strict:
        raise InvalidArgument(f"unknown metric {name!r}")
    return found or "cosine"


def compression_name(name: str | None) -> str:
    """int8 is a label only: vectors are stored as 32-bit floats."""
    return COMPRESSIONS.get((name or "").strip().lower(), "none")


def collection_name(name: str | None) -> str:
    if not name or name in (".", "..") or not re.fullmatch(r"[A-Za-z0-9._:-]+", name):
        raise InvalidArgument(f"collection name {name!r} must be letters, digits and . _ : -")
    return name


@dataclass(frozen=True)
class Guardrails:
    """Default limits; max_data_dir_bytes 0 is no limit."""

    max_top_k: int = 256
    max_batch_size: int = 1000
    max_ef_search: int = 4096
    max_collection_dim: int = 8192
    max_data_dir_bytes: int = 0
    require_deadline: bool = False


@dataclass(frozen=True)
class Storage:
    """Default thresholds of sealing, merging and indexing."""

    shard_count: int = 8
    compression: str = "none"
    seal_ops: int = 20_000
    seal_bytes: int = 64 << 20
    merge_over: int = 12
    merge_width: int = 4
    index_min_rows: int = 512
    index_m: int = 16
    index_ef_construction: int = 200
    index_ef_search: int = 50


@dataclass(frozen=True)
class Config:
    guardrails: Guardrails = field(default_factory=Guardrails)
    storage: Storage = field(default_factory=Storage)


def load_config(text: str) -> Config:
    """INI-like text with sections guardrails and storage, comments after # or ;, merged into the defaults.

    An unknown key is an error, a value out of range falls back to its default; sections server,
    security and resources concern a service and are skipped.
    """
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), comment_prefixes=("#", ";"), interpolation=None)
    parser.read_string(text)
    made = {}
    for section, kind in (("guardrails", Guardrails), ("storage", Storage)):
        known = {f.name: f for f in fields(kind)}
        values = {}
        for key, raw in parser[section].items() if parser.has_section(section) else ():
            if key not in known:
                raise InvalidArgument(f"unknown key {section}.{key}")
            raw, default = raw.strip().strip("\"'"), known[key].default
            if isinstance(default, bool):
                if raw.lower() not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
                    raise InvalidArgument(f"{section}.{key} isn't a boolean: {raw!r}")
                values[key] = raw.lower() in ("true", "yes", "on", "1")
            elif isinstance(default, int):
                try:
                    n = int(raw.replace("_", ""))
                except ValueError:
                    raise InvalidArgument(f"{section}.{key} isn't a number: {raw!r}") from None
                least = 0 if key == "max_data_dir_bytes" else 2 if key == "index_m" else 1
                values[key] = n if n >= least else default
            else:
                values[key] = compression_name(raw)
        made[section] = kind(**values)
    for section in parser.sections():
        if section not in ("guardrails", "storage", "server", "security", "resources"):
            raise InvalidArgument(f"unknown section {section}")
    return Config(**made)
