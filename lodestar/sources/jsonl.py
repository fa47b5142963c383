"""JSON lines of `{"key": ..., "embedding": [...]}`: files, or lines typed in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument

MAX_LINE_BYTES = 16 << 20  # fixed value: longest line


def parsed(lines: DataFrame) -> DataFrame:
    """lines (ordinal, value) as (ordinal, key, embedding, problem); blank lines are skipped.

    One typed parse settles a line that has nothing odd about it; only others are looked at closely.
    """
    rows = lines.where(F.trim("value") != "").select("ordinal", "value", F.from_json("value", "key string, embedding array<double>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}).alias("o"))
    values = F.col("o.embedding").cast("array<float>")
    object_like = F.col("value").rlike(r"^\s*\{") & F.col("value").rlike(r"\}\s*$")
    plain = object_like & (F.octet_length("value") <= MAX_LINE_BYTES) & (F.trim("o.key") != "") & (F.size(values) > 0) & _finite(values)
    problem, close = _closely(F.col("value"), object_like)
    sure = F.coalesce(plain, F.lit(False))
    return rows.select("ordinal", F.col("o.key").alias("key"), F.when(sure, values).otherwise(close).alias("embedding"), F.when(sure, F.lit(None)).otherwise(problem).alias("problem"))


def _finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _closely(value: Column, object_like: Column) -> tuple[Column, Column]:
    """What is wrong with a line first (null if nothing is), and its embedding, from the numbers' texts."""
    o = F.from_json(value, "key string, embedding string", {"mode": "PERMISSIVE"})
    parts = F.from_json(o["embedding"], "array<string>")
    number = F.transform(parts, lambda x: F.coalesce(x.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.lit(False)))
    values = F.transform(parts, lambda x: x.try_cast("double").cast("float"))
    problem = (
        F.when(F.octet_length(value) > MAX_LINE_BYTES, F.lit("line is too long"))
        .when(o.isNull() | ~object_like | (o["embedding"].isNull() & o["key"].isNull()), F.lit("line isn't a JSON object"))
        .when(o["key"].isNull() | (F.trim(o["key"]) == ""), F.lit("key is required"))
        .when(parts.isNull() | (F.size(parts) == 0), F.lit("embedding is required"))
        .when(o["embedding"].contains('"') | ~F.forall(number, lambda x: x), F.lit("embedding must hold numbers"))
        .when(~_finite(values), F.lit("embedding must be finite"))
    )
    return problem, values


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order of arrival: file name, then place in the file."""
    t = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("ordinal"))
    return t


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ordinal, key, embedding) of all files at path; the first bad line by order of arrival is an error."""
    rows = parsed(lines_of(spark, path))
    first = rows.where("problem is not null").agg(F.min_by(F.struct("ordinal", "problem"), "ordinal")).first()[0]
    if first is not None:
        raise InvalidArgument(f"{first['ordinal']['file_path']}, from byte {first['ordinal']['file_block_start']}: {first['problem']}")
    return rows.drop("problem")


def read_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Rows of lines typed in, up to one that is `\\end`; errors name the line."""
    taken: list[tuple[int, str]] = []
    for i, line in enumerate(lines, 1):
        if line.strip() == "\\end":
            break
        taken.append((i, line.rstrip("\n")))
    rows = parsed(spark.createDataFrame(taken, "ordinal long, value string"))
    first = rows.where("problem is not null").orderBy("ordinal").first()
    if first is not None:
        raise InvalidArgument(f"line {first['ordinal']}: {first['problem']}")
    return rows.drop("problem")
