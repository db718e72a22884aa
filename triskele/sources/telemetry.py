"""``benchmark.key=value`` telemetry as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def typed_value(value: Column, kind: str) -> Column:
    """The value as ``kind``, null where it is not one."""
    return value.try_cast(kind)


def read_telemetry(spark: SparkSession, path: str, prefix: str = "benchmark.") -> DataFrame:
    """run (the file), key, value: lines with the prefix, split at the first equals sign; the last line of a key wins."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("run"), "value", F.monotonically_increasing_id().alias("at"))
    rest = F.expr(f"substring(value, {len(prefix) + 1})")
    lines = lines.filter(F.col("value").startswith(prefix) & F.contains(rest, F.lit("=")))
    pairs = lines.select("run", F.trim(F.substring_index(rest, "=", 1)).alias("key"), F.trim(F.expr(f"substring(value, {len(prefix)} + 1 + instr(substring(value, {len(prefix) + 1}), '='))")).alias("value"), "at")
    return pairs.groupBy("run", "key").agg(F.max_by("value", "at").alias("value"))


def write_telemetry(rows: DataFrame, path: str, prefix: str = "benchmark.") -> None:
    """``rows`` (key, value) as lines of the prefix, the key, an equals sign and the value."""
    rows.select(F.concat(F.lit(prefix), F.col("key"), F.lit("="), F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("value")).write.text(path)
