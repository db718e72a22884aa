"""FASTA files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, record (0-based in the file), header, seq. A record is read as one row, so files split at records."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    body = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^>", "")
    rows = text.select("file", "at", F.regexp_extract(body, r"\A([^\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace(body, r"\A[^\n]*", ""), r"\s", "").alias("seq"))
    return rows.filter((F.col("header") != "") | (F.col("seq") != ""))


def parse_dna_header(header: Column) -> dict[str, Column]:
    """species|chr|start-end with fallbacks: a missing bar leaves the species only, a missing or bad start is 1."""
    parts = F.split(header, r"\|")
    start = F.get(F.split(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "-"), F.lit(0)).try_cast("bigint")
    return {"species": F.get(parts, F.lit(0)), "chr": F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "start_genome": F.coalesce(start, F.lit(1).cast("bigint"))}


def read_dna(spark: SparkSession, path: str) -> DataFrame:
    rows = read_fasta(spark, path)
    return rows.withColumns(parse_dna_header(F.col("header")))


def read_query(spark: SparkSession, path: str) -> DataFrame:
    """query_name (the header without >), query_seq."""
    return read_fasta(spark, path).select(F.replace("header", F.lit(">"), F.lit("")).alias("query_name"), F.col("seq").alias("query_seq"))


def single_record(rows: DataFrame) -> DataFrame:
    """``rows`` if it has exactly one record, else an error."""
    n = len(rows.limit(2).collect())
    if n != 1:
        raise ValueError(f"expected one FASTA record, found {'none' if n == 0 else 'several'}")
    return rows


def base_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.sum(F.length("seq")).alias("bases"))


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Text files of records (header, seq) with lines of ``width`` bases."""
    rows.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.text(path)


def tiled_records(spark: SparkSession, seq: str, records: int, species: str = "tile", chr_: str = "chr1") -> DataFrame:
    """``records`` copies of a sequence as records with consecutive coordinates, for throughput runs."""
    n = len(seq)
    at = F.col("id") * n + 1
    return spark.range(records).select(F.format_string(f"{species}|{chr_}|%d-%d", at, at + n - 1).alias("header"), F.lit(seq).alias("seq"))
