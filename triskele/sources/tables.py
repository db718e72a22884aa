"""Tab-separated tables: hits, window traces, selected tasks, and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIT_COLUMNS = ["QueryStart", "QueryEnd", "StartInSeq", "EndInSeq", "Strand", "Rule", "Score"]
STRICT_KEY = ["QueryStart", "QueryEnd", "StartInSeq", "EndInSeq", "Strand", "Rule"]
TASK_COLUMNS = ["fragment_index", "fragment_start_in_seq", "fragment_end_in_seq", "reverse_mode", "parallel_mode", "strand", "rule"]
OPTIONAL_TRACE = ["selective_fallback_selected"]


def read_tsv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Rows by header name, with the file; blank lines and lines from # on are skipped."""
    r = spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("nullValue", "")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.csv(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0))


def read_hits(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Hits with typed key columns and score; fails if one of the seven is missing."""
    rows = read_tsv(spark, path, glob)
    if lost := [c for c in HIT_COLUMNS if c not in rows.columns]:
        raise ValueError(f"hit table lacks {', '.join(lost)}")
    kinds = {c: "double" if c == "Score" else "string" if c == "Strand" else "int" for c in HIT_COLUMNS}
    return rows.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def last_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Window trace: empty fields are null, columns that old files lack are 0, all but strand and reason are integers."""
    rows = read_tsv(spark, path)
    for c in OPTIONAL_TRACE:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit("0"))
    text = ("strand", "reject_reason", "file")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in rows.columns if c not in text})


def read_selected_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns per line without a fixed header; comments, blanks and a header line are skipped; other widths fail."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v != '' and not startswith(v, '#')")
    parts = F.split("v", "\t")
    rows = lines.select(F.when(F.size(parts) == len(TASK_COLUMNS), parts).otherwise(F.raise_error(F.concat(F.lit("a task line needs 7 fields: "), "v"))).alias("p")).filter(F.col("p")[0] != TASK_COLUMNS[0])
    return rows.select(*[F.col("p")[i].cast("string" if c == "strand" else "int").alias(c) for i, c in enumerate(TASK_COLUMNS)])


def read_report(spark: SparkSession, path: str, schema=None, lines: bool = False) -> DataFrame:
    """JSON reports: one document a file, or with ``lines`` one a line."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def explode_runs(reports: DataFrame, runs: str = "runs") -> DataFrame:
    """One row per named run of a report whose runs are a map."""
    return reports.select("*", F.explode(F.map_entries(runs)).alias("entry")).select("*", F.col("entry.key").alias("run"), F.col("entry.value").alias("values")).drop("entry")

#: File-name ends of each output mode.
OUTPUTS = {"full": "*-TFOsorted", "tfosorted": "*-TFOsorted", "lite": "*-TFOsorted.lite"}


def read_outputs(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """The hit tables of an output mode in a folder, by file; fails if there is none."""
    files = spark.read.option("pathGlobFilter", OUTPUTS[mode]).format("binaryFile").load(path).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {OUTPUTS[mode]} in {path}")
    return read_hits(spark, path, OUTPUTS[mode])
