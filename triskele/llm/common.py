"""Helpers shared by the operators: shared scratch folder, whole tables, byte classes."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where unset, one is made and set on a local master, and elsewhere this fails."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="triskele-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow filesystem and the path in it, for file:, hdfs:, s3: and plain paths."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def crc_part(col: str, parts: int):
    """crc32 of the column as text, modulo ``parts``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


def fresh(taken, name: str) -> str:
    """``name``, or with underscores appended until no column (case aside) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def split_by(df: DataFrame, key: str, keys: DataFrame, most_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely not among ``keys``, all others); no row is moved. ``keys``: one column, written.

    A bitmap of 16 bits a key, but at most 64 * ``most_words`` bits (a broadcast of some 50 MB). Where
    keys crowd it, more rows are among the others; the caller joins those exactly, so only the
    shuffle of rows that need not move grows.
    """
    word, bits = (fresh([*df.columns, *keys.columns], c) for c in ("bitmap_word", "bitmap_bits"))
    words = 1 << min(max(4, (keys.count() // 4).bit_length()), most_words.bit_length() - 1)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), spot(keys.columns[0]).bitwiseAND(F.lit(63)).cast("int"))
    table = keys.select(F.shiftright(spot(keys.columns[0]), 6).alias(word), one.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = df.withColumn(word, F.shiftright(spot(key), 6)).join(F.broadcast(written(table, "bitmap")), word, "left")
    there = F.coalesce(F.call_function("getbit", F.col(bits), spot(key).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return marked.filter(~there).select(*df.columns), marked.filter(there).select(*df.columns)


def append_arrow(df: DataFrame, column: str, fields, fn) -> DataFrame:
    """``df`` with ``fields`` appended; ``fn`` maps the values of ``column`` of an Arrow batch to their arrays.

    Rows stay where they are: no shuffle, and every other column passes through as Arrow.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields) + list(fields))
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            # Small slices bound memory when texts are long.
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                more = fn(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(list(part.columns) + list(more), schema.names)

    return df.mapInArrow(run, schema)
