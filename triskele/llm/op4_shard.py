"""Sharding by extendible hashing.

A document's place is a 60-bit hash prefix of its doc_id. The directory maps prefixes to shards: a
bucket over ``limit`` bytes splits on its next bit, others stay, so shards have prefixes of unequal
depth. Bytes are summed once over cells of a depth a few bits beyond log2(bytes / limit), cell sums
are rolled up to all shorter prefixes, and a cell's shard is its shortest prefix that fits. Only
cells that still don't fit are looked at again, deeper.

A bucket whose rows all have one hash can't be split by its bits (one document above the limit, or
rows that repeat a doc_id). If it holds several rows it splits on further bits, those of a hash of
all columns and of the row's number among equal rows, after a ``+`` in the shard's name, by the same
rule. Equal rows are counted in the map task and dealt out again in chunks, so none of them meet in
one task. Only a single document above the limit is a shard that does not fit.

The directory is broadcast if it has at most ``broadcast_cells`` cells (its rows are counted), and
joined by shuffle beyond. Everything is DataFrame expressions.

Edge cases: null and empty texts count 0 bytes; null doc_ids share one place, as the empty text
does; an empty table has no shards; extra columns are kept (rows that share a doc_id in a bucket
above the limit are grouped by all columns, which can't be maps).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

BITS = 60
LIMIT = 64 << 20
BROADCAST_CELLS = 1 << 20
MARGIN = 3
#: Equal rows that one task deals out again.
CHUNK = 4096


def place(col: str = "doc_id"):
    """The first 60 bits of md5(doc_id as text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h, depth: int):
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int = LIMIT, by: tuple[str, ...] = ()) -> list[tuple[int, DataFrame]]:
    """Per round (depth, cells): cell, shard, depth, bytes, docs, over; ``rows`` has h, bytes. depth is null where a later round decides.

    ``by``: columns that each have a directory of their own.
    """
    by = list(by)
    total = rows.groupBy(*by).agg(F.sum("bytes").alias("t")).agg(F.max("t")).first()[0] or 0
    rounds, low = [], 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + MARGIN)
    rest = rows
    while True:
        cells = rest.groupBy(*by, _prefix(F.col("h"), depth).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        up = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("d")))
        nodes = up.groupBy(*by, "d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = nodes.filter((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        found = (
            up.select(*by, "cell", "d", "prefix").join(fits, [*by, "d", "prefix"], "left")
            .groupBy(*by, "cell").agg(F.min(F.when(F.col("bytes").isNotNull(), F.struct("d", "prefix", "bytes", "docs", (F.col("bytes") > limit).alias("over")))).alias("leaf"))
        )
        found = found.select(
            *by, "cell", F.col("leaf.d").alias("depth"), F.col("leaf.bytes").alias("bytes"), F.col("leaf.docs").alias("docs"), F.col("leaf.over").alias("over"),
            F.when(F.col("leaf.d").isNull(), F.lit(None).cast("string")).otherwise(F.when(F.col("leaf.d") == 0, "").otherwise(F.lpad(F.bin("leaf.prefix"), F.col("leaf.d"), F.lit("0")))).alias("shard"),
        ).checkpoint()
        rounds.append((depth, found))
        if depth >= BITS or found.filter("depth is null").isEmpty():
            return rounds
        open_ = found.filter("depth is null").select(*by, "cell")
        rest = rest.withColumn("cell", _prefix(F.col("h"), depth)).join(open_, [*by, "cell"], "left_semi").select(*by, "h", "bytes")
        low, depth = depth + 1, min(BITS, depth + 8)


LEAF = ("shard", "depth", "bytes", "docs", "over")


def _placed(out: DataFrame, rounds: list[tuple[int, DataFrame]], h: str, leaf: list[str], broadcast_cells: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``out`` with the columns ``leaf``: shard, depth, bytes, docs, over of the row's bucket."""
    cell = fresh([*out.columns, *leaf], "cell")
    have, tries = out.columns, []
    for depth, cells in rounds:
        names: list[str] = []
        for a in LEAF:
            names.append(fresh([*out.columns, *leaf, *names, cell], f"try_{a}"))
        got = cells.select(*[F.col(c) for c in by], F.col("cell").alias(cell), *[F.col(a).alias(n) for a, n in zip(LEAF, names)])
        got = F.broadcast(got) if cells.count() <= broadcast_cells else got
        out = out.withColumn(cell, _prefix(F.col(h), depth)).join(got, [*by, cell], "left").drop(cell)
        tries.append(names)
    return out.select(*have, *[F.coalesce(*[F.col(names[k]) for names in tries]).alias(leaf[k]) for k in range(len(LEAF))])


def sharded(docs: DataFrame, limit: int = LIMIT, broadcast_cells: int = BROADCAST_CELLS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for the shard (its bits, then ``+`` and the bits beyond the hash of doc_id), its depth, bytes and documents, and their names."""
    names: dict[str, str] = {}
    for n in ("shard", "shard_depth", "shard_bytes", "shard_docs", "over", "h", "n_bytes", "equal", "number"):
        names[n] = fresh([*docs.columns, *names.values()], n)
    leaf, h, size, equal, number = [names[n] for n in ("shard", "shard_depth", "shard_bytes", "shard_docs", "over")], *(names[n] for n in ("h", "n_bytes", "equal", "number"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rounds = directory(docs.select(place().alias("h"), length.alias("bytes")), limit)
    out = _placed(docs.withColumn(h, place()), rounds, h, leaf, broadcast_cells)
    if any(not c.filter("over and docs > 1").isEmpty() for _, c in rounds):
        full = F.col(leaf[4]) & (F.col(leaf[3]) > 1)
        sets = out.filter(full).groupBy(*docs.columns, *leaf[:2]).agg(F.count("*").alias(equal))
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col(equal) - 1, F.lit(CHUNK).cast("long"))).alias(number)
        sets = sets.select("*", chunk).repartition(F.xxhash64(*docs.columns, number))
        each = sets.withColumn(number, F.explode(F.sequence(number, F.least(F.col(number) + CHUNK, F.col(equal)) - 1)))
        each = each.withColumn(h, F.shiftrightunsigned(F.xxhash64(*docs.columns, number), 64 - BITS)).withColumn(size, length)
        each = written(each.drop(equal, number), "overflow")
        first = fresh([*each.columns, *LEAF, "cell"], "first")
        deeper = directory(each.select(F.col(leaf[0]).alias(first), F.col(h).alias("h"), F.col(size).alias("bytes")), limit, (first,))
        more = [fresh([*each.columns, first], f"more_{a}") for a in LEAF]
        many = _placed(each.withColumnRenamed(leaf[0], first), deeper, h, more, broadcast_cells, (first,))
        many = many.select(*docs.columns, F.concat(F.col(first), F.lit("+"), F.col(more[0])).alias(leaf[0]), (F.col(leaf[1]) + F.col(more[1])).alias(leaf[1]), F.col(more[2]).alias(leaf[2]), F.col(more[3]).alias(leaf[3]))
        out = out.filter(~full).select(*docs.columns, *leaf[:4]).unionByName(many)
    return out.select(*docs.columns, *leaf[:4]), names


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """One folder of Parquet files per shard under ``path``."""
    out, names = sharded(docs, limit)
    out.repartition(F.col(names["shard"])).write.partitionBy(names["shard"]).parquet(path)


def sql(limit: int = LIMIT) -> str:
    """DuckDB SQL for tables without rows that repeat a doc_id in a bucket above the limit."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
u AS (SELECT r.*, d, h >> (60 - d) AS prefix FROM r, (SELECT unnest(range(0, 61)) AS d)),
n AS (SELECT d, prefix, sum(n_bytes)::BIGINT AS b, count(*) AS c, min(h) = max(h) AS one FROM u GROUP BY 1, 2),
f AS (SELECT u.doc_id, u.h, min(u.d) AS depth FROM u JOIN n USING (d, prefix) WHERE b <= {limit} OR one GROUP BY 1, 2)
SELECT f.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(f.h >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS shard_depth, b AS shard_bytes, c AS shard_docs
FROM f JOIN n ON n.d = f.depth AND n.prefix = f.h >> (60 - f.depth)
"""
