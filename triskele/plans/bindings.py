"""Driver tables seen as sequences, windows, hits and runs. Each binding is one SELECT that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Refine windows of a task (an order): start, end, best and second score, support.
WINDOWS = """
SELECT l_orderkey AS task,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ordinal,
  (l_partkey % 97) * 2 + 1 AS start_j, (l_partkey % 97) * 2 + 1 + l_linenumber * 4 + l_suppkey % 7 AS end_j,
  60 + CAST(l_quantity AS BIGINT) AS best,
  CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN NULL ELSE 60 + CAST(l_quantity AS BIGINT) - l_partkey % 12 END AS second,
  CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN CAST(1 AS BIGINT) ELSE 1 + l_suppkey % 3 END AS support,
  1 + l_suppkey % 6 AS rule, l_returnflag AS strand
FROM lineitem
"""

#: Hits of a task with an identity key, an interval and an integer score.
HITS = """
SELECT l_orderkey AS task, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS strand, l_linestatus AS file,
  (l_partkey % 97) * 2 + 1 + l_suppkey % 5 AS h0, (l_partkey % 97) * 2 + 4 + l_suppkey % 5 + l_linenumber AS h1,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS score
FROM lineitem
"""

#: Hits of an approximate search: four fifths of the rows, some scores moved.
CANDIDATES = """
SELECT task, l_partkey, l_suppkey, line, strand, file, h0, h1, score + (CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 3 - 1 ELSE 0 END) AS score
FROM hits WHERE (task * 7 + line) % 10 < 8
"""

#: Benchmark runs: configurations with wall time and quality measures, all integers.
RUNS = """
SELECT p_partkey AS run, p_brand AS config, p_type AS output, CAST(p_size AS BIGINT) AS topk, CAST(round(p_retailprice * 100) AS BIGINT) AS wall,
  p_partkey % 11 AS recall, p_partkey % 7 AS top_hit FROM part
"""


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "candidates":
        return spark.sql(CANDIDATES.replace("FROM hits", "FROM {hits}"), hits=bound(spark, sf_dir, "hits"))
    text, source = {"windows": (WINDOWS, "lineitem"), "hits": (HITS, "lineitem"), "runs": (RUNS, "part")}[name]
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=read(source))


def with_views(sql: str) -> str:
    """``sql`` with the bindings it mentions as common table expressions, for DuckDB."""
    parts = {"windows": WINDOWS, "hits": HITS, "candidates": CANDIDATES, "runs": RUNS}
    used = [n for n in parts if n in sql or (n == "hits" and "candidates" in sql)]
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = sql.replace("WITH RECURSIVE", "WITH", 1) if recursive else sql
    head = ", ".join(f"{n} AS ({parts[n]})" for n in used)
    if not head:
        return sql
    body = body.strip()
    return f"WITH {recursive}{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {recursive}{head} {body}"
