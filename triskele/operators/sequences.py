"""Fragments, rules and tasks: the front of a triplex search as a logical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S


def fragments(records: DataFrame, seq: str = "seq", cut: int = 5000, overlap: int = 100, start: str = "fragment_start") -> DataFrame:
    """One row per overlapping fragment: fragment_index, start (0-based), fragment; starts step by cut - overlap while inside."""
    if cut <= overlap:
        raise ValueError("the cut length must exceed the overlap")
    step = cut - overlap
    rows = records.filter(F.length(seq) > 0)
    starts = F.sequence(F.lit(0), F.length(seq) - 1, F.lit(step))
    out = rows.select("*", F.posexplode(starts).alias("fragment_index", start))
    return out.withColumn("fragment", F.substring(F.col(seq), F.col(start) + 1, F.lit(cut))).drop(seq)


def rules(spark: SparkSession) -> DataFrame:
    """parallel, rule, reverse, image: 48 rows whatever the data."""
    rows = []
    for parallel, forward, back in ((1, S.PARALLEL_FORWARD, S.PARALLEL_REVERSE), (-1, S.ANTIPARALLEL_FORWARD, S.ANTIPARALLEL_REVERSE)):
        for k, (f, b) in enumerate(zip(forward, back), start=1):
            rows += [(parallel, k, 0, f), (parallel, k, 1, b)]
    return spark.createDataFrame(rows, "parallel int, rule int, reverse int, image string")


def select_rules(table: DataFrame, rule: int = 0, strand: int = 0) -> DataFrame:
    """strand >= 0 takes parallel rules, <= 0 antiparallel ones; rule 0 takes all of them."""
    keep = F.lit(False)
    if strand >= 0:
        keep = keep | (F.col("parallel") == 1)
    if strand <= 0:
        keep = keep | (F.col("parallel") == -1)
    return table.filter(keep & ((F.lit(rule) == 0) | (F.col("rule") == rule)))


def tasks(fragments: DataFrame, rule: int = 0, strand: int = 0) -> DataFrame:
    """Fragments times the chosen rules and readings, homopolymers left out; the rule table has 48 rows, so it is broadcast."""
    table = select_rules(rules(fragments.sparkSession), rule, strand)
    live = fragments.filter(~S.is_homopolymer(F.col("fragment")))
    out = live.join(F.broadcast(table))
    return out.withColumn("strand", S.strand_label(F.col("reverse"), F.col("parallel"))).withColumn("target", target(F.col("fragment"), F.col("image"), F.col("reverse")))


def target(fragment: Column, image: Column, reverse: Column) -> Column:
    """The string that is aligned: rule-transformed, and reversed where the reading is."""
    mapped = S.apply_map(fragment, image)
    return F.when(reverse == 1, F.reverse(mapped)).otherwise(mapped)


def source(fragment: Column, strand: Column) -> Column:
    """The string whose bases decide stability, per strand."""
    return (
        F.when(strand == "ParaPlus", fragment).when(strand == "ParaMinus", S.source_transform(fragment, "reverse_complement"))
        .when(strand == "AntiPlus", S.source_transform(fragment, "complement")).when(strand == "AntiMinus", S.source_transform(fragment, "reverse"))
    )


def select_tasks(tasks: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Only the tasks named in ``chosen`` by all ``keys``."""
    return tasks.join(chosen.select(*keys), keys, "left_semi")


def tile_starts(length: Column, size: int, stride: int) -> Column:
    """1, 1 + stride, ... and a last tile that ends with the sequence, without repeats."""
    last = length - size + 1
    return F.when(length <= size, F.array(F.lit(1).cast("bigint"))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")), F.array(last.cast("bigint"))))
    )


def shard(seq: Column, start: Column, length: Column) -> Column:
    """1-based inclusive cut; fails past the end."""
    return F.when(start + length - 1 > F.length(seq), F.raise_error(F.lit("shard passes the end of the sequence"))).otherwise(F.substring(seq, start.cast("int"), length.cast("int")))


def genome_coordinates(hits: DataFrame) -> DataFrame:
    """Direction, genome interval and midpoint of hits with start_in_seq, end_in_seq, start_genome."""
    lo, hi = F.least("start_in_seq", "end_in_seq"), F.greatest("start_in_seq", "end_in_seq")
    return hits.withColumns({
        "direction": F.when(F.col("start_in_seq") < F.col("end_in_seq"), "R").otherwise("L"),
        "start_in_genome": lo + F.col("start_genome") - 1, "end_in_genome": hi + F.col("start_genome") - 1,
        "midpoint": F.expr("(start_in_seq + end_in_seq) div 2"),
    })


def good_hits(hits: DataFrame, score: float = 0, identity: float = 60.0, stability: float = 1.0, least_nt: int | None = None) -> DataFrame:
    """Score, identity and stability at or above their minima; identity and stability compare as 32-bit floats."""
    keep = (F.col("score") >= score) & (F.col("identity").cast("float") >= F.lit(identity).cast("float")) & (F.col("stability").cast("float") >= F.lit(stability).cast("float"))
    return hits.filter(keep if least_nt is None else keep & (F.col("nt") >= least_nt))
