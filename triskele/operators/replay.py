"""Replay strategies over rejected windows, post-hit autopsy, recommendations, box overlap and batch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import score_band
from .attribution import containment_join
from .windows import rank_order

STRATEGIES = {
    "dominant": lambda: F.lit(True),
    "ge85": lambda: score_band(F.col("best")) == "ge85",
    "band_80_84": lambda: score_band(F.col("best")) == "80_84",
    "band_75_79": lambda: score_band(F.col("best")) == "75_79",
}


def replay(trace: DataFrame, task: list[str], strategies: dict | None = None) -> DataFrame:
    """(task, strategy, row): the rejected window each strategy would add, first in window order among those it admits.

    One pass over the rejected rows: a row is repeated once per strategy that admits it.
    """
    found = strategies or STRATEGIES
    names = F.array_compact(F.array(*[F.when(cond(), F.lit(name)) for name, cond in found.items()]))
    rows = trace.filter("not after_gate").withColumn("strategy", F.explode(names))
    nth = F.row_number().over(Window.partitionBy(*task, "strategy").orderBy(*rank_order()))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


def rule_strand_objects(trace: DataFrame, task: list[str]) -> DataFrame:
    """Per task, rule and strand: the rejected windows' count, bp and the first in window order, ranked by that first."""
    rows = trace.filter("not after_gate")
    nth = F.row_number().over(Window.partitionBy(*task, "rule", "strand").orderBy(*rank_order()))
    per = rows.withColumn("nth", nth)
    first = per.filter("nth = 1")
    sums = rows.groupBy(*task, "rule", "strand").agg(F.count("*").alias("n"), F.sum("bp").cast("bigint").alias("total_bp"))
    return first.join(sums, [*task, "rule", "strand"]).withColumn("object_rank", F.row_number().over(Window.partitionBy(*task).orderBy(*rank_order()))).drop("nth")


def autopsy(hits: DataFrame, trace: DataFrame, keys: list[str], hit_id: list[str]) -> DataFrame:
    """Per hit: survived_gate_missing_downstream if a kept window holds it, rejected_by_gate if only rejected ones do, else none."""
    inside = containment_join(hits.select(*dict.fromkeys([*keys, *hit_id, "h0", "h1"])), trace.select(*keys, "start_j", "end_j", "after_gate"), keys)
    best = inside.groupBy(*hit_id).agg(F.max(F.col("after_gate").cast("int")).alias("kept"))
    return hits.join(best, hit_id, "left").withColumn("autopsy", F.when(F.col("kept") == 1, "survived_gate_missing_downstream").when(F.col("kept") == 0, "rejected_by_gate").otherwise("none")).drop("kept")


def recommend(classes: DataFrame, name: str, weight: str) -> DataFrame:
    """The class of largest total weight; ties go to the name first in order."""
    per = classes.groupBy(name).agg(F.sum(weight).cast("bigint").alias("weight"), F.count("*").alias("n"))
    return per.orderBy(F.col("weight").desc(), name).limit(1)


def merged_label(label: Column, identity: str = "disabled") -> Column:
    """An aggregate: the label all rows share, ``identity`` rows aside; ``mixed`` if they differ."""
    live = F.when(label != identity, label)
    return F.when(F.min(live).isNull(), identity).when(F.min(live) == F.max(live), F.min(live)).otherwise("mixed")


def overlapping_boxes(a: DataFrame, b: DataFrame, keys: list[str], band: int = 64) -> DataFrame:
    """Pairs of boxes (a_row0, a_row1, a_col0, a_col1 and b_...) that share a cell.

    Boxes are spread over bands of rows; a pair is reported in the first band both touch, so nothing
    has to be de-duplicated.
    """
    spread = lambda d, p: d.withColumn("band", F.explode(F.sequence(F.floor(F.col(f"{p}_row0") / band), F.floor(F.col(f"{p}_row1") / band))))
    first = F.greatest(F.floor(F.col("a_row0") / band), F.floor(F.col("b_row0") / band))
    meet = (F.col("a_row0") <= F.col("b_row1")) & (F.col("b_row0") <= F.col("a_row1")) & (F.col("a_col0") <= F.col("b_col1")) & (F.col("b_col0") <= F.col("a_col1"))
    return spread(a, "a").join(spread(b, "b"), [*keys, "band"]).filter(meet & (F.col("band") == first)).drop("band")


def batches(rows: DataFrame, length: str, key: str, width: int = 256, most: int = 32) -> DataFrame:
    """Batches of similar length: rows in (length, key) order within a rounded length, ``most`` each, and whether padding stays within a tenth."""
    shaped = rows.withColumn("shape", F.ceil(F.col(length) / width) * width)
    nth = F.row_number().over(Window.partitionBy("shape").orderBy(length, key))
    out = shaped.withColumn("batch", F.floor((nth - 1) / most))
    per = out.groupBy("shape", "batch").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(length).alias("total"))
    return per.withColumn("padded", (F.col("longest") * F.col("n") - F.col("total")) * 10 <= F.col("longest") * F.col("n"))
