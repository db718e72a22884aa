"""Refine windows: intervals with scores in a task. Frames have task columns plus ordinal, start_j, end_j, best, second, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import margin, window_bp


def padded(hits: DataFrame, length: Column | int, pad: int) -> DataFrame:
    """Hits (start_j, end_j, score) as windows padded within [1, length]; inverted ones are dropped."""
    length = F.lit(length) if isinstance(length, int) else length
    out = hits.withColumns({
        "start_j": F.greatest(F.col("start_j") - pad, F.lit(1)), "end_j": F.least(F.col("end_j") + pad, length),
        "best": F.col("score").cast("bigint"), "second": F.lit(None).cast("bigint"), "support": F.lit(1).cast("bigint"),
    })
    return out.filter("start_j <= end_j")


def merge(windows: DataFrame, task: list[str], gap: int = 0) -> DataFrame:
    """Windows joined while the next starts at most ``gap`` + 1 past the running end.

    best and second are the two largest of all bests and seconds of a group, support is their sum. A
    group's scores are kept as two numbers, so no list grows.
    """
    order = Window.partitionBy(*task).orderBy("start_j", "end_j", "ordinal")
    reach = F.max("end_j").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("new", F.coalesce((F.col("start_j") > reach + gap + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Two largest of the multiset: the largest best, and the larger of the next best (with repeats) and the largest second.
    by = Window.partitionBy(*task, "part").orderBy(F.col("best").desc(), "start_j", "end_j", "ordinal")
    marked = marked.withColumn("nth", F.row_number().over(by))
    return (
        marked.groupBy(*task, "part").agg(
            F.min("start_j").alias("start_j"), F.max("end_j").alias("end_j"), F.max("best").alias("best"),
            F.greatest(F.max(F.when(F.col("nth") == 2, F.col("best"))), F.max("second")).alias("second"), F.sum("support").cast("bigint").alias("support"),
        )
        .withColumnRenamed("part", "ordinal")
    )


def rank_order() -> list[Column]:
    """Best, support and margin descending (no margin last), then start, end and the original order."""
    return [F.col("best").desc(), F.col("support").desc(), margin(F.col("best"), F.col("second")).desc_nulls_last(), F.col("start_j"), F.col("end_j"), F.col("ordinal")]


def ranked(windows: DataFrame, task: list[str], name: str = "rank") -> DataFrame:
    """0-based rank in the task."""
    return windows.withColumn(name, F.row_number().over(Window.partitionBy(*task).orderBy(*rank_order())) - 1)


def top(windows: DataFrame, task: list[str], n: int) -> DataFrame:
    return ranked(windows, task).filter(F.col("rank") < n)


def admitted(rows: Column, cap: int) -> Column:
    """Of an array of (r, b) the r of those that fit under ``cap``, in their order, when one that does not fit is skipped."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["b"] > 0) & (acc["total"] + x["b"] <= cap)
        return F.struct(
            F.when(fits, acc["total"] + x["b"]).otherwise(acc["total"]).alias("total"),
            F.when(fits, F.concat(acc["taken"], F.array(x["r"].cast("int")))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(F.array_sort(rows), start, step)["taken"]


def budget(ranked: DataFrame, task: list[str], cap: int, rank: str = "rank", bp: str = "bp") -> DataFrame:
    """``ranked`` with ``admitted``: in rank order, a row is taken if it still fits under ``cap``, else skipped.

    A running sum would count skipped rows, so the choice is a fold over the task's rows in rank
    order. Callers bound the rows of a task (top-N) first.
    """
    rows = F.collect_list(F.struct(F.col(rank).alias("r"), F.col(bp).cast("bigint").alias("b")))
    taken = ranked.groupBy(*task).agg(admitted(rows, cap).alias("taken"))
    return ranked.join(taken, task).withColumn("admitted", F.array_contains("taken", F.col(rank).cast("int"))).drop("taken")


def suppress(peaks: DataFrame, task: list[str], distance: int, floor: int | None = None) -> DataFrame:
    """Non-maximum suppression of (score, position): by score, then position, a peak stays if no kept one is nearer than ``distance``."""
    live = peaks.filter(F.col("position") >= 0)
    if floor is not None:
        live = live.filter(F.col("score") > floor)
    rows = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("position").alias("p"))))
    kept = F.aggregate(
        rows, F.array().cast("array<struct<s:bigint,p:bigint>>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k["p"] - x["p"]) < distance), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["s"].cast("bigint").alias("s"), x["p"].cast("bigint").alias("p"))))
        ),
    )
    out = live.groupBy(*task).agg(kept.alias("kept")).select(*task, F.explode("kept").alias("k"))
    return out.select(*task, (-F.col("k.s")).alias("score"), F.col("k.p").alias("position"))


def islands(rows: DataFrame, by: list[str], position: str, gap: int = 1, same: list[str] | None = None, value: str = "score") -> DataFrame:
    """Runs of neighbouring positions (step at most ``gap``, equal ``same`` columns): bounds, size, and the first largest value."""
    same = same or []
    order = Window.partitionBy(*by).orderBy(position)
    near = F.col(position) - F.lag(position).over(order) <= gap
    for c in same:
        near = near & F.col(c).eqNullSafe(F.lag(c).over(order))
    run = F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).groupBy(*by, "run", *same).agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"), F.max(value).alias("peak"),
        F.max_by(position, F.struct(F.col(value), -F.col(position))).alias("peak_at"),
    )


def drop_neighbours(rows: DataFrame, task: list[str]) -> DataFrame:
    """Sorted by start, end, score (descending): drop a row equal to the last kept one, or inside it with a score not above it."""
    arr = F.array_sort(F.collect_list(F.struct("start_j", "end_j", (-F.col("score")).alias("s"))))
    empty = F.array().cast("array<struct<start_j:bigint,end_j:bigint,s:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        inside = (F.size(acc) > 0) & (last["start_j"] <= x["start_j"]) & (last["end_j"] >= x["end_j"]) & (-last["s"] >= -x["s"])
        item = F.struct(x["start_j"].cast("bigint").alias("start_j"), x["end_j"].cast("bigint").alias("end_j"), x["s"].cast("bigint").alias("s"))
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(item)))

    out = rows.groupBy(*task).agg(F.aggregate(arr, empty, step).alias("kept")).select(*task, F.explode("kept").alias("k"))
    return out.select(*task, "k.start_j", "k.end_j", (-F.col("k.s")).alias("score"))


def total_bp(windows: DataFrame, task: list[str]) -> DataFrame:
    return windows.groupBy(*task).agg(F.sum(window_bp(F.col("start_j"), F.col("end_j"))).cast("bigint").alias("bp"))


def candidate_states(runs: DataFrame, start: list[str]) -> DataFrame:
    """Run summaries to one candidate per start: largest score (first run wins ties) and bounding box."""
    first = F.struct(F.col("score"), -F.col("ordinal"))
    return runs.groupBy(*start).agg(
        F.max("score").alias("score"), F.max_by("end_i", first).alias("end_i"), F.max_by("score_end_j", first).alias("end_j"),
        F.min("end_i").alias("top"), F.max("end_i").alias("bottom"), F.min("min_end_j").alias("left"), F.max("max_end_j").alias("right"),
    )
