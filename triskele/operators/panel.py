"""Operators over panels of tiles and runs: safeguards, roll-ups, counters, orders, comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import share
from .gate import FallbackConfig, GateConfig, SINGLETON_OVERRIDE, blockers, missing_margin_singleton, selective_fallback
from .windows import budget, rank_order

NOT_THERE = 10**18

# ---------------------------------------------------------------- rescue of single windows


def safeguard(trace: DataFrame, task: list[str], config: GateConfig, override: int = SINGLETON_OVERRIDE) -> DataFrame:
    """Windows each safeguard would keep: (strategy, rescued) for every way to rescue single windows without a margin.

    ``all_singletons`` rescues every one at or above ``override``, ``one_singleton`` the first in
    window order, ``one_if_first`` that one only if it is the first of its task. Kept and rescued
    windows are then bounded in number and bp as the gate does.
    """
    able = missing_margin_singleton() & ~F.col("base_keep") & (F.col("best") >= override)
    rows = trace.withColumn("base_keep", F.col("peak_score_ok") & (F.col("support_ok") | F.col("margin_ok") | F.col("strong_score_ok"))).withColumn("able", able)
    first = F.row_number().over(Window.partitionBy(*task).orderBy(*rank_order())) == 1
    nth = F.row_number().over(Window.partitionBy(*task, "able").orderBy(*rank_order())) == 1
    rows = rows.withColumns({"one": F.col("able") & nth, "first": F.col("able") & nth & first})
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(c).alias("rescued")) for n, c in (("all_singletons", "able"), ("one_singleton", "one"), ("one_if_first", "first"))])
    rows = rows.select("*", F.inline(each)).filter("base_keep or rescued")
    key = [*task, "strategy"]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*rank_order())) - 1).filter(F.col("place") < config.max_windows)
    return budget(rows, key, config.max_bp, "place").filter("admitted").drop("base_keep", "able", "one", "first", "admitted", "place")


def disjoint(boxes: DataFrame, task: list[str], most: int) -> DataFrame:
    """Per task at most ``most`` boxes (score, ordinal, lo, hi), best first, none overlapping one taken before. A task's boxes are one array."""
    item = F.struct((-F.col("score")).alias("s"), F.col("ordinal").alias("o"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    kind = "array<struct<s:bigint,o:bigint,lo:bigint,hi:bigint>>"
    taken = F.aggregate(
        F.array_sort(F.collect_list(item)).cast(kind), F.array().cast(kind),
        lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: (k["lo"] <= x["hi"]) & (x["lo"] <= k["hi"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return boxes.groupBy(*task).agg(taken.alias("t")).select(*task, F.explode("t").alias("t")).select(*task, F.col("t.o").alias("ordinal"), (-F.col("t.s")).alias("score"))


def proxy_rows(trace: DataFrame, task: list[str]) -> DataFrame:
    """(task, strategy, row): of the uncovered rejected windows that of largest score times bp, and times support."""
    rows = trace.filter(~F.col("after_gate") & ~F.col("covered"))
    out = []
    for name, mass in (("task_proxy_score_x_bp", F.col("best") * F.col("bp")), ("task_proxy_score_x_support", F.col("best") * F.col("support"))):
        nth = F.row_number().over(Window.partitionBy(*task).orderBy(mass.desc(), *rank_order()))
        out.append(rows.withColumns({"strategy": F.lit(name), "nth": nth}).filter("nth = 1").drop("nth"))
    return out[0].unionByName(out[1])


def dominant_objects(objects: DataFrame, missing: DataFrame, task: list[str]) -> DataFrame:
    """Per task the rule-strand object with most missing top hits, then weight, then count, then window order.

    ``missing``: task, rule, strand, top_n, weight, n.
    """
    rows = objects.join(missing.select(*task, "rule", "strand", F.col("top_n").alias("m_top"), F.col("weight").alias("m_weight"), F.col("n").alias("m_n")), [*task, "rule", "strand"], "left")
    of = lambda c: F.coalesce(c, F.lit(0)).desc()
    nth = F.row_number().over(Window.partitionBy(*task).orderBy(of("m_top"), of("m_weight"), of("m_n"), *rank_order()))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth", "m_top", "m_weight", "m_n")


# ---------------------------------------------------------------- counters and summaries


def all_counters(trace: DataFrame, task: list[str], fallback: FallbackConfig = FallbackConfig()) -> DataFrame:
    """One row: the 18 counters of gate, rescue and fallback."""
    weak = F.col("reject_reason").isin("singleton_missing_margin", "low_support_or_margin")
    rescued = (F.col("reject_reason") == "singleton_rescued") & F.col("after_gate")
    per = trace.groupBy(*task).agg(F.max(rescued.cast("int")).alias("r"))
    gate = trace.agg(
        F.count_if(F.col("reject_reason") == "min_peak_score").alias("rejected_by_peak"), F.count_if(weak & ~F.col("support_ok")).alias("rejected_by_support"),
        F.count_if(weak & ~F.col("margin_ok")).alias("rejected_by_margin"), F.count_if(F.col("reject_reason") == "max_windows").alias("trimmed_by_windows"),
        F.count_if(F.col("reject_reason") == "max_bp").alias("trimmed_by_bp"), F.count_if(rescued).alias("rescued_windows"),
        F.coalesce(F.sum(F.when(rescued, F.col("bp"))), F.lit(0)).cast("bigint").alias("rescued_bp"),
    )
    state = blockers(trace, task, fallback)
    chosen = selective_fallback(trace, task, fallback).filter("selective_fallback_selected")
    picked = chosen.select(*task, F.lit(True).alias("picked"))
    full = state.join(picked, task, "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    kept = F.col("n_kept") > 0
    of = lambda name: F.count_if(kept & (F.col("blocker") == name))
    tasks = full.agg(
        F.count_if("picked").alias("fallback_tasks"), F.count_if(kept).alias("nonempty_tasks"), of("max_kept_windows").alias("nonempty_by_max_kept"),
        of("no_singleton_missing_margin").alias("nonempty_by_no_singleton"), of("singleton_override").alias("nonempty_by_override"), of("covered_by_kept").alias("nonempty_covered"),
        of("score_gap").alias("nonempty_by_gap"), F.count_if(kept & F.col("picked")).alias("nonempty_fallback_tasks"),
    )
    windows = chosen.agg(F.count("*").alias("selected_windows"), F.coalesce(F.sum("bp"), F.lit(0)).cast("bigint").alias("selected_bp"))
    one = lambda d: F.broadcast(d)  # noqa: E731  # each side is one row
    return gate.join(one(per.agg(F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("rescued_tasks")))).join(one(tasks)).join(one(windows))


def discovery(trace: DataFrame, task: list[str], tile: list[str]) -> DataFrame:
    """Per tile: tasks, tasks with windows before and after the gate, status, and whether the tile is predicted to be skipped."""
    per = trace.groupBy(*tile, *task).agg(F.count("*").alias("before"), F.count_if("after_gate").alias("after"))
    out = per.groupBy(*tile).agg(
        F.count("*").alias("tasks"), F.count_if(F.col("before") > 0).alias("tasks_before"), F.count_if(F.col("after") > 0).alias("tasks_after"),
        F.sum("before").alias("windows_before"), F.sum("after").alias("windows_after"),
    )
    status = F.when(F.col("tasks_before") == 0, "empty").otherwise("ok")
    return out.withColumns({"status": status, "predicted_skip": (status == "ok") & (F.col("tasks_before") > 0) & (F.col("tasks_after") == 0)})


def metric_summary(rows: DataFrame, group: list[str], metrics: list[str], empty: float | None = 0.0) -> DataFrame:
    """Count, and mean and minimum of each metric per group; ``empty`` (or null) where a metric has no value."""
    fill = lambda c: c if empty is None else F.coalesce(c, F.lit(empty))
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        *[x for m in metrics for x in (fill(F.try_divide(F.sum(m).cast("double"), F.count(m))).alias(f"mean_{m}"), fill(F.min(m).cast("double")).alias(f"min_{m}"))],
    )


def score_summary(rows: DataFrame, score: str = "score", group: list[str] | None = None) -> DataFrame:
    """Count, minimum, maximum and mean; all but the count null without a row."""
    return rows.groupBy(*(group or [])).agg(F.count(score).alias("n"), F.min(score).alias("least"), F.max(score).alias("largest"), F.try_divide(F.sum(score).cast("double"), F.count(score)).alias("mean"))


def panel_shares(per_tile: DataFrame, classes: list[str]) -> DataFrame:
    """Counts and weights (class, n, weight) of all tiles added up, zero-filled, with shares computed after adding."""
    domain = F.broadcast(per_tile.sparkSession.createDataFrame([(c,) for c in classes], "class string"))
    sums = per_tile.groupBy("class").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    total = F.broadcast(per_tile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weight")))
    n, w = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("weight", F.lit(0)).cast("bigint")
    return domain.join(sums, "class", "left").join(total).select("class", n.alias("n"), w.alias("weight"), share(n, F.col("all_n")).alias("n_share"), share(w, F.col("all_weight")).alias("weight_share"))


def class_weights(rows: DataFrame, classes: list[str], reference_weight: DataFrame, weight: str = "score") -> DataFrame:
    """Weight of each class, as a share of all missing weight and of the reference's whole weight (one row: total)."""
    domain = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in classes], "class string"))
    per = rows.groupBy("class").agg(F.sum(weight).cast("bigint").alias("w"))
    both = F.broadcast(rows.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("missing"))).join(F.broadcast(reference_weight.select(F.col("total"))))
    w = F.coalesce("w", F.lit(0)).cast("bigint")
    return domain.join(per, "class", "left").join(both).select("class", w.alias("weight"), share(w, F.col("missing")).alias("share_of_missing"), share(w, F.col("total")).alias("share_of_reference"))


def metric_sums(rows: DataFrame, group: list[str], metrics: list[str], label: str, identity: str = "disabled") -> DataFrame:
    """Sums of metrics over tasks, and the label they share (``identity`` aside) or ``mixed``."""
    from .replay import merged_label

    return rows.groupBy(*group).agg(*[F.sum(m).cast("bigint").alias(m) for m in metrics], merged_label(F.col(label), identity).alias(label))


def length_bins(rows: DataFrame, length: Column, edges: tuple[int, ...] = (8192, 65535)) -> DataFrame:
    """Tasks and bp of targets up to each edge, and beyond the last."""
    kind = F.lit(f"gt_{edges[-1]}")
    for e in reversed(edges):
        kind = F.when(length <= e, f"le_{e}").otherwise(kind)
    return rows.groupBy(kind.alias("bin")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("bp"))


def digest(rows: DataFrame, group: list[str], columns: list[str], least: str) -> DataFrame:
    """Order-free digest of rows: count, least value, and sums and exclusive ors of two halves of a hash of each row."""
    h = F.md5(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    r = rows.withColumns({"a": half(1), "b": half(9)})
    return r.groupBy(*group).agg(
        F.count("*").alias("n"), F.min(least).alias("least"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.bit_xor("a").alias("xor_a"), F.bit_xor("b").alias("xor_b"),
    )


# ---------------------------------------------------------------- two runs compared


def transitions(base: DataFrame, cand: DataFrame, key: list[str], label: str) -> DataFrame:
    """How often tiles go from one label to another: transition (``a->b``), n."""
    j = base.select(*key, F.col(label).alias("a")).join(cand.select(*key, F.col(label).alias("b")), key)
    return j.groupBy(F.concat_ws("->", "a", "b").alias("transition")).agg(F.count("*").alias("n"))


def gate_value(deferred: DataFrame, gated: DataFrame, key: list[str]) -> DataFrame:
    """Per tile what the gate was worth: skip_created, threshold_work_reduced, window_work_reduced, refine_bp_reduced."""
    j = gated.join(deferred.select(*key, F.col("threshold_invoked").alias("d_invoked"), F.col("refine_total_bp").alias("d_bp")), key)
    return j.select(
        *key, (F.col("skipped_after_gate") > 0).alias("skip_created"), (F.col("threshold_invoked") < F.col("d_invoked")).alias("threshold_work_reduced"),
        (F.col("windows_after") < F.col("windows_before")).alias("window_work_reduced"), (F.col("refine_total_bp") < F.col("d_bp")).alias("refine_bp_reduced"),
    )


def batch_reason(query_length: Column, target_length: Column, least: Column, most: int = 8192) -> Column:
    """The first reason against a batch: ``eligible`` without one."""
    return (
        F.when((query_length <= 0) | (query_length > most), F.lit(f"query_gt_{most}")).when(target_length <= 0, "empty_target").when(target_length > most, f"target_gt_{most}")
        .when(least < 0, "negative_min_score").otherwise("eligible")
    )


def common_tasks(base: DataFrame, rescue: DataFrame, key: list[str]) -> DataFrame:
    """Tasks that both traces have by all of ``key``, where the first keeps a window: n_base and n_rescue windows."""
    a = base.groupBy(*key).agg(F.count("*").alias("n_base"), F.max(F.col("after_gate").cast("int")).alias("kept")).filter("kept = 1").drop("kept")
    return a.join(rescue.groupBy(*key).agg(F.count("*").alias("n_rescue")), key)


#: What makes two windows of a task the same.
WINDOW = ["start_j", "end_j", "best", "second", "support"]


def added_windows(base: DataFrame, rescue: DataFrame, task: list[str]) -> DataFrame:
    """Windows the second trace keeps and the first does not, by task, bounds, scores and support (nulls are equal)."""
    a, b = (d.filter("after_gate").select(*task, *WINDOW).distinct() for d in (base, rescue))
    same = [F.col(f"r.{c}") == F.col(f"b.{c}") for c in task] + [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in WINDOW]
    return b.alias("r").join(a.alias("b"), same, "left_anti")


def difference_examples(m: DataFrame, key: list[str], tolerance: float = 1e-6, most: int = 10) -> DataFrame:
    """The first keys by order of each kind of difference: missing_in_candidate, missing_in_reference, score_changed. ``m`` as ``compare.matched`` gives it."""
    kind = (
        F.when(F.col("cand_score").isNull(), "missing_in_candidate").when(F.col("ref_score").isNull(), "missing_in_reference")
        .when(F.abs(F.col("cand_score") - F.col("ref_score")) > tolerance, "score_changed")
    )
    rows = m.withColumn("kind", kind).filter("kind is not null")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(*key))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most)


def difference(a: DataFrame, b: DataFrame, key: list[str], ordinal: str, score: str = "score", tolerance: float = 1e-6) -> DataFrame:
    """One row: none if both have the same rows in the same order, ordering_or_format_only if as multisets, else content_diff; and whether scores agree within ``tolerance`` key by key."""
    cols = [*key, score]
    once = lambda d: d.select(*cols, ordinal).groupBy(*cols, ordinal).agg(F.count("*").alias("n"))
    ordered = once(a).withColumnRenamed("n", "na").join(once(b).withColumnRenamed("n", "nb"), [*cols, ordinal], "full_outer")
    odd = ordered.agg(F.count_if(~F.col("na").eqNullSafe(F.col("nb"))).alias("odd"))
    bag = lambda d, n: d.groupBy(*cols).agg(F.count("*").alias(n))
    bags = bag(a, "na").join(bag(b, "nb"), cols, "full_outer").agg(F.count_if(~F.col("na").eqNullSafe(F.col("nb"))).alias("odd_bag"))
    best = lambda d, n: d.groupBy(*key).agg(F.max(score).alias(n))
    far = best(a, "sa").join(best(b, "sb"), key, "full_outer").agg(F.count_if(F.coalesce(F.abs(F.col("sa") - F.col("sb")) > tolerance, F.lit(True))).alias("far"))
    return odd.join(F.broadcast(bags)).join(F.broadcast(far)).select(
        F.when(F.col("odd") == 0, "none").when(F.col("odd_bag") == 0, "ordering_or_format_only").otherwise("content_diff").alias("difference"), (F.col("far") == 0).alias("tolerant_equal"),
    )


# ---------------------------------------------------------------- orders


def order_by(kind: str) -> list[Column]:
    """Orders of tasks, tiles, runs and candidates; what is missing comes last, names decide ties."""
    c, gap = F.col, F.coalesce("score_gap", F.lit(NOT_THERE))
    best = F.when(c("best_rejected").isNull(), F.lit(NOT_THERE)).otherwise(-c("best_rejected"))
    return {
        "ambiguity": lambda: [c("missing_top10").desc(), c("missing_weight").desc(), c("n_rejected").desc(), gap, c("tile"), c("task")],
        "rescue_gain": lambda: [c("top5_gain").desc(), c("top10_gain").desc(), c("weight_gain").desc(), c("added_bp"), c("tile"), c("task")],
        "sparse_gap": lambda: [(c("band_ge85") + c("band_80_84") + c("band_75_79")).desc(), best, gap, c("rejected_bp").desc(), c("n_kept"), c("tile"), c("task")],
        "support_pressure": lambda: [c("n_low_support").desc(), (c("bin_support2") + c("bin_support3plus")).desc(), best, gap, c("n_rejected").desc(), c("rejected_bp").desc(), c("tile"), c("task")],
        "score_mass": lambda: [c("top3_sum").desc(), c("score_x_bp").desc(), gap, best, c("by_best"), c("by_mass"), c("tile"), c("task")],
        "support_reason": lambda: [
            (2 * c("bin_support3plus") + c("bin_support2")).desc(), c("low_support_bp").desc(), c("score_x_support").desc(), c("entropy_milli").desc(), gap, c("by_mass"), c("tile"), c("task"),
        ],
        "configuration": lambda: [c("mean_wall"), c("min_top_hit").desc(), c("min_recall").desc(), c("topk"), c("suppress_bp")],
        "tile": lambda: [c("anchor"), c("kind"), c("bucket_bp"), c("nth"), c("start_bp"), c("end_bp"), c("path")],
        "discovery": lambda: [c("predicted_skip").cast("int").desc(), (c("windows_before") - c("windows_after")).desc(), c("windows_before").desc(), c("hits").desc(), c("start_bp")],
        "candidate": lambda: [c("passes").cast("int").desc(), c("delta_top10").desc(), c("delta_weighted").desc(), c("delta_bp"), c("jaccard").desc(), c("name")],
    }[kind]()


def ranked_by(rows: DataFrame, kind: str, group: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in one of the orders."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by(kind))))


def first_per_task(hits: DataFrame, task: list[str], most: int = 50) -> DataFrame:
    """The best ``most`` hits of each task, by score, then start and end."""
    nth = F.row_number().over(Window.partitionBy(*task).orderBy(F.col("score").desc(), "start_j", "end_j"))
    return hits.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def length_batches(rows: DataFrame, length: str, key: str, most: int = 256) -> DataFrame:
    """Batches of one length: rows in order of ``key``, ``most`` each."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(length).orderBy(key)) - 1) / most))


def mergeable_calls(calls: DataFrame, by: list[str], order: str, shape: list[str]) -> DataFrame:
    """Per worker: calls, and how many follow a call of the same shape (they could have been one batch)."""
    same = F.lit(True)
    w = Window.partitionBy(*by).orderBy(order)
    for c in shape:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    follows = F.lag(order).over(w).isNotNull()
    return calls.withColumn("merge", (same & follows).cast("bigint")).groupBy(*by).agg(F.count("*").alias("calls"), F.sum("merge").alias("mergeable"))


def bisected(length: Column) -> Column:
    """A length as its two halves, the larger second; empty parts are left out."""
    return F.filter(F.array(F.floor(length / 2).cast("bigint"), (length - F.floor(length / 2)).cast("bigint")), lambda x: x > 0)


def workers(index: Column, slots: int) -> tuple[Column, Column]:
    """(device, slot) of a worker: all slots of a device, then the next device."""
    slots = max(1, slots)
    return F.floor(index / slots), index % slots
