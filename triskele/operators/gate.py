"""The window gate: keep, reject with a reason, rescue, and bound the windows of each task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import margin, window_bp
from .windows import admitted, budget, rank_order

SINGLETON_OVERRIDE = 85


@dataclass(frozen=True)
class GateConfig:
    mode: str = "v1"  # off, v1 or v2
    min_peak: int = 80
    min_support: int = 2
    min_margin: int = 6
    strong: int = 100
    max_windows: int = 8
    max_bp: int = 32768


@dataclass(frozen=True)
class FallbackConfig:
    max_kept: int = 1
    max_gap: int = 6
    band_75_79: bool = False


def missing_margin_singleton() -> Column:
    return (F.col("support") == 1) & F.col("second").isNull()


def gate(windows: DataFrame, task: list[str], config: GateConfig = GateConfig()) -> DataFrame:
    """Every window with its flags, after_gate and reject_reason (``kept`` where nothing speaks against it).

    Windows are dealt out by task once; every step then stays where a task's windows are.
    """
    m = margin(F.col("best"), F.col("second"))
    out = (windows if config.mode == "off" else windows.repartition(*task)).withColumns({
        "margin": m, "bp": window_bp(F.col("start_j"), F.col("end_j")), "peak_score_ok": F.col("best") >= config.min_peak,
        "support_ok": F.col("support") >= config.min_support, "margin_ok": F.coalesce(m >= config.min_margin, F.lit(False)), "strong_score_ok": F.col("best") >= config.strong,
    })
    if config.mode == "off":
        return out.withColumns({"after_gate": F.lit(True), "reject_reason": F.lit("kept"), "sorted_rank": F.lit(None).cast("int")})
    weak = ~(F.col("support_ok") | F.col("margin_ok") | F.col("strong_score_ok"))
    reason = (
        F.when(~F.col("peak_score_ok"), "min_peak_score").when(weak & missing_margin_singleton(), "singleton_missing_margin")
        .when(weak, "low_support_or_margin").otherwise("kept")
    )
    out = out.withColumn("reason", reason)
    if config.mode == "v2":
        able = (F.col("reason") == "singleton_missing_margin") & (F.col("best") >= SINGLETON_OVERRIDE)
        nth = F.row_number().over(Window.partitionBy(*task, able).orderBy(F.col("best").desc(), "ordinal"))
        out = out.withColumn("reason", F.when(able & (nth == 1), "singleton_rescued").otherwise(F.col("reason")))
    passed = F.col("reason").isin("kept", "singleton_rescued")
    rank = F.row_number().over(Window.partitionBy(*task, passed).orderBy(*rank_order())) - 1
    out = out.withColumn("sorted_rank", F.when(passed, rank))
    in_top = passed & (F.col("sorted_rank") < config.max_windows) if config.max_windows >= 0 else passed
    out = out.withColumn("reason", F.when(passed & ~in_top, "max_windows").otherwise(F.col("reason"))).withColumn("in_top", in_top)
    if config.max_bp >= 0 and config.max_windows >= 0:
        taken = F.collect_list(F.when(F.col("in_top"), F.struct(F.col("sorted_rank").alias("r"), F.col("bp").cast("bigint").alias("b")))).over(Window.partitionBy(*task))
        out = out.withColumn("after_gate", F.col("in_top") & F.array_contains(admitted(taken, config.max_bp), F.col("sorted_rank")))
        out = out.withColumn("after_gate", F.coalesce("after_gate", F.lit(False)))
        out = out.withColumn("reason", F.when(F.col("in_top") & ~F.col("after_gate") & (F.col("bp") > 0), "max_bp").otherwise(F.col("reason")))
    elif config.max_bp >= 0:
        chosen = budget(out.filter("in_top"), task, config.max_bp, "sorted_rank").select(*task, "ordinal", "admitted")
        out = out.join(chosen, [*task, "ordinal"], "left").withColumn("after_gate", F.coalesce("admitted", F.lit(False))).drop("admitted")
        out = out.withColumn("reason", F.when(F.col("in_top") & ~F.col("after_gate") & (F.col("bp") > 0), "max_bp").otherwise(F.col("reason")))
    else:
        out = out.withColumn("after_gate", F.col("in_top"))
    return out.withColumnRenamed("reason", "reject_reason").drop("in_top")


def covered(trace: DataFrame, task: list[str]) -> DataFrame:
    """``trace`` with ``covered``: the window lies inside a kept window of its task.

    Kept windows per task are few (the gate bounds them), so every window meets the list of its task's;
    a task without a rejected window needs none.
    """
    every = Window.partitionBy(*task)
    known = trace.withColumn("rejects", F.count_if(~F.col("after_gate")).over(every) > 0)
    kept = F.collect_list(F.when(F.col("after_gate") & F.col("rejects"), F.struct(F.col("start_j").alias("k0"), F.col("end_j").alias("k1")))).over(every)
    inside = F.exists("kept_of", lambda k: (k["k0"] <= F.col("start_j")) & (k["k1"] >= F.col("end_j")))
    return known.withColumn("kept_of", kept).withColumn("covered", ~F.col("after_gate") & F.coalesce(inside, F.lit(False))).drop("rejects", "kept_of")


def task_state(trace: DataFrame, task: list[str], fallback: FallbackConfig = FallbackConfig()) -> DataFrame:
    """``trace`` plus per-task facts: n_kept, best_kept, and whether a row may be selected by the fallback."""
    every = Window.partitionBy(*task)
    rows = covered(trace, task)
    rows = rows.withColumns({
        "n_kept": F.sum(F.col("after_gate").cast("int")).over(every), "best_kept": F.max(F.when(F.col("after_gate"), F.col("best"))).over(every),
        "singleton": ~F.col("after_gate") & (F.col("reject_reason") == "singleton_missing_margin") & missing_margin_singleton(),
    })
    qualified = F.col("singleton") & (F.col("best") >= SINGLETON_OVERRIDE)
    open_ = qualified & ~F.col("covered")
    near = F.when(F.col("n_kept") == 0, qualified).otherwise(open_ & (F.col("best_kept") - F.col("best") <= fallback.max_gap))
    allowed = (F.col("n_kept") == 0) | (F.col("n_kept") <= max(fallback.max_kept, 0))
    return rows.withColumns({"qualified": qualified, "open": open_, "near": near & allowed, "allowed": allowed})


def selective_fallback(trace: DataFrame, task: list[str], fallback: FallbackConfig = FallbackConfig()) -> DataFrame:
    """The trace after at most one rejected window per task was admitted (``selective_fallback_selected``)."""
    every = Window.partitionBy(*task)
    rows = task_state(trace, task, fallback)
    choice = F.col("near")
    if fallback.band_75_79:
        band = ~F.col("after_gate") & F.col("best").between(75, 79) & ~F.col("covered") & F.col("allowed") & (F.col("n_kept") > 0)
        rows = rows.withColumn("any_near", F.max(F.col("near").cast("int")).over(every))
        choice = F.col("near") | ((F.col("any_near") == 0) & band)
    rows = rows.withColumn("choice", choice)
    nth = F.row_number().over(Window.partitionBy(*task, "choice").orderBy(*rank_order()))
    rows = rows.withColumn("selective_fallback_selected", F.col("choice") & (nth == 1))
    rows = rows.withColumns({
        "after_gate": F.col("after_gate") | F.col("selective_fallback_selected"),
        "reject_reason": F.when(F.col("selective_fallback_selected"), "selective_fallback").otherwise(F.col("reject_reason")),
    })
    rank = F.row_number().over(Window.partitionBy(*task, "after_gate").orderBy(*rank_order())) - 1
    return rows.withColumn("sorted_rank", F.when(F.col("after_gate"), rank)).drop("choice", "any_near", "singleton", "qualified", "open", "near", "allowed", "n_kept", "best_kept", "covered")


def blockers(trace: DataFrame, task: list[str], fallback: FallbackConfig = FallbackConfig()) -> DataFrame:
    """One row per task: why the fallback does or does not select a window."""
    rows = task_state(trace, task, fallback)
    flag = lambda c: F.max(F.col(c).cast("int")) == 1
    n = F.max("n_kept")
    return rows.groupBy(*task).agg(
        F.when(n == 0, "empty_after_gate").when((F.lit(fallback.max_kept) > 0) & (n > fallback.max_kept), "max_kept_windows").when(flag("near"), "selected")
        .when(~flag("singleton"), "no_singleton_missing_margin").when(~flag("qualified"), "singleton_override").when(~flag("open"), "covered_by_kept").otherwise("score_gap").alias("blocker"),
        n.cast("bigint").alias("n_kept"), F.sum((~F.col("after_gate")).cast("bigint")).alias("n_rejected"),
    )


def rerun_upgrade(trace: DataFrame, selected: DataFrame, task: list[str]) -> DataFrame:
    """Per selected task: windows and bp that going back to the ungated windows would add; upgraded if either is above 0."""
    per = trace.groupBy(*task).agg(
        F.sum((~F.col("after_gate")).cast("bigint")).alias("added_windows"), F.sum(F.when(~F.col("after_gate"), F.col("bp")).otherwise(0)).cast("bigint").alias("added_bp")
    )
    return per.join(selected.select(*task).distinct(), task, "left_semi").withColumn("upgraded", (F.col("added_windows") > 0) | (F.col("added_bp") > 0))


def counters(trace: DataFrame) -> DataFrame:
    """One row: how many windows passed, were rejected by each test, or were trimmed."""
    weak = F.col("reject_reason").isin("singleton_missing_margin", "low_support_or_margin")
    return trace.agg(
        F.count("*").alias("before_gate"), F.count_if("after_gate").alias("after_gate"), F.count_if(F.col("reject_reason") == "min_peak_score").alias("by_peak"),
        F.count_if(weak & ~F.col("support_ok")).alias("by_support"), F.count_if(weak & ~F.col("margin_ok")).alias("by_margin"),
        F.count_if(F.col("reject_reason") == "max_windows").alias("by_max_windows"), F.count_if(F.col("reject_reason") == "max_bp").alias("by_max_bp"),
        F.count_if((F.col("reject_reason") == "singleton_rescued") & F.col("after_gate")).alias("rescued"),
    )


def discovery_status(per_task: DataFrame) -> DataFrame:
    """Status of a discovery run from sums over its tasks (failed, seeds, windows)."""
    s = per_task.agg(F.sum("failed").alias("failed"), F.sum("seeds").alias("seeds"), F.sum("windows").alias("windows"), F.count("*").alias("tasks"))
    return s.withColumn("status", F.when(F.col("failed") > 0, "prefilter_failed").when((F.col("seeds") == 0) | (F.col("windows") == 0), "empty").otherwise("ok"))
