"""Why a reference hit is missing: containment and nearest-window joins, attribution classes, task features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import band_below_75, band_below_85, interval_distance, score_band, share, support_bin, window_bp
from .windows import rank_order


def containment_join(hits: DataFrame, windows: DataFrame, keys: list[str], bin_size: int | None = None) -> DataFrame:
    """Hits (h0, h1) with the windows (start_j, end_j) of equal keys that contain them.

    With ``bin_size`` windows are spread over the bins they touch and a hit looks only into the bin
    of its start, so that a key with very many windows does not become one large product.
    """
    inside = (F.col("start_j") <= F.col("h0")) & (F.col("end_j") >= F.col("h1"))
    if not bin_size:
        return hits.join(windows, keys).filter(inside)
    bins = F.sequence(F.floor(F.col("start_j") / bin_size), F.floor(F.col("end_j") / bin_size))
    spread = windows.filter("start_j <= end_j").withColumn("bin", F.explode(bins))
    return hits.withColumn("bin", F.floor(F.col("h0") / bin_size)).join(spread, [*keys, "bin"]).filter(inside).drop("bin")


def nearest(hits: DataFrame, windows: DataFrame, keys: list[str], hit_id: list[str]) -> DataFrame:
    """Per hit the distance to the nearest window of equal keys; null without one."""
    d = interval_distance(F.col("h0"), F.col("h1"), F.col("start_j"), F.col("end_j"))
    return hits.join(windows.select(*keys, "start_j", "end_j"), keys, "left").groupBy(*hit_id).agg(F.min(F.when(F.col("start_j").isNotNull(), d)).alias("distance"))


def attribute(missing: DataFrame, trace: DataFrame, keys: list[str], hit_id: list[str], near: int) -> DataFrame:
    """Each missing hit with its class: inside_kept, inside_rejected, near_kept (within ``near``) or far_outside."""
    kept, rejected = trace.filter("after_gate"), trace.filter("not after_gate")
    one = lambda w, name: containment_join(missing.select(*dict.fromkeys([*keys, *hit_id, "h0", "h1"])), w.select(*keys, "start_j", "end_j"), keys).select(*hit_id).distinct().withColumn(name, F.lit(True))
    out = missing.join(one(kept, "in_kept"), hit_id, "left").join(one(rejected, "in_rejected"), hit_id, "left").join(nearest(missing, kept, keys, hit_id), hit_id, "left")
    return out.withColumn(
        "class", F.when(F.col("in_kept"), "inside_kept").when(F.col("in_rejected"), "inside_rejected").when(F.col("distance") <= near, "near_kept").otherwise("far_outside")
    ).drop("in_kept", "in_rejected")


def class_shares(rows: DataFrame, classes: list[str], weight: str = "score") -> DataFrame:
    """Count, weight and shares of each class of a fixed list, zero-filled."""
    spark = rows.sparkSession
    domain = spark.createDataFrame([(c,) for c in classes], "class string")
    per = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    total = rows.agg(F.count("*").alias("all_n"), F.coalesce(F.sum(weight), F.lit(0)).alias("all_w"))
    out = F.broadcast(domain).join(per, "class", "left").join(F.broadcast(total))
    n, w = F.coalesce("n", F.lit(0)), F.coalesce("w", F.lit(0))
    return out.select("class", n.alias("n"), w.alias("weight"), share(n, F.col("all_n")).alias("n_share"), share(w, F.col("all_w")).alias("weight_share"))


def strongest_rejected(missing: DataFrame, trace: DataFrame, keys: list[str], hit_id: list[str]) -> DataFrame:
    """Per missing hit the first, in window order, of the rejected windows that contain it."""
    inside = containment_join(missing, trace.filter("not after_gate"), keys)
    return inside.withColumn("nth", F.row_number().over(Window.partitionBy(*hit_id).orderBy(*rank_order()))).filter("nth = 1").drop("nth")


def window_class(singleton_override: int = 85) -> Column:
    return (
        F.when(F.col("best") < singleton_override, "score_lt_85").when((F.col("support") == 1) & F.col("second").isNotNull(), "support1_margin_present")
        .when(F.col("support") == 2, "support2").when((F.col("support") >= 3) & (F.col("reject_reason") == "low_support_or_margin"), "support3plus_low_support_or_margin").otherwise("other")
    )


def score_lt_bands() -> dict[str, Column]:
    return {"band85": F.when(F.col("best") < 85, band_below_85(F.col("best"))), "band75": F.when(F.col("best") < 75, band_below_75(F.col("best")))}


def task_features(trace: DataFrame, task: list[str]) -> DataFrame:
    """One row per task over its rejected, uncovered windows (``covered`` must be there): counts, sums, bands, gap, diversity."""
    rej = ~F.col("after_gate") & ~F.col("covered")
    of = lambda c: F.when(rej, c)
    bp, best = window_bp(F.col("start_j"), F.col("end_j")), F.col("best")
    nth = F.row_number().over(Window.partitionBy(*task, rej).orderBy(best.desc(), "ordinal"))
    rows = trace.withColumns({"nth": nth, "band": score_band(best), "bin": support_bin(F.col("support"))})
    out = rows.groupBy(*task).agg(
        F.count_if("after_gate").alias("n_kept"), F.count_if(rej).alias("n_rejected"), F.coalesce(F.sum(of(bp)), F.lit(0)).cast("bigint").alias("rejected_bp"),
        F.coalesce(F.max(of(bp)), F.lit(0)).cast("bigint").alias("max_rejected_bp"), F.max(F.when(F.col("after_gate"), best)).alias("best_kept"), F.max(of(best)).alias("best_rejected"),
        F.coalesce(F.sum(of(best)), F.lit(0)).alias("score_sum"), F.coalesce(F.sum(F.when(rej & (F.col("nth") <= 3), best)), F.lit(0)).alias("top3_sum"),
        F.coalesce(F.sum(of(best * bp)), F.lit(0)).cast("bigint").alias("score_x_bp"), F.coalesce(F.sum(of(best * F.col("support"))), F.lit(0)).cast("bigint").alias("score_x_support"),
        *[F.count_if(rej & (F.col("band") == b)).alias(f"band_{b}") for b in ("ge85", "80_84", "75_79", "70_74", "lt70")],
        *[F.count_if(rej & (F.col("bin") == b)).alias(f"bin_{b}") for b in ("support1", "support2", "support3plus")],
        F.count_distinct(of(F.col("reject_reason"))).alias("n_reasons"),
    )
    return out.withColumn("score_gap", F.col("best_kept") - F.col("best_rejected"))


def entropy(rows: DataFrame, group: list[str], symbol: list[str]) -> DataFrame:
    """Shannon entropy in bits of ``symbol`` within each group."""
    per = rows.groupBy(*group, *symbol).agg(F.count("*").alias("n"))
    # H = log2 N - sum(n log2 n) / N needs no join back to the totals
    return per.groupBy(*group).agg(F.greatest(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n"), F.lit(0.0)).alias("entropy"))


def prefix_coverage(ranked: DataFrame, budgets: list[int], group: list[str], rank: str, measures: list[str]) -> DataFrame:
    """Sums of ``measures`` over the first b rows of each group's ranking, for every budget b."""
    table = ranked.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    rows = ranked.join(F.broadcast(table), F.col(rank) <= F.col("budget"))  # at most len(budgets) copies of a row
    return rows.groupBy(*group, "budget").agg(F.count("*").alias("n_tasks"), *[F.sum(m).cast("bigint").alias(m) for m in measures])


def deployable_order(kind: str) -> list[Column]:
    """Orders of tasks known before their reference: ``sparse_gap``, ``support_pressure``, ``score_mass``; missing gaps come last."""
    gap = F.coalesce("score_gap", F.lit(10**18))
    return {
        "sparse_gap": [F.col("n_kept"), gap, F.col("rejected_bp"), F.col("task")],
        "support_pressure": [F.col("bin_support3plus").desc(), F.col("bin_support2").desc(), gap, F.col("task")],
        "score_mass": [F.col("score_x_bp").desc(), gap, F.col("task")],
    }[kind]
