"""Runs and configurations: group summaries, quality gates, Pareto frontier, picks and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import share


def summary(runs: DataFrame, config: list[str], measures: list[str]) -> DataFrame:
    """Count, and mean, smallest and largest of each measure, per configuration."""
    return runs.groupBy(*config).agg(
        F.count("*").alias("n"), *[x for m in measures for x in (F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"), share(F.sum(m), F.count(m)).alias(f"mean_{m}"))]
    )


def quality_gate(recall: Column, top_hit: Column, least_recall: float | None, least_top: float | None) -> Column:
    """Both minima are met; a minimum that is not given passes."""
    ok = F.lit(True)
    if least_recall is not None:
        ok = ok & (recall >= least_recall)
    if least_top is not None:
        ok = ok & (top_hit >= least_top)
    return ok


def promotion_gate(d_top: Column, d_top10: Column, d_weighted: Column, d_bp: Column, least10: float, least_weighted: float, most_bp: float) -> Column:
    return (F.abs(d_top) <= 1e-12) & (d_top10 >= least10) & (d_weighted >= least_weighted) & (d_bp <= most_bp)


def worst(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The row that is least in ``order`` (lexicographic), per group."""
    return rows.groupBy(*group).agg(F.min(F.struct(*order)).alias("w")).select(*group, *[F.col(f"w.{c}").alias(c) for c in order])


def _skyline(rows):
    """Of an array of points those that no other dominates: each is compared with the ones kept so far, in the order of their sum."""
    import numpy as np

    m = rows[np.lexsort([*rows.T[::-1], rows.sum(axis=1)])]
    kept = np.empty((0, m.shape[1]), dtype=m.dtype)
    for p in m:  # a point is never dominated by one of a larger sum
        if not len(kept) or not ((kept <= p).all(axis=1) & (kept < p).any(axis=1)).any():
            kept = np.vstack([kept, p])
    return kept


def pareto(points: DataFrame, maximise: list[str], minimise: list[str], key: str, rounds: int = 2) -> DataFrame:
    """Points no other point dominates (at least as good everywhere, better somewhere). Measures must not be null.

    Equal points are first reduced to one. Each task keeps the front of its own points, then of ever
    fewer tasks', since a point off its part's front is off the whole one; only fronts move, and no
    pairs are formed. Measures are compared as 64-bit floats.
    """
    import numpy as np
    import pandas as pd

    m = [*[-F.col(c) for c in maximise], *[F.col(c) for c in minimise]]
    names = [f"m{i}" for i in range(len(m))]
    front = points.select(*[x.cast("double").alias(n) for n, x in zip(names, m)]).distinct()

    def local(frames):
        kept = np.empty((0, len(names)))
        for f in frames:
            kept = _skyline(np.vstack([kept, f.to_numpy(dtype=np.float64)]))
        if len(kept):
            yield pd.DataFrame(kept, columns=names)

    schema = ", ".join(f"{n} double" for n in names)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = front.mapInPandas(local, schema)
    for k in range(rounds):
        parts = max(1, int(parts**0.5)) if k < rounds - 1 else 1
        front = front.repartition(parts).mapInPandas(local, schema)
    return points.join(front, [points_col(points, n, maximise, minimise, i).cast("double") == front[n] for i, n in enumerate(names)], "left_semi")


def points_col(points: DataFrame, name: str, maximise: list[str], minimise: list[str], i: int) -> Column:
    return -points[maximise[i]] if i < len(maximise) else points[minimise[i - len(maximise)]]


def pick(rows: DataFrame, group: list[str], first: str, order: list[Column]) -> DataFrame:
    """Per group the ``first`` of the row that comes first in ``order``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("nth = 1").select(*group, first)


def strongest_and_median(rows: DataFrame, bucket: list[str], value: str, key: str) -> DataFrame:
    """Per bucket the row of largest value, and the middle one (n div 2 from the top) of the other rows with a positive value; without one, the second row."""
    order = Window.partitionBy(*bucket).orderBy(F.col(value).desc(), key)
    r = rows.withColumns({"nth": F.row_number().over(order), "n_positive": F.sum((F.col(value) > 0).cast("int")).over(Window.partitionBy(*bucket))})
    out = r.withColumn("kind", F.when(F.col("nth") == 1, "strongest").when(F.col("nth") == 2 + F.expr("greatest(n_positive - 1, 0) div 2"), "median"))
    return out.filter("kind is not null").select(*bucket, key, value, "kind")


def best_runs(rows: DataFrame, group: list[str], run: str, wall: str, qualifies: Column) -> DataFrame:
    """Fastest run over all, and over those that qualify (null without one); ties go to the smaller run."""
    return rows.groupBy(*group).agg(
        F.min(F.struct(wall, run))[run].alias("best_overall"), F.min(F.when(qualifies, F.struct(wall, run)))[run].alias("best_qualifying"),
    )


def projection(total_s: Column, sample_bp: Column, genome_bp: Column, workers: Column) -> dict[str, Column]:
    """Scale from a sample to a genome shared by workers; null where the sample or workers are 0."""
    scale = F.try_divide(F.try_divide(genome_bp.cast("double"), sample_bp.cast("double")), workers.cast("double"))
    return {"scale": scale, "projected_s": total_s * scale}


def panel_deltas(base: DataFrame, cand: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Means of both runs and of their difference over the tiles, rounded half-even to 12 places; one row per measure."""
    j = base.select(*key, *[F.col(m).alias(f"b_{m}") for m in measures]).join(cand.select(*key, *[F.col(m).alias(f"c_{m}") for m in measures]), key)
    row = j.agg(*[x for m in measures for x in (share(F.sum(f"b_{m}"), F.count(f"b_{m}")).alias(f"b_{m}"), share(F.sum(f"c_{m}"), F.count(f"c_{m}")).alias(f"c_{m}"))])
    items = F.array(*[F.struct(F.lit(m).alias("measure"), F.bround(F.col(f"b_{m}"), 12).alias("baseline"), F.bround(F.col(f"c_{m}"), 12).alias("candidate"), F.bround(F.col(f"c_{m}") - F.col(f"b_{m}"), 12).alias("delta")) for m in measures])
    return row.select(F.inline(items))


def dominant(counters: DataFrame, names: list[str]) -> DataFrame:
    """Sums of named counters and the name of the largest; earlier names win ties."""
    sums = counters.agg(*[F.sum(n).alias(n) for n in names])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return sums.withColumn("dominant", best["name"])
